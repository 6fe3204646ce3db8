"""Rare regions: graph, segmentation, cluster table, merging, selection, export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.functions.similarity import Metric
from rarefield.operators import clusters, community, density, graph, lattice, neighbors
from rarefield.scratch import Scratch


@dataclass
class GraphSpec:
    """How points become a pruned, weighted graph and then segments."""

    metric: Metric
    mode: str = "auto"  # grid, knn or auto: a grid where the points are a full regular lattice
    radius: int = 1
    k: int = 8
    max_distance: float | None = None
    weight: str = "inverse"
    sigma: float | None = None
    sigma_quantile: float = 0.5
    topk: int | None = None
    segmenter: str = "auto"
    gamma: float = 1.0


@dataclass
class MergeSpec:
    """How segments become clusters: a method of ``density.cluster`` with its options, over mean features."""

    method: str = "hierarchical"
    features: Sequence[str] = ()
    options: dict = field(default_factory=dict)


def build_graph(points: DataFrame, spec: GraphSpec, axes: Sequence[str] = lattice.AXES, id_col: str = "id") -> DataFrame:
    """(src, dst, distance, weight) after the distance filter and pruning."""
    if spec.mode not in ("auto", "grid", "knn"):
        raise ValueError(f"unknown graph mode {spec.mode!r}")
    grid = spec.mode == "grid" or spec.mode == "auto" and lattice.is_full_grid(points, axes)
    if grid:
        edges = lattice.grid_edges(lattice.with_index(points, axes), spec.radius, id_col)
    else:
        edges = neighbors.mutual_knn_edges(points, spec.k, axes, id_col)
    far = graph.within(graph.edge_distances(edges, points, spec.metric, id_col), spec.max_distance)
    scratch = Scratch(points.sparkSession, "graph")
    far = scratch.save(far, "distances")
    return scratch.save(graph.topk_prune(graph.weigh(far, spec.weight, spec.sigma, spec.sigma_quantile), spec.topk), "edges")


def segment_points(points: DataFrame, spec: GraphSpec, axes: Sequence[str] = lattice.AXES, id_col: str = "id") -> DataFrame:
    """``points`` with ``segment``: consecutive labels from 0."""
    edges = build_graph(points, spec, axes, id_col)
    labels = community.segment(points, edges, spec.segmenter, spec.gamma, id_col)
    numbered = clusters.relabel(labels, "label", "segment").select(id_col, "segment")
    return points.join(numbered, id_col)


def merge_segments(table: DataFrame, spec: MergeSpec, label: str = "segment") -> DataFrame:
    """(segment, cluster_label) of a segment table."""
    found = density.cluster(table, spec.method, features=list(spec.features), id_col=label, **spec.options)
    key = "id" if "id" in found.columns else label
    return found.select(F.col(key).alias(label), F.col("label").alias("cluster_label"))


@dataclass
class RareRegions:
    """What a run returns; ``clusters`` and ``points`` are lazy."""

    segments: DataFrame
    clusters: DataFrame
    selected: DataFrame
    points: DataFrame
    stats: DataFrame

    @property
    def rare_points(self) -> DataFrame:
        return self.points.where(F.col("block_id") >= 2)


def find_rare_regions(points: DataFrame, graph_spec: GraphSpec, features: Sequence[str], merge_spec: MergeSpec | None = None, selector: clusters.Selector | None = None, axes: Sequence[str] = lattice.AXES, id_col: str = "id") -> RareRegions:
    """Both stages and the selection.

    The second stage summarises segments, so its ``n`` counts segments and
    ``n_sum`` points.
    """
    scratch = Scratch(points.sparkSession, "rare")
    segmented = scratch.save(segment_points(points, graph_spec, axes, id_col), "segmented")
    segments = scratch.save(clusters.cluster_means(segmented, "segment", axes, features), "segments")
    means = [c for c in segments.columns if c not in (*axes, "segment")]
    if merge_spec is None:
        merged = segments.select("segment", F.col("segment").alias("cluster_label"))
    else:
        merged = merge_segments(segments, merge_spec)
    labelled = segments.join(merged, "segment")
    table = scratch.save(clusters.cluster_summary(labelled, "cluster_label", axes, means), "clusters")
    select = selector or clusters.default_rare()
    selected = scratch.save(select(table), "selected")
    blocks = clusters.block_numbers(selected)
    mapped = segmented.join(labelled.select("segment", "cluster_label"), "segment")
    out = clusters.apply_blocks(mapped, blocks)
    stats = clusters.rarity_stats(table.join(selected.select("cluster_label"), "cluster_label", "left_semi"), means).orderBy("n", "cluster_label")
    return RareRegions(segmented, table, selected, out, stats)

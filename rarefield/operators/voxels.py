"""Orientation fields on voxels: flood segmentation, infill, small segments, smoothing.

Voxels have an id, lattice indices ``ix iy iz``, a ``phase`` (0 is void) and a
rotation matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.functions.orientation import misorientation
from rarefield.operators.components import label_nodes
from rarefield.operators.lattice import INDEX, grid_edges, neighbours
from rarefield.operators.ranking import numbered
from rarefield.scratch import Scratch


def flood(voxels: DataFrame, tolerance: float, min_size: int = 1, connectivity: int = 6, matrix: str = "matrix", id_col: str = "id", symmetry: str = "432") -> DataFrame:
    """(id, segment): voxels joined by neighbour steps of a misorientation below ``tolerance`` degrees.

    Segments are numbered from 1 by size, then smallest voxel; void is 0, segments
    of fewer than ``min_size`` voxels are -1.  The result does not depend on an order
    of growth, so there are no seeds.
    """
    scratch = Scratch(voxels.sparkSession, "flood")
    solid = voxels.where("phase > 0")
    nodes = solid.select(F.col(id_col).alias("id"), *INDEX, F.col(matrix).alias("m"))
    steps = grid_edges(nodes, 1, "id", INDEX, "manhattan" if connectivity == 6 else "chebyshev")
    joined = steps.join(nodes.select(F.col("id").alias("src"), F.col("m").alias("ma")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("m").alias("mb")), "dst")
    close = joined.where(misorientation("ma", "mb", symmetry) < tolerance).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    comps = scratch.save(label_nodes(nodes, close, scratch, "id"), "components")
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    kept = numbered(sizes.where(F.col("n") >= min_size), [F.desc("n"), F.col("component")], "segment", 1, scratch).select("component", "segment")
    named = comps.join(kept, "component", "left").select("node", F.coalesce("segment", F.lit(-1).cast("long")).alias("segment"))
    return voxels.select(F.col(id_col).alias("id")).join(named, F.col("id") == F.col("node"), "left").select("id", F.coalesce("segment", F.lit(0).cast("long")).alias("segment"))


def infill(voxels: DataFrame, segment: str = "segment", connectivity: int = 6, id_col: str = "id", empty: int = -1) -> DataFrame:
    """``voxels`` with each ``empty`` voxel given the segment of its first filled neighbour, pass by pass.

    A pass sees the segments as they were at its start; it ends when a pass fills
    nothing.  Void (0) is neither filled nor a source.
    """
    scratch = Scratch(voxels.sparkSession, "infill")
    near = scratch.save(neighbours(voxels, connectivity, id_col), "neighbours")
    now = scratch.save(voxels.select(F.col(id_col).alias("id"), F.col(segment).cast("long").alias("s")), "segments")
    while True:
        source = now.where((F.col("s") != empty) & (F.col("s") != 0)).select(F.col("id").alias("nbr"), F.col("s").alias("ns"))
        want = now.where(F.col("s") == empty).select("id")
        found = near.join(want, "id", "left_semi").join(source, "nbr").groupBy("id").agg(F.min_by("ns", "k").alias("new"))
        found = scratch.save(found, "found")
        if found.isEmpty():
            break
        then = scratch.save(now.join(found, "id", "left").select("id", F.coalesce("new", "s").alias("s")), "segments")
        scratch.drop(now)
        now = then
    return voxels.drop(segment).join(now.select(F.col("id").alias(id_col), F.col("s").alias(segment)), id_col)


def remove_small(voxels: DataFrame, min_size: int, segment: str = "segment", connectivity: int = 6, id_col: str = "id") -> DataFrame:
    """``voxels`` with each segment of fewer than ``min_size`` voxels given to the neighbour that it touches most.

    Small segments go in the order of their number, and later ones see what earlier
    ones became; the list of small segments is fixed at the start.  Ties go to the
    smallest number; a segment that touches none becomes -1.  The contacts between
    segments, not the voxels, take part in the ordered loop, which runs in one task
    for each group of small segments that touch each other: groups do not see each
    other, as larger segments stay what they are.
    """
    scratch = Scratch(voxels.sparkSession, "small")
    own = voxels.select(F.col(id_col).alias("id"), F.col(segment).cast("long").alias("s"))
    sizes = own.where("s > 0").groupBy("s").agg(F.count("*").alias("n"))
    small = scratch.save(sizes.where(F.col("n") < min_size).select("s"), "small")
    a = own.select("id", F.col("s").alias("sa"))
    b = own.select(F.col("id").alias("nbr"), F.col("s").alias("sb"))
    touching = neighbours(voxels, connectivity, id_col).join(a, "id").join(b, "nbr").where("sa > 0 and sb > 0 and sa != sb").groupBy("sa", "sb").agg(F.count("*").alias("n"))
    touching = scratch.save(touching.join(small, F.col("sa") == F.col("s"), "left_semi"), "touching")
    inner = touching.join(small, F.col("sb") == F.col("s"), "left_semi").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    grouped = label_nodes(small, inner, scratch, "s").join(touching, F.col("node") == F.col("sa"), "left").select("component", "node", "sb", "n")
    table = grouped.groupBy("component").applyInArrow(_merged_in_order, "_s long, _to long")
    return scratch.save(voxels.join(table, F.col(segment).cast("long") == F.col("_s"), "left").withColumn(segment, F.coalesce("_to", F.col(segment).cast("long"))).drop("_s", "_to"), "result")


def _merged_in_order(t: pa.Table) -> pa.Table:
    """(_s, _to): what each small segment of (node, sb, n) becomes."""
    touching: dict[int, dict[int, int]] = {}
    for s, other, n in zip(t["node"].to_pylist(), t["sb"].to_pylist(), t["n"].to_pylist(), strict=True):
        mine = touching.setdefault(s, {})
        if other is not None:
            mine[other] = n
    small = sorted(touching)
    became: dict[int, int] = {}

    def final(s: int) -> int:
        while s in became:
            s = became[s]
        return s

    for s in small:
        here: dict[int, int] = {}
        for other, n in touching[s].items():
            to = final(other)
            if to not in (s, -1):
                here[to] = here.get(to, 0) + n
        to = min(here, key=lambda o: (-here[o], o)) if here else -1
        became[s] = to
        for other, n in here.items():
            if to in touching and other != to:
                touching[to][other] = touching[to].get(other, 0) + n
    return pa.table({"_s": pa.array(small, pa.int64()), "_to": pa.array([final(s) for s in small], pa.int64())})


QUATERNION_SUMS = [(i, j) for i in range(4) for j in range(i, 4)]


def mean_quaternion(rows: DataFrame, keys: list[str], quaternion: str = "q") -> DataFrame:
    """Per key: the mean orientation, as the dominant eigenvector of the sum of q q^T.

    Ten sums per group reach Python, never the group's rows.
    """
    q = [F.get(quaternion, F.lit(k)) for k in range(4)]
    sums = rows.groupBy(*keys).agg(*[F.sum(q[i] * q[j]).alias(f"m{i}{j}") for i, j in QUATERNION_SUMS])
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["q array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.zeros((batch.num_rows, 4, 4))
            for k, (i, j) in enumerate(QUATERNION_SUMS):
                m[:, i, j] = m[:, j, i] = batch.column(len(keys) + k).to_numpy(zero_copy_only=False)
            vec = np.linalg.eigh(m)[1][:, :, -1] if len(m) else np.zeros((0, 4))
            lead = np.take_along_axis(vec, (np.abs(vec) > 1e-12).argmax(axis=1)[:, None], 1) if len(vec) else np.zeros((0, 1))
            vec = vec * np.where(lead < 0, -1.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(list(vec), pa.list_(pa.float64()))], [*keys, "q"])

    return sums.mapInArrow(run, schema)


def smooth(voxels: DataFrame, connectivity: int = 6, quaternion: str = "q", id_col: str = "id") -> DataFrame:
    """(id, q): the mean quaternion of each non-void voxel and its neighbours, void ones included; void keeps its own."""
    near = neighbours(voxels, connectivity, id_col).select("id", "nbr").union(voxels.select(F.col(id_col).alias("id"), F.col(id_col).alias("nbr")))
    solid = voxels.where("phase > 0").select(F.col(id_col).alias("id"))
    values = voxels.select(F.col(id_col).alias("nbr"), F.col(quaternion).alias("q"))
    mean = mean_quaternion(near.join(solid, "id", "left_semi").join(values, "nbr").select("id", "q"), ["id"])
    void = voxels.where("not phase > 0").select(F.col(id_col).alias("id"), F.col(quaternion).alias("q"))
    return mean.union(void)


def segment_sizes(voxels: DataFrame, segment: str = "segment") -> DataFrame:
    return voxels.groupBy(segment).agg(F.count("*").alias("n"))


def contacts(voxels: DataFrame, segment: str = "segment", connectivity: int = 6, id_col: str = "id") -> DataFrame:
    """(a, b, n): neighbour steps from a voxel of segment a to one of b."""
    a = voxels.select(F.col(id_col).alias("id"), F.col(segment).alias("a"))
    b = voxels.select(F.col(id_col).alias("nbr"), F.col(segment).alias("b"))
    return neighbours(voxels, connectivity, id_col).join(a, "id").join(b, "nbr").where("a != b").groupBy("a", "b").agg(F.count("*").alias("n"))

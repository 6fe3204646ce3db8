"""Overlap of two voxelised region clouds, with a one-to-one correspondence of their clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.operators.assignment import overlap_match
from rarefield.operators.lattice import AXES, INDEX, occupied, rasterise, spacing
from rarefield.sources.schema import require_columns

FINE = ("fx", "fy", "fz")


def membership(first: DataFrame, second: DataFrame, keys: Sequence[str] = FINE, cluster: str = "cluster") -> DataFrame:
    """(keys, c1, c2, member): the full outer join; member is 1, 2 or 3 for both, a missing cluster -1."""
    a = first.select(*keys, F.col(cluster).alias("c1"))
    b = second.select(*keys, F.col(cluster).alias("c2"))
    member = F.when(F.col("c2").isNull(), 1).when(F.col("c1").isNull(), 2).otherwise(3)
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("c1", F.lit(-1)).alias("c1"), F.coalesce("c2", F.lit(-1)).alias("c2"), member.alias("member"))


def overlap_metrics(joined: DataFrame, cell_volume: float = 1.0) -> DataFrame:
    """One row: counts, volumes, IoU, Dice and both containments; 0 where undefined."""
    n = lambda *ms: F.coalesce(F.sum(F.when(F.col("member").isin(*ms), 1).otherwise(0)), F.lit(0)).cast("long")
    counted = joined.agg(n(1, 3).alias("n1"), n(2, 3).alias("n2"), n(3).alias("n_intersection"), n(1, 2, 3).alias("n_union"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b) if isinstance(b, str) else b), F.lit(0.0))
    return counted.select(
        "n1", "n2", "n_intersection", "n_union",
        *[(F.col(c) * cell_volume).alias(f"volume_{c[2:] or c[1:]}" if c.startswith("n_") else f"volume_{c[1:]}") for c in ("n1", "n2", "n_intersection", "n_union")],
        part("n_intersection", "n_union").alias("iou"),
        F.coalesce(F.try_divide(F.col("n_intersection") * 2.0, F.col("n1") + F.col("n2")), F.lit(0.0)).alias("dice"),
        part("n_intersection", "n1").alias("containment_1"),
        part("n_intersection", "n2").alias("containment_2"),
    )


def cluster_overlaps(joined: DataFrame) -> DataFrame:
    """(c1, c2, n) over the intersection."""
    return joined.where("member = 3").groupBy("c1", "c2").agg(F.count("*").alias("n"))


def cluster_sizes(joined: DataFrame, side: int) -> DataFrame:
    return joined.where(F.col("member").isin(side, 3)).groupBy(f"c{side}").agg(F.count("*").alias(f"n{side}"))


def cluster_matches(joined: DataFrame) -> DataFrame:
    """(c1, c2, n, n1, n2, iou) of the one-to-one correspondence of greatest overlap."""
    pairs = overlap_match(cluster_overlaps(joined)).select(F.col("a").alias("c1"), F.col("b").alias("c2"), "n")
    sized = pairs.join(cluster_sizes(joined, 1), "c1").join(cluster_sizes(joined, 2), "c2")
    return sized.select("c1", "c2", "n", "n1", "n2", (F.col("n") / (F.col("n1") + F.col("n2") - F.col("n"))).alias("iou"))


def split_merge(joined: DataFrame, fraction: float = 0.1) -> DataFrame:
    """One row (n_clusters_1, n_clusters_2, n_splits, n_merges): clusters with several partners that cover ``fraction`` of them."""
    o = cluster_overlaps(joined)
    s1, s2 = cluster_sizes(joined, 1), cluster_sizes(joined, 2)
    many = lambda side, sizes: (
        o.join(sizes, f"c{side}").where(F.col("n") >= fraction * F.greatest(F.col(f"n{side}"), F.lit(1))).groupBy(f"c{side}").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("k"))
    )
    out = s1.agg(F.count("*").alias("n_clusters_1")).crossJoin(s2.agg(F.count("*").alias("n_clusters_2")))  # one row each
    return out.crossJoin(many(1, s1).withColumnRenamed("k", "n_splits")).crossJoin(many(2, s2).withColumnRenamed("k", "n_merges"))


class RegionComparison:
    """Two clouds of points with cluster ids on possibly different lattices.

    ``order`` names the column whose least value decides which point of a cell
    counts.  The common lattice has the finest spacing divided by ``supersample``.
    """

    def __init__(self, first: DataFrame, second: DataFrame, cluster: str = "rare_cluster_id", order: str = "row_id", axes: Sequence[str] = AXES, spacing_1: Sequence[float] | None = None, spacing_2: Sequence[float] | None = None, supersample: int = 1):
        if supersample < 1:
            raise ValueError("supersample is at least 1")
        for df in (first, second):
            require_columns(df, [*axes, cluster, order])
        self.first, self.second, self.cluster, self.order, self.axes = first, second, cluster, order, axes
        self.steps = [self._steps(df, given) for df, given in ((first, spacing_1), (second, spacing_2))]
        low = first.select(*axes).union(second.select(*axes)).agg(*[F.min(a).alias(a) for a in axes]).first()
        if low[axes[0]] is None:
            raise ValueError("both clouds are empty")
        self.origin = [float(low[a]) for a in axes]
        self.fine = min(min(s) for s in self.steps) / supersample

    def _steps(self, df: DataFrame, given: Sequence[float] | None) -> list[float]:
        return list(given) if given is not None else [float(spacing(df, a, "min").first()["step"] or 1.0) for a in self.axes]

    def cells(self, side: int) -> DataFrame:
        df, steps = (self.first, self.second)[side - 1], self.steps[side - 1]
        own = occupied(df, self.origin, steps, self.cluster, self.order, self.axes).withColumnRenamed(self.cluster, "cluster")
        return rasterise(own.select(*INDEX, "cluster"), steps, self.fine, "cluster")

    def membership(self) -> DataFrame:
        return membership(self.cells(1), self.cells(2))

    def metrics(self, fraction: float = 0.1) -> DataFrame:
        """Overlap metrics together with the cluster counts, splits and merges."""
        joined = self.membership()
        return overlap_metrics(joined, self.fine**3).crossJoin(split_merge(joined, fraction))  # one row each

    def matches(self) -> DataFrame:
        return cluster_matches(self.membership())

"""Cluster summaries, rarity statistics and selectors.

Selectors are callables from a cluster table to its selected rows, with their
position; ties always go to the smaller label.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefield.functions.similarity import norm, von_mises
from rarefield.operators.ranking import exact_quantiles, numbered

Selector = Callable[[DataFrame], DataFrame]


def tensor_prefixes(columns: Sequence[str]) -> list[str]:
    """Prefixes of which all nine components ``<prefix>_11`` ... ``<prefix>_33`` are present."""
    found: dict[str, set[str]] = {}
    for c in columns:
        m = re.fullmatch(r"(.+)_([123][123])", c)
        if m:
            found.setdefault(m[1], set()).add(m[2])
    return sorted(p for p, s in found.items() if len(s) == 9)


def cluster_means(points: DataFrame, label: str, coords: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per label: n, mean coordinates, mean features as ``<f>_mean``, and the mean norm of each full tensor as ``<p>_norm_mean``."""
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(c) for c in coords], *[F.avg(f).alias(f"{f}_mean") for f in features]]
    for p in tensor_prefixes(features):
        aggs.append(F.avg(norm([f"{p}_{i}{j}" for i in "123" for j in "123"])).alias(f"{p}_norm_mean"))
    return points.groupBy(label).agg(*aggs)


def cluster_summary(points: DataFrame, label: str, coords: Sequence[str], features: Sequence[str], drop_noise: bool = False) -> DataFrame:
    """Per label: n, then min, max, sum, sumsq, mean of each coordinate, then sum, sumsq, mean of each feature."""
    rows = points.where(F.col(label) != -1) if drop_noise else points
    aggs = [F.count("*").alias("n")]
    for c in coords:
        x = F.col(c)
        aggs += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.sum(x).alias(f"{c}_sum"), F.sum(x * x).alias(f"{c}_sumsq"), F.avg(x).alias(f"{c}_mean")]
    for f in features:
        x = F.col(f)
        aggs += [F.sum(x).alias(f"{f}_sum"), F.sum(x * x).alias(f"{f}_sumsq"), F.avg(x).alias(f"{f}_mean")]
    return rows.groupBy(label).agg(*aggs)


def rarity_stats(summary: DataFrame, bases: Sequence[str], sample: bool = False) -> DataFrame:
    """Mean, variance (clipped at 0; of the population unless ``sample``) and deviation from n, sum and sumsq."""
    out = summary
    for b in bases:
        mean = F.col(f"{b}_sum") / F.col("n")
        var = F.greatest(F.col(f"{b}_sumsq") / F.col("n") - mean * mean, F.lit(0.0))
        if sample:
            var = F.when(F.col("n") > 1, var * F.col("n") / (F.col("n") - 1)).otherwise(F.lit(0.0))
        out = out.withColumn(f"{b}_mean", mean).withColumn(f"{b}_var", var).withColumn(f"{b}_std", F.sqrt(var))
    return out


def counts(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row (n_clusters, n_noise); noise is label -1."""
    return labels.agg(F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("n_clusters"), F.count(F.when(F.col(label) == -1, 1)).alias("n_noise"))


def _top(clusters: DataFrame, order, k: int, label: str) -> DataFrame:
    w = Window.orderBy(order, label)
    return clusters.orderBy(order, label).limit(k).withColumn("position", F.row_number().over(w))


def smallest(nsmallest: int = 5, min_size: int = 1, label: str = "cluster_label") -> Selector:
    """The clusters with the fewest members, of at least ``min_size``."""
    return lambda c: _top(c.where(F.col("n") >= min_size), F.asc("n"), nsmallest, label)


def highest(column: str, k: int = 5, min_size: int = 1, label: str = "cluster_label") -> Selector:
    """The clusters with the highest values of a column."""
    return lambda c: _top(c.where((F.col("n") >= min_size) & F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))), F.desc(column), k, label)


def highest_von_mises(k: int = 5, components: Sequence[str] = tuple(f"s{a}_mean_mean" for a in ("xx", "yy", "zz", "xy", "yz", "xz")), min_size: int = 1, label: str = "cluster_label") -> Selector:
    """The clusters with the highest von Mises value of their mean components."""
    return lambda c: _top(c.where(F.col("n") >= min_size).withColumn("von_mises", von_mises(*components)), F.desc("von_mises"), k, label)


def highest_tensor_norm(prefix: str, k: int = 5, suffix: str = "_mean_mean", min_size: int = 1, label: str = "cluster_label") -> Selector:
    """The clusters with the highest Frobenius norm of a mean tensor."""
    parts = [f"{prefix}_{i}{j}{suffix}" for i in "123" for j in "123"]
    return lambda c: _top(c.where(F.col("n") >= min_size).withColumn("tensor_norm", norm(parts)), F.desc("tensor_norm"), k, label)


def default_rare(quantile: float = 0.05, max_rare: int | None = None, label: str = "cluster_label") -> Selector:
    """Clusters no larger than a quantile of the sizes (linear between ranks), smallest first."""
    q = min(max(quantile, 0.0), 1.0)

    def select(c: DataFrame) -> DataFrame:
        (limit,) = exact_quantiles(c, "n", [q])
        small = c.where(F.col("n") <= F.lit(limit))
        if max_rare is not None:
            small = small.orderBy("n", label).limit(max_rare)
        return numbered(small, ["n", label], "position", 1)

    return select


def block_numbers(selected: DataFrame, first: int = 2, label: str = "cluster_label") -> DataFrame:
    """(label, block_id): selected clusters numbered by size, then position in the selection, from ``first``."""
    return numbered(selected.select(label, "n", "position"), ["n", "position"], "block_id", first).select(label, "block_id")


def size_ranks(points: DataFrame, label: str) -> DataFrame:
    """(rank, label, n) of the clusters, largest first."""
    sizes = points.groupBy(label).agg(F.count("*").alias("n"))
    return numbered(sizes, [F.desc("n"), F.col(label)], "rank", 1).select("rank", label, "n")


def relabel(rows: DataFrame, label: str, out: str, start: int = 0) -> DataFrame:
    """Labels as consecutive numbers in their order; the distinct labels are numbered, not the rows."""
    table = numbered(rows.select(label).distinct(), [label], out, start)
    return rows.join(table, label, "left")


def map_labels(points: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """``points`` with ``value`` looked up by ``key``; raises if a key has no entry."""
    missing = points.where(F.col(key).isNotNull()).join(mapping, key, "left_anti").select(key).limit(1).collect()
    if missing:
        raise ValueError(f"no {value} for {key} = {missing[0][0]}")
    return points.join(mapping.select(key, value), key, "left")


def apply_blocks(points: DataFrame, blocks: DataFrame, label: str = "cluster_label", background: int = 1) -> DataFrame:
    """``points`` with their block id; those of no selected cluster get the background."""
    return points.join(blocks, label, "left").withColumn("block_id", F.coalesce("block_id", F.lit(background).cast("long")))


def histogram(values: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """(bin, low, high, value) of equal bins between least and greatest, the last one closed, empty ones included."""
    x = F.col(column).cast("double")
    rows = values.select(x.alias("x")).where("x is not null and not isnan(x)")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    ends = ends.where("total > 0").select(lo.alias("lo"), ((hi - lo) / bins).alias("w"), "total")
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counted = rows.crossJoin(ends).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))  # one row on the right
    frame = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    c = F.coalesce("c", F.lit(0))
    value = c / (F.col("total") * F.col("w")) if density else c.cast("double")
    return frame.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), value.alias("value"))

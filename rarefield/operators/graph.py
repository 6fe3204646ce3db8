"""Edges: distances, filters, weights, pruning, message passing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefield.functions.similarity import Metric, weight
from rarefield.operators.ranking import exact_quantiles
from rarefield.scratch import Scratch


def edge_distances(edges: DataFrame, nodes: DataFrame, metric: Metric, id_col: str = "id") -> DataFrame:
    """``edges`` with the metric's ``distance``; node quantities are computed once per node, before the two joins."""
    parts = metric.node()
    own = nodes.select(F.col(id_col).alias("_id"), *[c.alias(f"_f{k}") for k, c in enumerate(parts)])
    a = own.select(F.col("_id").alias("src"), *[F.col(f"_f{k}").alias(f"_u{k}") for k in range(len(parts))])
    b = own.select(F.col("_id").alias("dst"), *[F.col(f"_f{k}").alias(f"_v{k}") for k in range(len(parts))])
    distance = metric.distance([F.col(f"_u{k}") for k in range(len(parts))], [F.col(f"_v{k}") for k in range(len(parts))])
    return edges.join(a, "src").join(b, "dst").withColumn("distance", distance).select(*edges.columns, "distance")


def within(edges: DataFrame, most: float | None) -> DataFrame:
    """Edges with a distance of at most ``most`` (greater than 0)."""
    if most is None:
        return edges
    if most <= 0:
        raise ValueError("the greatest edge distance is above 0")
    return edges.where(F.col("distance") <= most)


def auto_sigma(edges: DataFrame, quantile: float = 0.5, sample: int | None = None, seed: int = 0) -> float:
    """A quantile of the edge distances, exact, or of a seeded sample without replacement."""
    from_ = edges
    if sample is not None:
        from_ = edges.orderBy(F.xxhash64(F.lit(seed), "src", "dst")).limit(sample)
    (value,) = exact_quantiles(from_, "distance", [quantile])
    if value is None or not value > 0 or value == float("inf"):
        raise ValueError(f"sigma from quantile {quantile} is {value}")
    return float(value)


def weigh(edges: DataFrame, mode: str, sigma: float | None = None, auto_quantile: float = 0.5, **options) -> DataFrame:
    if mode in ("rbf", "exp") and sigma is None:
        sigma = auto_sigma(edges, auto_quantile)
    return edges.withColumn("weight", weight("distance", mode, sigma, **options))


def topk_prune(edges: DataFrame, k: int | None, weight_col: str = "weight") -> DataFrame:
    """Edges among the ``k`` heaviest of either end; ties by (src, dst); None keeps all, k < 1 none."""
    if k is None:
        return edges
    if k < 1:
        return edges.limit(0)
    half = edges.select("src", "dst", weight_col, F.explode(F.array("src", "dst")).alias("_node"))
    w = Window.partitionBy("_node").orderBy(F.desc(weight_col), "src", "dst")
    kept = half.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("src", "dst").distinct()
    return edges.join(kept, ["src", "dst"], "left_semi")


def message_passing(nodes: DataFrame, edges: DataFrame, iterations: int, message: Callable[[Column, Column, int], Column], state: str = "f", id_col: str = "id") -> DataFrame:
    """``iterations`` rounds of F += sum over neighbours of message(F_src, F_dst, round), edges used both ways."""
    scratch = Scratch(nodes.sparkSession, "messages")
    both = scratch.save(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    now = scratch.save(nodes.select(F.col(id_col).alias("id"), F.col(state).alias("f")), "state")
    for k in range(iterations):
        sent = both.join(now.select(F.col("id").alias("src"), F.col("f").alias("fs")), "src").join(now.select(F.col("id").alias("dst"), F.col("f").alias("fd")), "dst")
        total = sent.groupBy("src").agg(F.sum(message(F.col("fs"), F.col("fd"), k)).alias("m"))
        then = scratch.save(now.join(total, now["id"] == total["src"], "left").select("id", (F.col("f") + F.coalesce("m", F.lit(0.0))).alias("f")), "state")
        scratch.drop(now)
        now = then
    return now.select(F.col("id").alias(id_col), F.col("f").alias(state))


def message_passing_vectors(nodes: DataFrame, edges: DataFrame, rounds: Sequence[int], message: Callable[[Column, Column, int], Column], width: int, state: str = "f", id_col: str = "id") -> DataFrame:
    """As :func:`message_passing` for a state of ``width`` numbers, an array; the message is an array too.

    ``rounds`` are the numbers that the message is told.  Messages are summed element by
    element where they arise, before they are shuffled, so a node of many neighbours
    receives one row from each task.
    """
    scratch = Scratch(nodes.sparkSession, "messages")
    both = scratch.save(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    now = scratch.save(nodes.select(F.col(id_col).alias("id"), F.col(state).cast("array<double>").alias("f")), "state")
    for k in rounds:
        sent = both.join(now.select(F.col("id").alias("src"), F.col("f").alias("fs")), "src").join(now.select(F.col("id").alias("dst"), F.col("f").alias("fd")), "dst")
        told = sent.select("src", message(F.col("fs"), F.col("fd"), k).alias("m"))
        total = told.groupBy("src").agg(F.array(*[F.sum(F.get("m", F.lit(n))) for n in range(width)]).alias("m"))
        new = F.when(F.col("m").isNull(), F.col("f")).otherwise(F.zip_with("f", "m", lambda a, b: a + b))
        then = scratch.save(now.join(total, now["id"] == total["src"], "left").select("id", new.alias("f")), "state")
        scratch.drop(now)
        now = then
    return now.select(F.col("id").alias(id_col), F.col("f").alias(state))


def shared_face_edges(faces: DataFrame, face: str = "face", cell: str = "cell") -> DataFrame:
    """(src, dst) of cells that share a face with exactly two cells."""
    held = faces.groupBy(face).agg(F.min(cell).alias("src"), F.max(cell).alias("dst"), F.count_distinct(cell).alias("n"))
    return held.where("n = 2").select("src", "dst").distinct()


def face_topology(faces: DataFrame, face: str = "face", cell: str = "cell") -> DataFrame:
    """One row (internal, boundary, non_manifold): faces with two cells, one, and more."""
    n = faces.groupBy(face).agg(F.count_distinct(cell).alias("n"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return n.agg(count(F.col("n") == 2).alias("internal"), count(F.col("n") == 1).alias("boundary"), count(F.col("n") > 2).alias("non_manifold"))

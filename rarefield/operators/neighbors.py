"""Nearest-neighbour joins.

Targets lie in a tree of cells that follows their density (:mod:`celltree`), so the
joins are equi-joins on cells of a bounded number of points.  Ties go to the smallest
id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefield.functions.similarity import array_l2
from rarefield.operators import celltree
from rarefield.scratch import Scratch


TIME_PARTS = 64
PAIRS_AT_ONCE = 1 << 20  # distances that a Python task holds at a time, 8 MB
TREE_DIMS, TREE_PAIRS = 4, 1 << 33  # vectors so short are searched in a tree of cells where there are more pairs


def cell_size(points: DataFrame, axes: Sequence[str], per_cell: float = 4.0) -> float:
    """A cell side with about ``per_cell`` points a cell, from the count and the middle nine tenths of each axis, so that far points do not widen it."""
    middle = [F.percentile_approx(F.col(a).cast("double"), [0.05, 0.95], 1000).alias(f"m{k}") for k, a in enumerate(axes)]
    r = points.agg(F.count("*").alias("n"), *middle).first()
    sides = [r[f"m{k}"][1] - r[f"m{k}"][0] for k in range(len(axes)) if r["n"] and r[f"m{k}"] and r[f"m{k}"][1] > r[f"m{k}"][0]]
    if not sides:
        return 1.0
    volume = 1.0
    for s in sides:
        volume *= s / 0.9
    return max((volume * per_cell / r["n"]) ** (1 / len(sides)), 1e-12)


def knn(queries: DataFrame, targets: DataFrame, k: int, axes: Sequence[str] = ("x", "y", "z"), query_id: str = "id", target_id: str = "id", exclude_self: bool = False, cap: int | None = None, within: float | None = None) -> DataFrame:
    """(query, target, distance, rank) of the ``k`` nearest targets of each query, all of them where there are fewer.

    Targets farther than ``within`` may be left out, which spares queries far from all
    targets their large balls.  ``cap`` is the most targets that a cell of the tree holds.  Points with a missing or
    infinite coordinate are left out.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    scratch = Scratch(queries.sparkSession, "knn")
    dims = range(len(axes))
    finite = lambda df, p: df.where(" and ".join(f"abs({p}{n}) < double('Infinity') and not isnan({p}{n})" for n in dims))
    q = finite(queries.select(F.col(query_id).alias("query"), *[F.col(a).cast("double").alias(f"q{n}") for n, a in enumerate(axes)]), "q")
    t = finite(targets.select(F.col(target_id).alias("target"), *[F.col(a).cast("double").alias(f"t{n}") for n, a in enumerate(axes)]), "t")
    need = k + 1 if exclude_self else k
    tree = celltree.build(t, len(axes), cap or max(32, 4 * k), need, scratch)
    if tree is None:
        return q.select("query", F.lit(None).cast(t.schema["target"].dataType).alias("target"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    met = celltree.nearest(tree, q, need, scratch, within)
    if exclude_self:
        met = met.where("query != target")
    w = Window.partitionBy("query").orderBy("distance", "target")
    ranked = met.select("query", "target", F.sqrt("d2").alias("distance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scratch.save(ranked, "nearest")


def mutual_knn_edges(points: DataFrame, k: int, axes: Sequence[str] = ("x", "y", "z"), id_col: str = "id") -> DataFrame:
    """(src, dst), src < dst, of points that are among each other's ``k`` nearest."""
    n = points.count()
    if k >= n:
        raise ValueError(f"k = {k} needs more than {n} points")
    near = knn(points, points, k, axes, id_col, id_col, exclude_self=True)
    back = near.select(F.col("target").alias("query"), F.col("query").alias("target"))
    edges = near.where("query < target").join(back, ["query", "target"], "left_semi").select(F.col("query").alias("src"), F.col("target").alias("dst"))
    return Scratch(points.sparkSession, "mutual").save(edges, "edges")  # callers read them several times


def nearest_attributes(queries: DataFrame, targets: DataFrame, attributes: Sequence[str], axes: Sequence[str] = ("x", "y", "z"), query_id: str = "id", target_id: str = "id") -> DataFrame:
    """``queries`` with the attributes of their nearest target and its distance (null where there is none)."""
    near = knn(queries, targets, 1, axes, query_id, target_id).select(F.col("query").alias(query_id), F.col("target").alias("_target"), F.col("distance").alias("nearest_distance"))
    got = targets.select(F.col(target_id).alias("_target"), *attributes)
    return queries.drop(*[a for a in attributes if a in queries.columns]).join(near.join(got, "_target"), query_id, "left").drop("_target")


def feature_topk(a: DataFrame, b: DataFrame, k: int, features: str, id_col: str = "id", block: int = 4096, pairs: int = PAIRS_AT_ONCE, tree_pairs: int = TREE_PAIRS) -> DataFrame:
    """(query, target, distance2, rank): the ``k`` rows of ``b`` nearest to each row of ``a`` by squared L2.

    ``a`` is a stated query set: its rows are met with ``b`` in blocks, ``pairs``
    distances at a time, and each task keeps its k best per query, which alone are
    shuffled.  Vectors of at most ``TREE_DIMS`` numbers with more than ``tree_pairs`` pairs
    are searched in a tree of cells instead, with the same result and without all pairs.
    """
    import numpy as np
    import pyarrow as pa

    spark = a.sparkSession
    scratch = Scratch(spark, "topk")
    numbered = scratch.save(a.select(F.col(id_col).cast("long").alias("query"), F.col(features).cast("array<double>").alias("v")), "queries")
    total = numbered.count()
    parts = max(1, -(-total // block))
    targets = b.select(F.col(id_col).cast("long").alias("target"), F.col(features).cast("array<double>").alias("v"))
    if total * b.count() > tree_pairs and (dims := _tree_dims(numbered, targets)):
        return _tree_topk(numbered, targets, k, dims, scratch)
    found = None
    for part in range(parts):
        rows = numbered.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).orderBy("query").toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast((rows["query"].to_numpy(), np.array(rows["v"].to_pylist(), float)))

        def best(batches, sent=sent):
            ids, q = sent.value
            q2 = (q * q).sum(axis=1)
            i, target, exact = np.empty(0, int), np.empty(0, np.int64), np.empty(0)  # the best so far, by query
            worst = np.full(len(ids), np.inf)  # of the k best, once there are as many
            for tid, t in _slices(batches, max(k, pairs // len(ids))):
                t2 = (t * t).sum(axis=1)
                known = ~np.isnan(t2)  # a NaN would make the slice's slack one
                tid, t, t2 = tid[known], t[known], t2[known]
                if not len(t):
                    continue
                d = q2[:, None] + t2[None, :] - 2 * q @ t.T
                cut = np.minimum(worst, np.partition(d, k - 1, axis=1)[:, k - 1]) if len(t) >= k else worst
                slack = 1e-9 * (1 + np.abs(cut)) + 1e-12 * (q2 + t2.max())
                new, j = np.nonzero(d <= (cut + slack)[:, None])  # ties stay until the ids decide
                width = max(1, pairs // max(1, t.shape[1]))
                sums = [((q[new[s : s + width]] - t[j[s : s + width]]) ** 2).sum(axis=1) for s in range(0, len(new), width)]
                i, target, exact = np.concatenate([i, new]), np.concatenate([target, tid[j]]), np.concatenate([exact, *sums])
                order = np.lexsort((target, exact, i))
                first = np.searchsorted(i[order], np.arange(len(ids)))
                order = order[np.arange(len(order)) - first[i[order]] < k]
                i, target, exact = i[order], target[order], exact[order]
                full = np.flatnonzero(np.bincount(i, minlength=len(ids)) == k)
                worst[full] = exact[np.searchsorted(i, full, "right") - 1]
            for s in range(0, len(i), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[s : s + 10_000]]), pa.array(target[s : s + 10_000]), pa.array(exact[s : s + 10_000])], ["query", "target", "distance2"])

        part_found = targets.mapInArrow(best, "query long, target long, distance2 double")
        found = part_found if found is None else found.union(part_found)
    if found is None:
        return numbered.select("query", F.col("query").alias("target"), F.lit(0.0).alias("distance2"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("query").orderBy("distance2", "target")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tree_dims(queries: DataFrame, targets: DataFrame) -> int | None:
    """The length of all vectors where a tree can hold them: at most ``TREE_DIMS`` numbers, none infinite, and no id twice."""
    sizes = set()
    for side, id_col in ((queries, "query"), (targets, "target")):
        unbounded = F.exists("v", lambda x: F.abs(x) == float("inf"))
        r = side.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(unbounded).alias("unbounded"), F.count_if(F.col("v").isNull() | F.col(id_col).isNull()).alias("missing")).first()
        if r["low"] is None or r["unbounded"] or r["missing"]:
            return None
        sizes |= {r["low"], r["high"]}
        if len(sizes) > 1 or not 0 < r["low"] <= TREE_DIMS or not side.groupBy(id_col).count().where("count > 1").isEmpty():
            return None
    return sizes.pop()


def _tree_topk(queries: DataFrame, targets: DataFrame, k: int, dims: int, scratch: Scratch) -> DataFrame:
    """:func:`feature_topk` of (query, v) and (target, v), v of ``dims`` numbers; vectors with a NaN or null have no neighbours."""
    places = lambda df, name, p: df.select(name, *[F.get("v", F.lit(n)).alias(f"{p}{n}") for n in range(dims)]).where(" and ".join(f"not isnan({p}{n})" for n in range(dims)))
    tree = celltree.build(places(targets, "target", "t"), dims, max(32, 4 * k), k, scratch)
    if tree is None:
        return queries.select("query", F.col("query").alias("target"), F.lit(0.0).alias("distance2"), F.lit(0).alias("rank")).limit(0)
    met = celltree.nearest(tree, places(queries, "query", "q"), k, scratch)
    w = Window.partitionBy("query").orderBy("distance2", "target")
    return met.select("query", "target", F.col("d2").alias("distance2")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _slices(batches, rows: int):
    """(ids, matrix of vectors) of at most ``rows`` rows each."""
    import numpy as np

    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part.column(0).to_numpy(), np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)


def nearest_time(steps: DataFrame, t: float, time_col: str = "time", order: str = "step") -> DataFrame:
    """The row nearest to a time, the first on ties."""
    return steps.orderBy(F.abs(F.col(time_col) - t), order).limit(1)


def nearest_times(queries: DataFrame, steps: DataFrame, query_time: str, time_col: str = "time", order: str = "step") -> DataFrame:
    """Each query with the step nearest to its time, the least step on ties; a query without a time has none.

    The different times of queries and steps are cut into ``TIME_PARTS`` ranges of
    about as many steps.  Within a range the last step before and the first after a
    query are found by one sort each way; the ranges' own ends, a few numbers each,
    serve where a range holds no step on one side.
    """
    at = queries.select(F.col(query_time).cast("double").alias("_t")).where("_t is not null").distinct()
    known = steps.select(F.col(time_col).cast("double").alias("_t"), F.col(order).cast("long").alias("_o")).where("_t is not null").groupBy("_t").agg(F.min("_o").alias("_o"))
    cuts = sorted(set(known.approxQuantile("_t", [k / TIME_PARTS for k in range(1, TIME_PARTS)], 0.001)))
    part = sum(((F.col("_t") >= c).cast("int") for c in cuts), F.lit(0))
    ends = known.groupBy(part.alias("part")).agg(F.min("_t").alias("t0"), F.min_by("_o", "_t").alias("o0"), F.max("_t").alias("t1"), F.max_by("_o", "_t").alias("o1"))
    held = {r["part"]: r for r in ends.collect()}  # a row for each range
    carried, last = {}, None
    for p in range(len(cuts) + 1):
        carried[p] = [last, None]
        last = (held[p]["t1"], held[p]["o1"]) if p in held else last
    last = None
    for p in reversed(range(len(cuts) + 1)):
        carried[p][1] = last
        last = (held[p]["t0"], held[p]["o0"]) if p in held else last
    step = "struct<t:double,o:bigint>"
    ranges = queries.sparkSession.createDataFrame([(p, b, a) for p, (b, a) in carried.items()], f"part int, b0 {step}, a0 {step}")
    both = at.select("_t", F.lit(None).cast(step).alias("_s")).union(known.select("_t", F.struct(F.col("_t").alias("t"), F.col("_o").alias("o")))).withColumn("part", part)
    up = Window.partitionBy("part").orderBy("_t", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("part").orderBy(F.desc("_t"), F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.select("_t", "_s", "part", F.last("_s", True).over(up).alias("b"), F.last("_s", True).over(down).alias("a")).where("_s is null")
    near = near.join(F.broadcast(ranges), "part").select("_t", F.coalesce("b", "b0").alias("b"), F.coalesce("a", "a0").alias("a"))
    to_b, to_a = F.col("_t") - F.col("b.t"), F.col("a.t") - F.col("_t")
    pick = F.when(F.col("a").isNull() | (to_b < to_a), F.col("b.o")).when(F.col("b").isNull() | (to_a < to_b), F.col("a.o")).otherwise(F.least("b.o", "a.o"))
    found = near.select("_t", pick.alias(f"nearest_{order}"))
    return queries.join(found, F.col(query_time).cast("double") == F.col("_t"), "left").drop("_t")


def array_topk_distance(u, v):
    """The squared L2 distance of two array columns, for callers that pair rows themselves."""
    return array_l2(u, v)

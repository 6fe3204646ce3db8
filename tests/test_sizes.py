"""Queries of the shared tables where a side of a join, or of a comparison, has an unusual size."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarefield import demo
from rarefield.operators import assignment, neighbors
from rarefield.scratch import Scratch

PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def thresholds(spark):
    """The session's thresholds of broadcasts as Spark sets them, before and after."""
    for k in (PLANNED, MEASURED):
        spark.conf.unset(k)
    yield
    for k in (PLANNED, MEASURED):
        spark.conf.unset(k)


def planned_broadcasts(spark):
    """How often a table of two million rows, under 10 MB as Parquet, is broadcast in a join with itself."""
    rows = spark.range(2_000_000).select("id", (F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"))
    saved = Scratch(spark, "narrow").save(rows.repartitionByRange(4, "a", "b", "id").sortWithinPartitions("a", "b", "id").select("a", "b", F.floor(F.col("id") / 1000).alias("c")))
    joined = saved.join(saved.withColumnRenamed("c", "d"), ["a", "b"])
    return joined._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def points(spark, n=50):
    return spark.range(n).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(97)).cast("double").alias(a) for k, a in enumerate("xyz")])


def test_small_files_are_not_broadcast_unmeasured(spark, thresholds):
    """The fault: the files were small, the hash table in the driver was not."""
    assert planned_broadcasts(spark)
    assert neighbors.knn(points(spark), points(spark), 3).count() == 150
    assert not planned_broadcasts(spark)
    assert spark.conf.get(MEASURED) == "10485760b"


def test_matching_does_not_broadcast_unmeasured(spark, thresholds):
    edges = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 1.5)], "a long, b long, gain double")
    assert {(r["a"], r["b"]) for r in assignment.match(edges).collect()} == {(1, 2), (2, 1)}
    assert not planned_broadcasts(spark)


@pytest.mark.parametrize("name", ["nearest_neighbours", "density_clusters", "tracked_grains", "feature_topk"])
def test_queries_keep_the_threshold_for_measured_sides(spark, thresholds, name):
    spark.conf.set(PLANNED, "256k")
    demo.queries()[name](spark, "/root/testdata/sf0.001")
    assert (spark.conf.get(PLANNED), spark.conf.get(MEASURED)) == ("-1", "256k")


def test_nearest_attribute_keeps_the_threshold_for_measured_sides(spark, thresholds):
    """Its grains are a few MB of files at 60 times sf0.1, which filled the driver as hash tables."""
    demo.queries()["nearest_attribute"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(PLANNED) == "-1"
    assert not planned_broadcasts(spark)


def against_sql(spark, name, folder):
    sql = duckdb.connect()
    for f in os.listdir(folder):
        sql.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    got = sql.execute(demo.oracle_sql()[name])
    names = [c[0] for c in got.description]
    mine = demo.queries()[name](spark, str(folder)).select(*names).collect()
    return sorted(map(repr, map(tuple, mine))), sorted(map(repr, got.fetchall()))


@pytest.mark.parametrize("quantity, tax", [(20, 0.08), (40, 0.0), (40, 0.08)])
def test_shares_of_an_empty_region(spark, tmp_path, quantity, tax):
    """No cell is over the mean in one of the regions, as in large tables: SQL gives no number there."""
    rows = [(k % 7, k % 3, k % 2 + 1, float(quantity), 100.0, 0.05, tax) for k in range(60)]
    kinds = "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    mine, want = against_sql(spark, "region_overlap_metrics", tmp_path)
    assert mine == want


def test_nearest_vectors_hold_few_distances_at_once(spark):
    """The distances that a task holds don't grow with its batches; ties and far vectors as brute force has them."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(0, 1, (900, 3)), 1) + 1000.0
    v[:300] = v[0]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>").repartition(2)
    queries = rows.where("id % 20 = 0")
    want = {}
    for k in range(0, 900, 20):
        d = ((v - v[k]) ** 2).sum(axis=1)
        want[k] = [(int(j), d[j]) for j in np.lexsort((np.arange(900), d))[:5]]
    for pairs in (200, 1 << 20):
        got = {}
        for r in neighbors.feature_topk(queries, rows, 5, "v", pairs=pairs).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["target"], r["distance2"]))
        assert got == want
    parts = [len(t) for _, t in neighbors._slices([pa.record_batch([pa.array(range(50)), pa.array([[1.0, 2.0]] * 50)], ["id", "v"])], 8)]
    assert parts == [8] * 6 + [2]


@pytest.mark.parametrize("dims", [1, 3, 4])
def test_short_vectors_are_searched_in_a_tree(spark, monkeypatch, dims):
    """The nearest of short vectors took all pairs; the tree has the same rows, distances and ties, crowds and gaps included."""
    rng = np.random.default_rng(dims)
    v = np.concatenate([np.round(rng.normal(0, 3, (500, dims)), 1), rng.normal(50, 1e-4, (300, dims)), rng.uniform(-500, 900, (200, dims))])
    v[100:160] = v[100]
    lists = [*v.tolist(), [float("nan")] * dims, [None] * dims]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "id long, v array<double>").repartition(3)
    queries = rows.where("id % 5 = 0 or id > 998")
    want = sorted(map(tuple, neighbors.feature_topk(queries, rows, 7, "v").collect()))

    def all_pairs(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(neighbors, "_slices", all_pairs)
    monkeypatch.setattr(type(rows), "mapInArrow", all_pairs)
    got = sorted(map(tuple, neighbors.feature_topk(queries, rows, 7, "v", tree_pairs=0).collect()))
    assert got == want and len(got) == 7 * 201
    few = rows.where("id < 4")
    assert neighbors.feature_topk(few, few, 7, "v", tree_pairs=0).count() == 16
    assert neighbors.feature_topk(few.limit(0), few, 7, "v", tree_pairs=0).count() == 0


def test_vectors_that_a_tree_cannot_hold(spark):
    """Ids that repeat, infinite numbers, long vectors and vectors of different lengths."""
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "query long, v array<double>")
    fits = lambda more, kind="array<double>": neighbors._tree_dims(rows, rows.union(spark.createDataFrame(more, f"query long, v {kind}")).withColumnRenamed("query", "target"))
    assert fits([(9, [2.0, None]), (10, [float("nan"), 1.0])]) == 2
    assert fits([(8, [2.0, 1.0])]) is None and fits([(9, [float("inf"), 1.0])]) is None and fits([(9, [1.0])]) is None and fits([(9, None)]) is None
    assert neighbors._tree_dims(rows.select("query", F.array_repeat(F.lit(1.0), 5).alias("v")), rows.select(F.col("query").alias("target"), F.array_repeat(F.lit(1.0), 5).alias("v"))) is None


def test_small_components_are_dealt_by_their_edges(spark):
    """One task solved all small components, as their rows are few bytes."""
    n = 400
    rows = [(4 * k + i, 4 * k + j, float(1 + (7 * k + 3 * i + 5 * j) % 11)) for k in range(n) for i in (0, 1) for j in (0, 1)]
    edges = spark.createDataFrame(rows, "a long, b long, gain double")
    one = {tuple(r) for r in assignment.match(edges).collect()}
    many = assignment.match(edges, share=100)
    assert many.rdd.getNumPartitions() == 4 * n // 100 + 1
    assert {tuple(r) for r in many.collect()} == one
    gain = {(a, b): g for a, b, g in rows}
    for k in range(n):
        mine = sum(g for a, _, g in one if a // 4 == k)
        straight, crossed = ([gain[4 * k + i, 4 * k + (i ^ x)] for i in (0, 1)] for x in (0, 1))
        assert mine == max(sum(straight), sum(crossed))


def test_targets_beyond_a_distance_spare_their_balls(spark):
    """The nearest within a distance are as those of the whole join, and a far query meets no cell."""
    p, far = points(spark, 60), points(spark, 40).withColumn("x", F.col("x") + 90)
    whole = neighbors.knn(far, p, 4).where("distance <= 30")
    near = neighbors.knn(far, p, 4, within=30.0).where("distance <= 30")
    rows = sorted(map(tuple, near.collect()))
    assert rows and rows == sorted(map(tuple, whole.collect()))
    assert neighbors.knn(far.withColumn("x", F.col("x") + 900), p, 4, within=30.0).count() == 0

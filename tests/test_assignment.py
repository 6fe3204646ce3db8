"""The auction of giant components against the exact matching."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefield.operators import assignment
from rarefield.scratch import Scratch

EDGES = "a long, b long, gain double"


def instance(seed, n, m, degree, whole):
    rnd = random.Random(seed)
    edges = {}
    for a in range(n):
        for b in rnd.sample(range(m), degree):
            edges[a, b] = float(rnd.randint(1, 30)) if whole else rnd.random() + 1e-6
    for a in range(n):  # one component
        edges.setdefault((a, a % m), 1e-6 if not whole else 1.0)
        edges.setdefault((a, (a + 1) % m), 1e-6 if not whole else 1.0)
    return [(a, b, g) for (a, b), g in sorted(edges.items())]


def best_total(edges):
    a, b, g = (np.array(x) for x in zip(*edges, strict=True))
    return g[assignment.best_matching(a, b, g)].sum()


def is_matching(rows, edges):
    assert len({r["a"] for r in rows}) == len(rows) == len({r["b"] for r in rows})
    assert {(r["a"], r["b"], r["gain"]) for r in rows} <= set(edges)


def test_auction_is_within_its_bound(spark):
    edges = instance(2, 90, 60, 5, False)
    rows = assignment.match(spark.createDataFrame(edges, EDGES), large=20, tolerance=1e-3).collect()
    is_matching(rows, edges)
    total = sum(r["gain"] for r in rows)
    assert best_total(edges) - len(rows) * 1e-3 <= total <= best_total(edges) + 1e-9


def test_auction_of_whole_gains_is_exact(spark):
    edges = instance(3, 24, 24, 3, True)
    rows = assignment.auction(spark.createDataFrame(edges, EDGES), 1 / 25, Scratch(spark, "t"), bidders=60).collect()
    is_matching(rows, edges)
    assert sum(r["gain"] for r in rows) == best_total(edges)


def test_giant_and_small_components_together(spark):
    edges = instance(4, 30, 30, 3, True) + [(1000 + k, 2000 + k, 2.0) for k in range(5)] + [(1000, 2001, 9.0), (5000, 6000, -1.0)]
    rows = assignment.match(spark.createDataFrame(edges, EDGES), large=50, tolerance=1e-4).collect()
    is_matching(rows, edges)
    assert sum(r["gain"] for r in rows) == pytest.approx(best_total([e for e in edges if e[2] > 0]), abs=1e-4 * 30 * 31)
    assert {(r["a"], r["b"]) for r in rows if r["a"] >= 1000} == {(1000, 2001), *((1000 + k, 2000 + k) for k in (2, 3, 4))}


def test_bidders_of_one_group_outbid_each_other():
    got = assignment.bids(np.array([1, 2, 3]), np.array([7, 7, 7]), np.array([5.0, 3.0, 1.0]), np.array([0.0, 0.0, 0.0]), 0.01)
    assert {(w, j) for w, j, _, _ in got} == {(1, 7), (2, None), (3, None)}
    (bid,) = [p for w, _, p, _ in got if w == 1]
    assert 3.0 <= bid <= 5.01


def test_one_component_of_many_edges(spark):
    """No group of bidders holds more than a few thousand edges; the pairs are a matching that hardly any edge could better."""
    n = 15_000
    ids = spark.range(n)
    edges = ids.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("a", F.pmod(F.when(F.col("k") == 0, F.col("a")).when(F.col("k") == 1, F.col("a") + 1).otherwise(F.xxhash64("a", "k")), F.lit(n)).alias("b"), (F.pmod(F.xxhash64("k", "a"), F.lit(1000)) / 1000 + 0.001).alias("gain"))
    edges = edges.groupBy("a", "b").agg(F.max("gain").alias("gain"))
    got = assignment.auction(edges, 0.02, Scratch(spark, "t"), bidders=8_000)
    rows = got.agg(F.count("*").alias("n"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.sum("gain").alias("g")).first()
    assert rows["n"] == rows["na"] == rows["nb"] > 0.9 * n
    assert got.join(edges, ["a", "b", "gain"], "left_anti").isEmpty()
    greedy = edges.groupBy("a").agg(F.max("gain").alias("g")).agg(F.sum("g")).first()[0]
    assert rows["g"] > 0.85 * greedy  # an upper bound

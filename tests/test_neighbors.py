"""Nearest neighbours on uneven points against brute force, and the cells' bound."""

import time

import numpy as np
from pyspark.sql import functions as F

from rarefield.operators import celltree, neighbors
from rarefield.scratch import Scratch


def frame(spark, points):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(points)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]})).repartition(4)


def brute(queries, targets, k, exclude):
    """(query, target, distance) lists, ties to the smaller id."""
    out = {}
    for i, p in enumerate(queries):
        d = np.sqrt(((targets - p) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(d)), d)) if not (exclude and j == i)][:k]
        out[i] = [(int(j), float(d[j])) for j in order]
    return out


def found(frame_):
    out = {}
    for r in frame_.collect():
        out.setdefault(r["query"], []).append((r["rank"], r["target"], r["distance"]))
    return {q: [(t, d) for _, t, d in sorted(v)] for q, v in out.items()}


def agree(got, want):
    assert set(got) == {q for q, w in want.items() if w}
    for q, w in want.items():
        assert [t for t, _ in got.get(q, [])] == [t for t, _ in w], q
        assert np.allclose([d for _, d in got.get(q, [])], [d for _, d in w])


def uneven(n, seed=3):
    """Half of the points in a spot a millionth of the extent wide, a lattice with ties, one far point."""
    rng = np.random.default_rng(seed)
    spot = 0.3 + rng.random((n // 2, 3)) * 1e-6
    grid = np.stack(np.meshgrid(*[np.arange(5) / 4] * 3), -1).reshape(-1, 3)
    rest = rng.random((n - n // 2 - len(grid) - 1, 3))
    return np.concatenate([spot, grid, rest, [[40.0, -9.0, 3.0]]])


def test_uneven_points_against_brute_force(spark):
    points = uneven(700)
    got = found(neighbors.knn(frame(spark, points), frame(spark, points), 7, exclude_self=True, cap=12))
    agree(got, brute(points, points, 7, True))


def test_other_queries_few_targets_and_equal_places(spark):
    rng = np.random.default_rng(5)
    targets = np.concatenate([np.tile([[1.0, 2.0, 3.0]], (60, 1)), rng.random((9, 3))])
    queries = np.concatenate([rng.normal(0, 5, (40, 3)), [[1.0, 2.0, 3.0], [1e6, 0, 0]]])
    agree(found(neighbors.knn(frame(spark, queries), frame(spark, targets), 5, cap=4)), brute(queries, targets, 5, False))
    agree(found(neighbors.knn(frame(spark, queries), frame(spark, targets[:3]), 5)), brute(queries, targets[:3], 5, False))
    flat = frame(spark, queries).withColumn("z", F.lit(0.0)).unionByName(spark.createDataFrame([(900, None, 1.0, 1.0), (901, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double"))
    assert {r["query"] for r in neighbors.knn(flat, flat, 2, exclude_self=True).collect()} == set(range(len(queries)))
    assert neighbors.knn(flat, flat.limit(0), 2).count() == 0


def test_two_hundred_thousand_uneven_points(spark):
    """No cell over its cap, exact for a sample of queries, in time that follows the number of points."""
    points = uneven(200_000, seed=7)
    table = frame(spark, points)
    began = time.time()
    got = neighbors.knn(table, table, 4, exclude_self=True)
    assert got.count() == 4 * len(points)
    assert time.time() - began < 300
    some = np.random.default_rng(1).choice(len(points), 60, replace=False)
    mine = found(got.where(F.col("query").isin(some.tolist())))
    for q in some.tolist():
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(d)), d))[:6] if j != q][:4]
        assert [t for t, _ in mine[q]] == order
    t = table.select(F.col("id").alias("target"), *[F.col(a).alias(f"t{n}") for n, a in enumerate("xyz")])
    tree = celltree.build(t, 3, 32, 5, Scratch(spark, "t"))
    assert tree.targets.groupBy(*tree.key).count().agg(F.max("count")).first()[0] <= 32

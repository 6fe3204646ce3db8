"""DBSCAN by cells against plain Python, and a place of very many points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefield.operators import density


def plain(points, eps, min_samples):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=-1))
    near = d <= eps
    core = near.sum(axis=1) >= min_samples
    root = list(range(len(points)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in np.flatnonzero(core):
        for b in np.flatnonzero(core & near[a]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    numbers = {r: k for k, r in enumerate(sorted({find(a) for a in np.flatnonzero(core)}))}
    out = []
    for i in range(len(points)):
        own = np.flatnonzero(core & near[i])
        out.append(numbers[find(i)] if core[i] else numbers[find(own[np.lexsort((own, d[i, own]))][0])] if len(own) else -1)
    return out


def frame(spark, points):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "id long, " + ", ".join(f"f{n} double" for n in range(points.shape[1])))


def labels(found, n):
    got = {r["id"]: r["label"] for r in found.collect()}
    return [got[k] for k in range(n)]


@pytest.mark.parametrize(("dims", "eps", "min_samples"), [(2, 0.07, 4), (3, 0.16, 5)])
def test_labels_equal_plain_python(spark, dims, eps, min_samples):
    rng = np.random.default_rng(dims)
    points = np.concatenate([rng.random((250, dims)), 0.5 + rng.normal(0, 0.02, (60, dims)), np.tile(rng.random((1, dims)), (6, 1))])
    features = [f"f{n}" for n in range(dims)]
    assert labels(density.dbscan(frame(spark, points), eps, min_samples, features), len(points)) == plain(points, eps, min_samples)


def test_two_crowds_a_little_more_or_less_than_eps_apart(spark):
    """Cells whose boxes and outermost points leave it open: only inner points come within eps."""
    rng = np.random.default_rng(4)
    left = np.stack([-rng.random(40) ** 2 * 0.3, rng.random(40)], axis=1)
    right = np.stack([0.55 + rng.random(40) ** 2 * 0.3, rng.random(40)], axis=1)
    for extra in ([], [[0.05, 0.5], [0.549, 0.52]]):
        points = np.concatenate([left, right, np.array(extra).reshape(-1, 2)])
        assert labels(density.dbscan(frame(spark, points), 0.5, 3, ["f0", "f1"]), len(points)) == plain(points, 0.5, 3)


def test_line_no_radius_and_single_points(spark):
    line = np.array([[0.0], [0.5], [1.0], [1.5], [4.0], [4.0], [9.0]])
    assert labels(density.dbscan(frame(spark, line), 0.5, 2, ["f0"]), 7) == plain(line, 0.5, 2)
    assert labels(density.dbscan(frame(spark, line), 0.0, 2, ["f0"]), 7) == [-1, -1, -1, -1, 0, 0, -1]
    assert labels(density.dbscan(frame(spark, line), 0.5, 1, ["f0"]), 7) == plain(line, 0.5, 1)
    assert density.dbscan(frame(spark, line).limit(0), 0.5, 2, ["f0"]).count() == 0


def test_a_hundred_thousand_points_in_one_place(spark):
    """One crowd, a bridge of single points to a second crowd, and noise."""
    crowd = spark.range(100_000).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000).alias(f"f{k}") for k in range(2)])
    bridge = [(200_000 + k, 1.0 + 0.8 * (k + 1), 0.5) for k in range(5)]
    other = [(300_000 + k, 5.6 + k * 0.01, 0.5) for k in range(20)]
    lost = [(400_000, -3.0, 9.0)]
    table = crowd.unionByName(spark.createDataFrame(bridge + other + lost, "id long, f0 double, f1 double"))
    got = {r["label"]: r["count"] for r in density.dbscan(table, 1.0, 3, ["f0", "f1"]).groupBy("label").count().collect()}
    assert got == {0: 100_025, -1: 1}

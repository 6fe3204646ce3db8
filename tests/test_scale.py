import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefield.operators import assignment, components, neighbors, voxels


def test_nearest_times_at_scale(spark):
    began = time.time()
    q = spark.range(100_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 7).alias("t"))
    s = spark.range(30_000).select(F.col("id").alias("step"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60_000)) / 9).alias("time"))
    got = neighbors.nearest_times(q, s, "t").toPandas().sort_values("id")
    steps = s.toPandas()
    first = steps.groupby("time")["step"].min()
    times, number = first.index.to_numpy(), first.to_numpy()
    at = got["t"].to_numpy()
    right = np.searchsorted(times, at)
    lo, hi = np.maximum(right - 1, 0), np.minimum(right, len(times) - 1)
    dl, dh = np.abs(at - times[lo]), np.abs(at - times[hi])
    want = np.where(dl < dh, number[lo], np.where(dh < dl, number[hi], np.minimum(number[lo], number[hi])))
    assert (got["nearest_step"].to_numpy() == want).all()
    assert time.time() - began < 120


def test_nearest_times_of_nulls_and_empty_tables(spark):
    q = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, -9.0)], "id long, t double")
    s = spark.createDataFrame([(4, 6.0), (3, 4.0), (9, 4.0)], "step long, time double")
    assert {r["id"]: r["nearest_step"] for r in neighbors.nearest_times(q, s, "t").collect()} == {1: None, 2: 3, 3: 3, 4: 3}
    assert {r["nearest_step"] for r in neighbors.nearest_times(q, s.limit(0), "t").collect()} == {None}


def test_neighbours_of_far_points(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.uniform(0, 1, (300, 3)), rng.uniform(0, 1e6, (5, 3)), np.zeros((3, 3))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double, z double")
    got = {}
    for r in neighbors.knn(df, df, 4, exclude_self=True).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["target"]))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:4]
        assert [t for _, t in sorted(got[i])] == want


def test_matching_against_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(80):
        n, m = rng.integers(1, 5, 2)
        edges = [(int(a), int(b), float(rng.normal() + 0.5)) for a in range(n) for b in range(m) if rng.random() < 0.7]
        edges = [e for e in edges if e[2] > 0]
        if not edges:
            continue
        best = 0.0
        for k in range(1, min(n, m) + 1):
            for pick in itertools.combinations(edges, k):
                if len({e[0] for e in pick}) == k == len({e[1] for e in pick}):
                    best = max(best, sum(e[2] for e in pick))
        a, b, g = (np.array(c) for c in zip(*edges, strict=True))
        keep = assignment.best_matching(a, b, g)
        assert len(set(a[keep])) == len(keep) == len(set(b[keep]))
        assert g[keep].sum() == pytest.approx(best)


def test_matching_of_a_large_component(spark):
    n = 20_000  # a chain: one component, far too large for a matrix
    rows = [(i, i, 1.0 + (i % 7) / 10) for i in range(n)] + [(i, i + 1, 1.05) for i in range(n - 1)]
    edges = spark.createDataFrame(rows, "a long, b long, gain double")
    got = assignment.match(edges).agg(F.count("*").alias("n"), F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b"), F.sum("gain").alias("g")).first()
    best_free, best_held = 0.0, float("-inf")  # by whether b = i is taken by the pair (i - 1, i)
    for i in range(n):
        free, held = best_free, best_held
        stay, own, ahead = max(free, held), free + rows[i][2], max(free, held) + 1.05 if i + 1 < n else float("-inf")
        best_free, best_held = max(stay, own), ahead
    assert got["g"] == pytest.approx(max(best_free, best_held)) and got["a"] == got["b"] == got["n"]


def small_segments_by_hand(voxels_of, min_size):
    """Voxel by voxel: small segments in order, each to the neighbour it touches most by then."""
    now = dict(voxels_of)
    sizes = {}
    for s in now.values():
        sizes[s] = sizes.get(s, 0) + 1
    for s in sorted(k for k, n in sizes.items() if k > 0 and n < min_size):
        mine = [v for v, t in now.items() if t == s and voxels_of[v] == s or t == s]
        touch = {}
        for x, y, z in mine:
            for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                t = now.get((x + d[0], y + d[1], z + d[2]))
                if t is not None and t > 0 and t != s:
                    touch[t] = touch.get(t, 0) + 1
        to = min(touch, key=lambda t: (-touch[t], t)) if touch else -1
        for v in mine:
            now[v] = to
    return now


def test_small_segments_against_a_voxel_loop(spark):
    rng = np.random.default_rng(11)
    field = {(x, y, 0): int(s) for (x, y), s in np.ndenumerate(rng.integers(0, 9, (9, 9)) + 9 * rng.integers(0, 2, (9, 9)))}
    rows = [(i, x, y, z, 1 if s else 0, s) for i, ((x, y, z), s) in enumerate(field.items())]
    df = spark.createDataFrame(rows, "id long, ix long, iy long, iz long, phase int, segment long")
    got = {(r["ix"], r["iy"], r["iz"]): r["segment"] for r in voxels.remove_small(df, 4).collect()}
    assert got == small_segments_by_hand(field, 4)
    assert voxels.remove_small(df, 1).count() == len(rows)


def test_components_extended_by_new_edges(spark):
    rng = np.random.default_rng(3)
    old = [(int(a), int(b)) for a, b in rng.integers(0, 120, (50, 2)) if a != b]
    new = [(int(a), int(b)) for a, b in rng.integers(0, 160, (50, 2))] + old[:5] + [(300, 300)]

    def by_hand(edges):
        root = {n: n for e in edges if e[0] != e[1] for n in e}
        for _ in root:
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        return root

    def frame(edges):
        return spark.createDataFrame(edges, "a long, b long")

    comps = components.connected_components(frame(old))
    assert {r["node"]: r["component"] for r in comps.collect()} == by_hand(old)
    for edges in (new, old, []):
        rows = components.extend_components(comps, frame(edges)).collect()
        assert len({r["node"] for r in rows}) == len(rows)
        assert {r["node"]: r["component"] for r in rows} == by_hand(old + edges)
    rows = components.extend_components(components.connected_components(frame([])), frame(new)).collect()
    assert {r["node"]: r["component"] for r in rows} == by_hand(new)

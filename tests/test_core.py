import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefield.functions import orientation as rot
from rarefield.functions import regions, similarity
from rarefield.operators import assignment, clusters, components, density, graph, lattice, neighbors, voxels
from rarefield.plans import region_comparison


def cube(spark, n, at=0):
    rows = [(i + at, j + at, k + at) for i in range(n) for j in range(n) for k in range(n)]
    df = spark.createDataFrame(rows, "ix long, iy long, iz long")
    return df.withColumn("id", F.col("ix") + 100 * F.col("iy") + 10000 * F.col("iz"))


def test_lattice_edge_counts(spark):
    nodes = cube(spark, 8)
    for r, n in ((1, 1344), (2, 4848)):
        assert lattice.grid_edges(nodes, r).count() == n


def test_overlap_of_cubes(spark):
    a = cube(spark, 10).select(F.col("ix").alias("fx"), F.col("iy").alias("fy"), F.col("iz").alias("fz"), F.lit(1).alias("cluster"))
    b = cube(spark, 10, 5).select(F.col("ix").alias("fx"), F.col("iy").alias("fy"), F.col("iz").alias("fz"), F.lit(2).alias("cluster"))
    m = region_comparison.overlap_metrics(region_comparison.membership(a, b)).first()
    assert m["n_intersection"] == 125 and m["iou"] == pytest.approx(125 / 1875)


def test_empty_clouds_have_no_overlap(spark):
    none = spark.createDataFrame([], "fx long, fy long, fz long, cluster int")
    m = region_comparison.overlap_metrics(region_comparison.membership(none, none)).first()
    assert m["n_union"] == 0 and m["iou"] == 0 and m["dice"] == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}


def test_assignment_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        c = rng.normal(size=(n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert sum(c[i, j] for i, j in enumerate(assignment.solve(c))) == pytest.approx(best)


def test_unmatched_costs(spark):
    edges = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.1), (2, 11, 0.3), (3, 12, 1.5)], "a long, b long, cost double")
    got = sorted((r["a"], r["b"]) for r in assignment.assign(edges, 1.0).collect())
    assert got == [(1, 10), (2, 11)]


def test_orientations(spark):
    rows = [((0.0, 0.0, 0.0), (90.0, 0.0, 0.0), "bunge", 0.0), ((0.0, 0.0, 0.0), (5.0, 0.0, 0.0), "bunge", 5.0), ((10.0, 20.0, 30.0), (40.0, 50.0, 60.0), "kocks", 34.0825658575), ((0.0, 0.0, 0.0), (45.0, 45.0, 0.0), "kocks", 62.7994296198)]
    one = spark.range(1)
    for a, b, convention, angle in rows:
        m = [rot.euler_to_matrix(*map(F.lit, e), convention=convention) for e in (a, b)]
        got = one.select(m[0].alias("a"), m[1].alias("b")).select(rot.misorientation("a", "b")).first()[0]
        assert got == pytest.approx(angle, abs=1e-5)
    back = one.select(rot.matrix_to_euler(rot.euler_to_matrix(F.lit(10.0), F.lit(20.0), F.lit(30.0)))).first()[0]
    assert back == pytest.approx([10, 20, 30])


def test_identity_tensor_norm(spark):
    nine = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    d = similarity.frobenius_difference([F.lit(float(x)) for x in nine], [F.lit(0.0)] * 9)
    assert spark.range(1).select(d).first()[0] == pytest.approx(math.sqrt(3))


def test_rules_are_complete(spark):
    assert regions.match_rules(spark).count() == 36 and regions.unmatched_rules(spark).count() == 12


def test_prune_keeps_the_union_of_both_ends(spark):
    rng = np.random.default_rng(2)
    edges = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 20, (80, 2)) if p[0] != p[1]})
    w = rng.permutation(len(edges)).tolist()
    df = spark.createDataFrame([(a, b, float(x)) for (a, b), x in zip(edges, w)], "src long, dst long, weight double")
    want = set()
    for v in range(20):
        mine = sorted(((x, e) for e, x in zip(edges, w) if v in e), reverse=True)[:3]
        want |= {e for _, e in mine}
    assert {(r["src"], r["dst"]) for r in graph.topk_prune(df, 3).collect()} == want


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, (40, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double, z double")
    got = {}
    for r in neighbors.knn(df, df, 3, exclude_self=True).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["target"]))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(40):
        assert [t for _, t in sorted(got[i])] == np.argsort(d[i])[:3].tolist()


def test_dbscan_and_linkage(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 0.2), (3, 5.0), (4, 5.1), (5, 9.0)], "id long, x double")
    got = {r["id"]: r["label"] for r in density.dbscan(df, 0.15, 2, ["x"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: -1}
    cut = {r["id"]: r["label"] for r in density.hierarchical(df, ["x"], criterion="maxclust", threshold=3).collect()}
    assert cut == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}


def test_smallest_clusters(spark):
    c = spark.createDataFrame([(0, 5), (1, 20), (2, 1)], "cluster_label long, n long")
    assert [r["cluster_label"] for r in clusters.smallest(1)(c).collect()] == [2]


def test_infill_takes_the_first_filled_neighbour(spark):
    v = cube(spark, 2).withColumn("segment", F.when(F.col("ix") == 0, 7).otherwise(-1))
    assert {r["segment"] for r in voxels.infill(v).collect()} == {7}

"""Leiden and Louvain on graphs with known communities."""

import random

import pytest

from rarefield.operators import community

EDGES = "src long, dst long, weight double"


def planted(seed, groups=6, size=14, inside=0.5, between=0.02):
    rnd = random.Random(seed)
    n = groups * size
    edges = [(a, b, rnd.uniform(0.5, 1.5)) for a in range(n) for b in range(a) if rnd.random() < (inside if a % groups == b % groups else between)]
    return n, edges


def frames(spark, n, edges):
    return spark.range(n).coalesce(2), spark.createDataFrame(edges, EDGES)


def plain_modularity(labels, edges, gamma=1.0):
    total = 2 * sum(w for _, _, w in edges)
    degree, inside = {}, 0.0
    for a, b, w in edges:
        degree[labels[a]] = degree.get(labels[a], 0) + w
        degree[labels[b]] = degree.get(labels[b], 0) + w
        inside += 2 * w * (labels[a] == labels[b])
    return inside / total - gamma * sum(d * d for d in degree.values()) / total**2


def connected(members, edges):
    seen, todo = set(), [min(members)]
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [y for y in near.get(x, []) if y in members]
    return seen == members


def labels_of(frame):
    return {r["id"]: r["label"] for r in frame.collect()}


def test_planted_communities_are_found(spark):
    n, edges = planted(1, groups=4, size=12)
    nodes, table = frames(spark, n, edges)
    got = labels_of(community.segment(nodes, table, "leiden"))
    assert len(got) == n
    groups = {}
    for i, label in got.items():
        groups.setdefault(label, set()).add(i % 4)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    assert community.modularity(spark.createDataFrame(list(got.items()), "id long, label long"), table) == pytest.approx(plain_modularity(got, edges))


def test_leiden_is_connected_and_no_worse_than_louvain(spark):
    """Blurred communities, weak ties between them, and a node without edges."""
    gamma = 1.0
    n, edges = planted(4, groups=4, size=12, inside=0.25, between=0.05)
    nodes, table = frames(spark, n + 1, edges)
    one, other = (labels_of(f(nodes, table, gamma)) for f in (community.leiden, community.louvain))
    assert set(one) == set(other) == set(range(n + 1)) and list(one.values()).count(one[n]) == 1
    assert plain_modularity(one, edges, gamma) >= plain_modularity(other, edges, gamma) - 1e-9
    for label in set(one.values()):
        assert connected({i for i, x in one.items() if x == label}, edges)


def test_a_bridge_that_leaves_splits_its_community(spark):
    """Two cliques that only a third one's node joins must not stay one community."""
    clique = lambda at: [(a, b, 1.0) for a in range(at, at + 5) for b in range(at, a)]
    edges = clique(0) + clique(10) + clique(20) + [(0, 20, 0.3), (10, 20, 0.3)]
    _, table = frames(spark, 25, edges)
    nodes = spark.createDataFrame([(k,) for at in (0, 10, 20) for k in range(at, at + 5)], "id long")
    got = labels_of(community.leiden(nodes, table))
    assert [len({got[k] for k in range(at, at + 5)}) for at in (0, 10, 20)] == [1, 1, 1]
    assert len({got[0], got[10], got[20]}) == 3


def test_refined_parts_lie_within_communities_and_are_connected(spark):
    from rarefield.scratch import Scratch

    n, edges = planted(9, groups=4, size=12, inside=0.3, between=0.1)
    _, table = frames(spark, n, edges)
    coarse = spark.range(n).selectExpr("id AS u", "CAST(id % 3 AS long) AS label")
    parts = {r["u"]: r["label"] for r in community._refined(community._half(table), coarse, 1.0, 20, Scratch(spark, "t")).collect()}
    assert len(parts) == n and len(set(parts.values())) < n
    for label in set(parts.values()):
        members = {i for i, x in parts.items() if x == label}
        assert len({i % 3 for i in members}) == 1 and connected(members, edges)


def test_communities_without_edges(spark):
    nodes = spark.range(4)
    got = labels_of(community.segment(nodes, spark.createDataFrame([], EDGES), "leiden"))
    assert len(set(got.values())) == 4

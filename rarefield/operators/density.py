"""DBSCAN over neighbour pairs, and small-table methods: linkage, agglomerative, OPTICS.

The small-table methods need all pairwise distances of one table of clusters; they
run in a single task behind ``MAX_ROWS``, which is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.operators.components import connected_components, label_nodes
from rarefield.operators.lattice import offsets
from rarefield.operators.neighbors import cell_size, knn
from rarefield.operators.ranking import numbered
from rarefield.scratch import Scratch

MAX_ROWS = 5000


def radius_pairs(points: DataFrame, eps: float, features: Sequence[str], id_col: str = "id") -> DataFrame:
    """(a, b, distance), a != b, of points at most ``eps`` apart: bins of side eps on up to three features, then the exact test."""
    from itertools import product

    used = list(features)[:3]
    own = points.select(F.col(id_col).alias("a"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])
    cell = lambda k: F.floor(F.col(f"x{k}") / eps).cast("long")
    here = own.select("*", *[cell(k).alias(f"c{k}") for k in range(len(used))])
    around = F.array(*[F.array(*[F.lit(v) for v in d]) for d in product((-1, 0, 1), repeat=len(used))])
    asked = here.select("*", F.explode(around).alias("_d"))
    asked = asked.select("a", *[F.col(f"x{k}") for k in range(len(features))], *[(F.col(f"c{k}") + F.get("_d", F.lit(k))).alias(f"c{k}") for k in range(len(used))])
    there = here.select(F.col("a").alias("b"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(len(features))], *[f"c{k}" for k in range(len(used))])
    d2 = sum(((F.col(f"x{k}") - F.col(f"y{k}")) ** 2 for k in range(len(features))), F.lit(0.0))
    met = asked.join(there, [f"c{k}" for k in range(len(used))]).where("a != b").select("a", "b", F.sqrt(d2).alias("distance"))
    return met.where(F.col("distance") <= eps)


def _by_cells(points: DataFrame, eps: float, min_samples: int, features: Sequence[str], id_col: str) -> DataFrame:
    """DBSCAN over cells whose diagonal is ``eps``, after Gan and Tao, 2015; exact.

    Points of one cell are within eps of each other.  So all points of a cell of
    ``min_samples`` or more are core points; others ask for their neighbours one by one
    (a nearest-neighbour join over a tree, so a crowded cell next door costs no more than
    its ``min_samples`` nearest).  Core points of one cell are one node of the graph.
    Two cells are linked if the farthest corners of their boxes, or two of their
    outermost points, are within eps; pairs that this leaves open, and that are not
    connected by others, are decided by the points that lie near the other's box.
    """
    spark, dims = points.sparkSession, range(len(features))
    scratch = Scratch(spark, "dbscan")
    side = eps / len(features) ** 0.5 * (1 - 1e-9)
    x = [f"x{n}" for n in dims]
    c = [f"c{n}" for n in dims]
    own = points.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(x[n]) for n, f in enumerate(features)])
    # without a radius only equal points meet
    place = [(F.floor(F.col(a) / side) if eps > 0 else F.xxhash64(a)).cast("long").alias(c[n]) for n, a in enumerate(x)]
    own = scratch.save(own.select("id", *x, *place), "points")
    crowded = own.groupBy(*c).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(*c)
    inner = own.join(crowded, c, "left_semi")
    lone = scratch.save(own.join(crowded, c, "left_anti"), "lone")
    core = inner
    if min_samples > 1 and eps > 0 and not lone.isEmpty():
        reach = knn(lone, own, min_samples - 1, x, "id", "id", exclude_self=True)
        enough = reach.where((F.col("rank") == min_samples - 1) & (F.col("distance") <= eps)).select(F.col("query").alias("id"))
        core = inner.unionByName(lone.join(enough, "id", "left_semi"))
    core = scratch.save(core, "core")
    ends = [f(F.struct(*x), a).alias(f"{p}{n}") for n, a in enumerate(x) for p, f in (("low", F.min_by), ("high", F.max_by))]
    boxes = [f(a).alias(f"{p}{n}") for n, a in enumerate(x) for p, f in (("lo", F.min), ("hi", F.max))]
    extremes = F.array(*[f"{p}{n}" for n in dims for p in ("low", "high")]).alias("ends")
    sums = core.groupBy(*c).agg(F.min("id").alias("cell"), *boxes, *ends)
    cells = scratch.save(sums.select(*c, "cell", *[f"{p}{n}" for n in dims for p in ("lo", "hi")], extremes), "cells")
    links = spark.createDataFrame([], "a long, b long")
    if eps > 0:
        links = _cell_links(core, cells, eps, c, x, scratch)
    comps = label_nodes(cells, links, scratch, "cell").select(F.col("node").alias("cell"), F.col("component").alias("root"))
    numbers = numbered(comps.select("root").distinct(), ["root"], "label", 0, scratch)
    of_cell = cells.select(*c, "cell").join(comps.join(numbers, "root"), "cell").select(*c, "label")
    labelled = scratch.save(core.join(of_cell, c).select("id", "label"), "labels")
    rest = own.join(labelled, "id", "left_anti")
    border = spark.createDataFrame([], "id long, label long")
    if eps > 0 and not labelled.isEmpty():
        near = knn(rest, core, 1, x, "id", "id").where(F.col("distance") <= eps)
        border = near.join(labelled.withColumnRenamed("id", "target"), "target").select(F.col("query").alias("id"), "label")
    found = labelled.unionByName(border)
    return points.select(F.col(id_col).alias("id")).join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def _cell_links(core: DataFrame, cells: DataFrame, eps: float, c: list[str], x: list[str], scratch: Scratch) -> DataFrame:
    """(a, b) of cells that hold core points within ``eps`` of each other, or are connected by others that do."""
    dims, e2 = range(len(c)), eps * eps
    around = F.array(*[F.array(*[F.lit(v) for v in d]) for d in offsets(2, True, "chebyshev", len(c))])
    shifted = cells.select("*", F.explode(around).alias("_d"))
    names = [f"{p}{n}" for n in dims for p in ("lo", "hi")]
    asked = shifted.select(F.col("cell").alias("a"), F.col("ends").alias("ea"), *[F.col(n).alias(f"a{n}") for n in names], *[(F.col(c[n]) + F.get("_d", F.lit(n))).alias(c[n]) for n in dims])
    met = asked.join(cells.select(F.col("cell").alias("b"), F.col("ends").alias("eb"), *c, *names), c)
    gap = [F.greatest(F.col(f"alo{n}") - F.col(f"hi{n}"), F.col(f"lo{n}") - F.col(f"ahi{n}"), F.lit(0.0)) for n in dims]
    span = [F.greatest(F.col(f"ahi{n}") - F.col(f"lo{n}"), F.col(f"hi{n}") - F.col(f"alo{n}")) for n in dims]
    square = lambda parts: sum((p * p for p in parts), F.lit(0.0))
    apart = lambda p, q: square([p[k] - q[k] for k in x])
    close = F.exists("ea", lambda p: F.exists("eb", lambda q: apart(p, q) <= e2))
    tested = scratch.save(met.where(square(gap) <= e2).select("a", "b", (square(span) <= e2).alias("all"), close.alias("some")), "tested")
    sure = tested.where("all or some").select("a", "b")
    comps = scratch.save(label_nodes(cells, sure, scratch, "cell"), "sure")
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"g{side}"))
    open_ = scratch.save(tested.where("not all and not some").select("a", "b").join(of("a"), "a").join(of("b"), "b").where("ga != gb").select("a", "b"), "open")
    if open_.isEmpty():
        return sure
    # of each cell the points near the other's box
    owned = core.join(cells.select(*c, "cell"), c).select("cell", *x)
    box = cells.select("cell", *names)

    def near(side: str, other: str) -> DataFrame:
        wanted = open_.join(box.withColumnRenamed("cell", other), other)
        out = owned.withColumnRenamed("cell", side).join(wanted, side)
        away = [F.greatest(F.col(f"lo{n}") - F.col(x[n]), F.col(x[n]) - F.col(f"hi{n}"), F.lit(0.0)) for n in dims]
        return out.where(square(away) <= e2).select("a", "b", *[F.col(v).alias(f"{side}{v}") for v in x])

    pairs = near("a", "b").join(near("b", "a"), ["a", "b"])
    met_points = pairs.where(square([F.col(f"a{v}") - F.col(f"b{v}") for v in x]) <= e2)
    return scratch.save(sure.union(met_points.select("a", "b").distinct()), "links")


def dbscan(points: DataFrame, eps: float, min_samples: int, features: Sequence[str], id_col: str = "id", pairs: DataFrame | None = None) -> DataFrame:
    """(id, label): clusters numbered by their smallest core point, -1 for noise.

    A core point has ``min_samples`` points within eps, itself counted.  Core points
    within eps of each other are one cluster; other points join the cluster of
    their nearest core point, the smallest id on ties.  ``pairs`` (a, b, distance)
    may come from any metric; without them, up to three features go by cells
    (:func:`_by_cells`), so crowded places cost no pairs.
    """
    if pairs is None and len(features) <= 3:
        return _by_cells(points, eps, min_samples, features, id_col)
    scratch = Scratch(points.sparkSession, "dbscan")
    near = scratch.save(pairs if pairs is not None else radius_pairs(points, eps, features, id_col), "pairs")
    degree = near.groupBy("a").agg(F.count("*").alias("n"))
    core = points.select(F.col(id_col).alias("a")).join(degree, "a", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("a")
    core = scratch.save(core, "core")
    cb = core.select(F.col("a").alias("b"))
    inner = near.join(core, "a", "left_semi").join(cb, "b", "left_semi")
    comps = connected_components(inner.select("a", "b"), scratch)
    label_of = core.join(comps, core["a"] == comps["node"], "left").select("a", F.coalesce("component", "a").alias("root"))
    numbers = numbered(label_of.select("root").distinct(), ["root"], "label", 0, scratch)
    labelled = scratch.save(label_of.join(numbers, "root").select("a", "label"), "labels")
    border = (
        near.join(core, "a", "left_anti")
        .join(labelled.select(F.col("a").alias("b"), "label"), "b")
        .groupBy("a")
        .agg(F.min(F.struct("distance", "b", "label"))["label"].alias("label"))
    )
    found = labelled.union(border.select("a", "label"))
    return points.select(F.col(id_col).alias("a")).join(found, "a", "left").select(F.col("a").alias(id_col), F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


# -- one-task methods on a small table


def pairwise(x: np.ndarray) -> np.ndarray:
    """The matrix of Euclidean distances."""
    sq = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def linkage(distances: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges (a, b, height, size) of agglomerative clustering, lowest first; new clusters are numbered from n on.

    Distances of a merged cluster follow from those of its parts (single, complete,
    average, weighted, ward); ties go to the pair with the smallest positions.
    """
    n = len(distances)
    if method not in ("single", "complete", "average", "weighted", "ward"):
        raise ValueError(f"unknown linkage {method!r}")
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    out = np.zeros((max(0, n - 1), 4))
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        h = d[i, j]
        a, b = sorted((name[i], name[j]))
        out[step] = a, b, h, size[i] + size[j]
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "weighted":
            new = (d[i] + d[j]) / 2
        else:
            t = size + size[i] + size[j]
            new = np.sqrt(np.maximum(((size + size[i]) * d[i] ** 2 + (size + size[j]) * d[j] ** 2 - size * h * h) / t, 0))
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        name[i] = n + step
    return out


def cut(merges: np.ndarray, n: int, criterion: str, threshold: float, depth: int = 2) -> np.ndarray:
    """Labels from 1 by 'distance' (merges up to a height), 'maxclust' (at most so many) or 'inconsistent'."""
    if criterion == "maxclust":
        keep = np.arange(len(merges)) < n - int(threshold)
    elif criterion == "distance":
        keep = merges[:, 2] <= threshold
    elif criterion == "inconsistent":
        coef = inconsistency(merges, n, depth)
        worst = np.zeros(len(merges))
        for k, (a, b, _, _) in enumerate(merges):
            worst[k] = max(coef[k], *(worst[int(c) - n] if c >= n else 0.0 for c in (a, b)))
        keep = worst <= threshold
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    root = list(range(n + len(merges)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for k, (a, b, _, _) in enumerate(merges):
        if keep[k]:
            root[find(int(a))] = n + k
            root[find(int(b))] = n + k
    _, first, label = np.unique([find(v) for v in range(n)], return_index=True, return_inverse=True)
    order = np.empty(len(first), int)
    order[np.argsort(first)] = np.arange(1, len(first) + 1)
    return order[label]


def inconsistency(merges: np.ndarray, n: int, depth: int = 2) -> np.ndarray:
    """(height - mean) / deviation of each merge among those at most ``depth`` levels below it, 0 where they do not vary."""
    out = np.zeros(len(merges))
    for k in range(len(merges)):
        heights, level = [], [k]
        for _ in range(depth):
            heights += [merges[m, 2] for m in level]
            level = [int(c) - n for m in level for c in merges[m, :2] if c >= n]
        s = np.std(heights, ddof=1) if len(heights) > 1 else 0.0
        out[k] = (merges[k, 2] - np.mean(heights)) / s if s > 0 else 0.0
    return out


def cophenetic(merges: np.ndarray, n: int) -> np.ndarray:
    """The matrix of heights at which each two leaves are joined."""
    members: dict[int, list[int]] = {k: [k] for k in range(n)}
    out = np.zeros((n, n))
    for k, (a, b, h, _) in enumerate(merges):
        left, right = members.pop(int(a)), members.pop(int(b))
        out[np.ix_(left, right)] = h
        out[np.ix_(right, left)] = h
        members[n + k] = left + right
    return out


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right of the dendrogram."""
    if not len(merges):
        return list(range(n))
    out, stack = [], [n + len(merges) - 1]
    while stack:
        v = stack.pop()
        if v < n:
            out.append(v)
        else:
            stack += [int(merges[v - n, 1]), int(merges[v - n, 0])]
    return out


def optics(d: np.ndarray, min_samples: int, max_eps: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, reachability, core distance): points in the order of density reachability, the smallest index on ties."""
    n = len(d)
    core = np.partition(d, min_samples - 1, axis=1)[:, min_samples - 1] if n >= min_samples else np.full(n, np.inf)
    core[core > max_eps] = np.inf
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        p = int(np.where(done, np.inf, reach).argmin())
        if done[p]:
            p = int(np.flatnonzero(~done)[0])
        done[p] = True
        order.append(p)
        if np.isfinite(core[p]):
            new = np.where((d[p] <= max_eps) & ~done, np.maximum(core[p], d[p]), np.inf)
            reach = np.minimum(reach, new)
    return np.array(order), reach, core


def optics_cut(order: np.ndarray, reach: np.ndarray, core: np.ndarray, eps: float) -> np.ndarray:
    """Labels that DBSCAN with ``eps`` would give, from an OPTICS ordering."""
    label, out = -1, np.full(len(order), -1)
    for p in order:
        if reach[p] > eps:
            if core[p] <= eps:
                label += 1
                out[p] = label
        else:
            out[p] = label
    return out


def optics_xi(order: np.ndarray, reach: np.ndarray, xi: float, min_size: int) -> np.ndarray:
    """Labels of the steepest nested valleys of the reachability plot: a valley starts with a fall and ends with a rise by the share ``xi``."""
    r = np.append(reach[order], np.inf)
    out, label = np.full(len(order), -1), 0
    found = []
    starts: list[int] = []
    for k in range(len(order)):
        if k + 1 < len(r) and r[k + 1] <= r[k] * (1 - xi):
            starts.append(k)
        if r[k] <= r[k + 1] * (1 - xi):
            for s in reversed(starts):
                if k - s + 1 >= min_size and min(r[s], r[k + 1]) * (1 - xi) >= r[s + 1 : k + 1].max(initial=0):
                    found.append((s, k))
    for s, e in sorted(found, key=lambda v: (v[1] - v[0], v)):
        if (out[order[s : e + 1]] == -1).all():
            out[order[s : e + 1]] = label
            label += 1
    return out


def _one_task(points: DataFrame, features: Sequence[str], id_col: str, work, schema: str) -> DataFrame:
    n = points.count()
    if n > MAX_ROWS:
        raise ValueError(f"{n} rows; all pairwise distances are only made for up to {MAX_ROWS}. Cluster in stages, or use dbscan")
    rows = points.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)]).coalesce(1)

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        if t.num_rows:
            t = t.sort_by("id")
            x = np.stack([t[k + 1].to_numpy() for k in range(len(features))], axis=1)
            yield from work(t["id"].to_numpy(), x).to_batches()

    return rows.mapInArrow(run, schema)


def hierarchical(points: DataFrame, features: Sequence[str], id_col: str = "id", method: str = "average", criterion: str = "distance", threshold: float = 1.0, depth: int = 2) -> DataFrame:
    """(id, label, leaf, cophenetic): labels from 1, the dendrogram's leaf position, and the correlation of distances and heights."""

    def work(ids: np.ndarray, x: np.ndarray) -> pa.Table:
        d = pairwise(x)
        z = linkage(d, method)
        n = len(ids)
        up = np.triu_indices(n, 1)
        c = cophenetic(z, n)[up]
        corr = float(np.corrcoef(d[up], c)[0, 1]) if n > 2 and c.std() > 0 and d[up].std() > 0 else 1.0
        leaf = np.empty(n, np.int64)
        leaf[leaf_order(z, n)] = np.arange(n)
        return pa.table({"id": ids, "label": cut(z, n, criterion, threshold, depth).astype(np.int64), "leaf": leaf, "cophenetic": np.full(n, corr)})

    return _one_task(points, features, id_col, work, "id long, label long, leaf long, cophenetic double")


def dendrogram(points: DataFrame, features: Sequence[str], id_col: str = "id", method: str = "average") -> DataFrame:
    """(step, a, b, height, size): the merges, leaves by their position in id order."""

    def work(ids: np.ndarray, x: np.ndarray) -> pa.Table:
        z = linkage(pairwise(x), method)
        return pa.table({"step": np.arange(len(z)), "a": z[:, 0].astype(np.int64), "b": z[:, 1].astype(np.int64), "height": z[:, 2], "size": z[:, 3].astype(np.int64)})

    return _one_task(points, features, id_col, work, "step long, a long, b long, height double, size long")


def agglomerative(points: DataFrame, features: Sequence[str], id_col: str = "id", method: str = "average", n_clusters: int | None = None, threshold: float | None = None) -> DataFrame:
    """(id, label) from 0, by a number of clusters or a height; ward needs raw features, not a metric, and is refused."""
    if method == "ward":
        raise ValueError("ward is not defined for a general metric")
    if (n_clusters is None) == (threshold is None):
        raise ValueError("give n_clusters or threshold")
    how, value = ("maxclust", n_clusters) if n_clusters is not None else ("distance", threshold)
    out = hierarchical(points, features, id_col, method, how, value)
    return out.select(F.col("id").alias(id_col), (F.col("label") - 1).alias("label"))


def optics_labels(points: DataFrame, features: Sequence[str], min_samples: int, id_col: str = "id", max_eps: float = float("inf"), method: str = "dbscan", eps: float = 0.5, xi: float = 0.05) -> DataFrame:
    """(id, label, position, reachability, core_distance) by OPTICS."""
    if method not in ("dbscan", "xi"):
        raise ValueError("method is dbscan or xi")

    def work(ids: np.ndarray, x: np.ndarray) -> pa.Table:
        order, reach, core = optics(pairwise(x), min_samples, max_eps)
        label = optics_cut(order, reach, core, eps) if method == "dbscan" else optics_xi(order, reach, xi, min_samples)
        position = np.empty(len(ids), np.int64)
        position[order] = np.arange(len(ids))
        return pa.table({"id": ids, "label": label.astype(np.int64), "position": position, "reachability": reach, "core_distance": core})

    return _one_task(points, features, id_col, work, "id long, label long, position long, reachability double, core_distance double")


METHODS = {"dbscan": dbscan, "hierarchical": hierarchical, "agglomerative": agglomerative, "optics": optics_labels}


def cluster(points: DataFrame, method: str, **options) -> DataFrame:
    """The clustering of a named method."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](points, **options)


def suggested_eps(points: DataFrame, features: Sequence[str]) -> float:
    """A starting value for eps: the side of a cell that holds one point on average."""
    return cell_size(points, list(features)[:3], per_cell=1.0)

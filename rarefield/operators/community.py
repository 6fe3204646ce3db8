"""Community detection on weighted edges: label propagation, Louvain levels, Leiden.

Each round is one aggregation over half-edges.  Nodes move in alternating halves,
chosen by a hash of the round, which keeps synchronous moves from oscillating.
Results are deterministic: ties go to the smallest label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.operators.components import label_nodes
from rarefield.scratch import Scratch

SEGMENTERS = ("auto", "leiden", "louvain", "plm", "plp", "components")


def _half(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").cast("double").alias("w"))
    return one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def _move(now: DataFrame, target: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Labels after a round: nodes whose hash is even in this round take their target."""
    turn = F.pmod(F.xxhash64("u", F.lit(k // 2)), F.lit(2)) == k % 2
    then = now.join(target, "u", "left").select("u", F.when(turn & F.col("t").isNotNull(), F.col("t")).otherwise(F.col("label")).alias("label"), F.col("label").alias("was"))
    then = scratch.save(then, "labels")
    changed = then.where("label != was").count()
    return then.drop("was"), changed


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 50, id_col: str = "id") -> DataFrame:
    """(id, label): each node takes the label of greatest weight among its neighbours, the smallest on ties."""
    scratch = Scratch(nodes.sparkSession, "plp")
    half = scratch.save(_half(edges), "half")
    now = scratch.save(nodes.select(F.col(id_col).cast("long").alias("u")).distinct().select("u", F.col("u").alias("label")), "labels")
    quiet = 0
    for k in range(rounds):
        seen = half.join(now.select(F.col("u").alias("v"), "label"), "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        target = seen.groupBy("u").agg(F.max(F.struct("w", (-F.col("label")).alias("m")))["m"].alias("m")).select("u", (-F.col("m")).alias("t"))
        now, changed = _move(now, target, k, scratch)
        quiet = quiet + 1 if not changed else 0
        if quiet == 2:
            break
    return now.select(F.col("u").alias(id_col), "label")


def _local_moves(nodes: DataFrame, half: DataFrame, gamma: float, rounds: int, scratch: Scratch) -> DataFrame:
    """(u, label) after modularity moves of single nodes; ``half`` may hold loops (u = v), each with its whole weight.

    Nodes start in the communities of their ``label``, or each in its own.
    """
    total = half.agg(F.sum("w")).first()[0] or 0.0
    degree = scratch.save(half.groupBy("u").agg(F.sum("w").alias("d")), "degree")
    now = scratch.save(nodes.select("u", F.col("label" if "label" in nodes.columns else "u").alias("label")), "labels")
    if not total:
        return now
    quiet = 0
    for k in range(rounds):
        volume = now.join(degree, "u").groupBy("label").agg(F.sum("d").alias("vol"))
        to = half.where("u != v").join(now.select(F.col("u").alias("v"), "label"), "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        own = now.select("u", F.col("label").alias("mine")).join(degree, "u")
        stay = own.select("u", F.col("mine").alias("label"), F.lit(0.0).alias("w"))
        options = to.union(stay).groupBy("u", "label").agg(F.sum("w").alias("w")).join(own, "u").join(volume, "label")
        vol = F.col("vol") - F.when(F.col("label") == F.col("mine"), F.col("d")).otherwise(F.lit(0.0))
        gain = F.round(F.col("w") - F.lit(gamma) * vol * F.col("d") / total, 9)
        scored = options.select("u", "label", "mine", gain.alias("g"))
        best = scored.groupBy("u").agg(F.max(F.struct("g", (-F.col("label")).alias("m"))).alias("b"), F.max(F.when(F.col("label") == F.col("mine"), F.col("g"))).alias("keep"))
        target = best.where(F.col("b.g") > F.col("keep")).select("u", (-F.col("b.m")).alias("t"))
        now, changed = _move(now, target, k, scratch)
        quiet = quiet + 1 if not changed else 0
        if quiet == 2:
            break
    return now


def _modularity(half: DataFrame, labels: DataFrame, gamma: float) -> float:
    """The modularity of (u, label) over half-edges, loops included."""
    mine = labels.select("u", F.col("label").alias("lu"))
    other = labels.select(F.col("u").alias("v"), F.col("label").alias("lv"))
    by = half.join(mine, "u").join(other, "v").groupBy("lu").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("lu") == F.col("lv"), F.col("w")).otherwise(0.0)).alias("inside"))
    r = by.agg(F.sum("d").alias("total"), F.sum("inside").alias("inside"), F.sum(F.col("d") * F.col("d")).alias("squares")).first()
    return r["inside"] / r["total"] - gamma * r["squares"] / r["total"] ** 2 if r["total"] else 0.0


def modularity(labels: DataFrame, edges: DataFrame, gamma: float = 1.0, id_col: str = "id") -> float:
    """The modularity of a partition."""
    return _modularity(_half(edges), labels.select(F.col(id_col).alias("u"), "label"), gamma)


def _aggregated(half: DataFrame, groups: DataFrame) -> DataFrame:
    """Half-edges between groups of nodes, of (u, label); edges within a group become its loop."""
    ends = half.join(groups.select("u", F.col("label").alias("a")), "u").join(groups.select(F.col("u").alias("v"), F.col("label").alias("b")), "v")
    return ends.groupBy("a", "b").agg(F.sum("w").alias("w")).select(F.col("a").alias("u"), F.col("b").alias("v"), "w")


def louvain(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, levels: int = 8, rounds: int = 20, id_col: str = "id") -> DataFrame:
    """(id, label): local moves and aggregation, level by level."""
    scratch = Scratch(nodes.sparkSession, "louvain")
    half = scratch.save(_half(edges), "half")
    level_nodes = scratch.save(nodes.select(F.col(id_col).cast("long").alias("u")).distinct(), "nodes")
    mapping = level_nodes.select(F.col("u").alias("id"), F.col("u").alias("label"))
    for _ in range(levels):
        moved = _local_moves(level_nodes, half, gamma, rounds, scratch)
        mapping = scratch.save(mapping.join(moved.select(F.col("u").alias("label"), F.col("label").alias("to")), "label").select("id", F.col("to").alias("label")), "mapping")
        groups = scratch.save(moved.select(F.col("label").alias("u")).distinct(), "nodes")
        if groups.count() == level_nodes.count():
            break
        half, level_nodes = scratch.save(_aggregated(half, moved), "half"), groups
    return mapping.select(F.col("id").alias(id_col), "label")


def _refined(half: DataFrame, coarse: DataFrame, gamma: float, rounds: int, scratch: Scratch) -> DataFrame:
    """(u, label): parts of the communities of ``coarse``, built from single nodes.

    Only nodes that are still alone move, in alternating halves, and only to parts
    that no node of the moving half is; so a part is never left by a node and stays
    connected.  A node moves, and a part is joined, only where it is well connected to
    the rest of its community: by gamma times the product of the volumes or more.
    """
    c = coarse.select("u", F.col("label").alias("c"))
    total = half.agg(F.sum("w")).first()[0] or 0.0
    alone = coarse.select("u", F.col("u").alias("label"))
    if not total:
        return alone
    inside = scratch.save(half.where("u != v").join(c, "u").join(c.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").where("c = cv").select("u", "v", "w"), "inside")
    volumes = half.groupBy("u").agg(F.sum("w").alias("d")).join(c, "u")
    whole = volumes.groupBy("c").agg(F.sum("d").alias("vol_c"))
    within = inside.groupBy("u").agg(F.sum("w").alias("inner"))
    # a node without edges within its community moves nowhere
    table = scratch.save(volumes.join(whole, "c").join(within, "u").select("u", "d", "vol_c", "inner"), "table")
    now = scratch.save(table.select("u", F.col("u").alias("r")), "parts")
    linked = lambda cut, volume: cut >= F.lit(gamma) * volume * (F.col("vol_c") - volume) / total
    quiet = 0
    for k in range(rounds):
        named = table.join(now, "u")
        cut = inside.join(now, "u").join(now.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v").where("r != rv").groupBy("r").agg(F.sum("w").alias("cut"))
        turn = F.pmod(F.xxhash64("u", F.lit(k // 2)), F.lit(2)) == k % 2
        sums = named.groupBy("r").agg(F.sum("d").alias("vol_r"), F.count("*").alias("n"), F.first("vol_c").alias("vol_c"), F.min("u").alias("one"))
        parts = sums.join(cut, "r", "left").withColumn("cut", F.coalesce("cut", F.lit(0.0)))
        moving = (F.col("n") == 1) & F.pmod(F.xxhash64("one", F.lit(k // 2)), F.lit(2)).eqNullSafe(k % 2)
        parts = scratch.save(parts.select("r", "vol_r", "n", moving.alias("moving"), linked(F.col("cut"), F.col("vol_r")).alias("open")), "sums")
        singles = named.join(parts.where("n = 1").select("r"), "r").where(turn & linked(F.col("inner"), F.col("d"))).select("u", "d")
        to = inside.join(singles, "u").join(now.select(F.col("u").alias("v"), "r"), "v").groupBy("u", "r").agg(F.sum("w").alias("w"), F.first("d").alias("d"))
        options = to.join(parts.where("open and not moving").select("r", "vol_r"), "r")
        gain = F.round(F.col("w") - F.lit(gamma) * F.col("d") * F.col("vol_r") / total, 9)
        best = options.select("u", "r", gain.alias("g")).where("g > 0").groupBy("u").agg(F.max(F.struct("g", (-F.col("r")).alias("m")))["m"].alias("m"))
        then = now.join(best.select("u", (-F.col("m")).alias("t")), "u", "left").select("u", F.coalesce("t", "r").alias("r"), F.col("t").isNotNull().alias("moved"))
        then = scratch.save(then, "parts")
        moved = not then.where("moved").isEmpty()
        scratch.drop(now, parts)
        now = then.drop("moved")
        now._rarefield_path = then._rarefield_path
        quiet = 0 if moved else quiet + 1
        if quiet == 2:
            break
    return scratch.save(alone.join(now, "u", "left").select("u", F.coalesce("r", "label").alias("label")), "refined")


def leiden(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, levels: int = 10, rounds: int = 20, id_col: str = "id") -> DataFrame:
    """(id, label): refinement within each community, aggregation of the refined parts and local moves, level by level.

    Traag et al., "From Louvain to Leiden", 2019, in synchronous rounds.  The first
    level starts from Louvain's communities, each later one from the communities it
    was handed, its nodes being their parts, so parts that moves put together wrongly
    can part again.  A level whose moves lower the modularity keeps what it started
    from, and splitting a disconnected community never lowers it: the result is
    connected, and its modularity is that of Louvain's or more.
    """
    scratch = Scratch(nodes.sparkSession, "leiden")
    whole = half = scratch.save(_half(edges), "half")
    start = louvain(nodes, edges, gamma, levels, rounds, id_col)
    level = scratch.save(start.select(F.col(id_col).cast("long").alias("u"), "label"), "nodes")
    place = level.select(F.col("u").alias("id"), F.col("u").alias("part"))
    reached = _modularity(half, level, gamma)
    communities = level
    for _ in range(levels):
        moved = _local_moves(level, half, gamma, rounds, scratch)
        q = _modularity(half, moved, gamma)
        if q < reached:
            moved = level.select("u", "label")
        reached = max(q, reached)
        communities = scratch.save(place.join(moved.select(F.col("u").alias("part"), "label"), "part").select(F.col("id").alias("u"), "label"), "communities")
        refined = _refined(half, moved, gamma, rounds, scratch)
        owners = scratch.save(refined.select("u", F.col("label").alias("part")).join(moved, "u").groupBy("part").agg(F.min("label").alias("label")).select(F.col("part").alias("u"), "label"), "nodes")
        if owners.count() == level.count():
            break
        place = scratch.save(place.join(refined.select(F.col("u").alias("part"), F.col("label").alias("to")), "part").select("id", F.col("to").alias("part")), "place")
        half, level = scratch.save(_aggregated(half, refined), "half"), owners
    within = whole.join(communities.select("u", F.col("label").alias("a")), "u").join(communities.select(F.col("u").alias("v"), F.col("label").alias("b")), "v").where("a = b and u < v")
    found = label_nodes(communities, within.select(F.col("u").alias("a"), F.col("v").alias("b")), scratch, "u")
    return found.select(F.col("node").alias(id_col), F.col("component").alias("label"))


def segment(nodes: DataFrame, edges: DataFrame, method: str = "auto", gamma: float = 1.0, id_col: str = "id") -> DataFrame:
    """(id, label) by a named method; every node gets a label."""
    if method in ("auto", "leiden"):
        return leiden(nodes, edges, gamma, id_col=id_col)
    if method in ("louvain", "plm"):
        return louvain(nodes, edges, gamma, id_col=id_col)
    if method == "plp":
        return label_propagation(nodes, edges, id_col=id_col)
    if method == "components":
        return label_nodes(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), id_col=id_col).select(F.col("node").alias(id_col), F.col("component").alias("label"))
    raise ValueError(f"unknown segmenter {method!r}; known: {SEGMENTERS}")

"""A tree of cells over points of any density, as tables.

Level 0 is one cell around all targets; each level halves the sides.  A target lies in
one cell of every level, and its leaf is the first that holds at most ``cap`` of
them.  The tree is two tables, the cells that hold something and the targets by leaf,
both made by aggregation and equi-joins on (level, cell), so a dense spot is many
small cells and a void is none; nothing is as large as the densest place.

Targets at one place beyond the ``keep`` smallest ids are left out first: no nearest
neighbour query of that many can need them, and no cell could part them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefield.scratch import Scratch, join_by_measured_size

STEP, DEEPEST = 10, 50


@dataclass
class CellTree:
    """``cells``: (level, c0.., n, lo0.., hi0.., leaf) with tight boxes and the level of the leaf they lie in; ``targets``: (target, t0.., level, c0..) by leaf."""

    cells: DataFrame
    targets: DataFrame
    dims: int
    cap: int
    depth: int
    low: list[float]
    width: float  # of a cell at the deepest level

    @property
    def key(self) -> list[str]:
        return ["level", *[f"c{n}" for n in range(self.dims)]]

    @property
    def divided(self) -> Column:
        """Whether a cell has cells of the next level."""
        return (F.col("n") > self.cap) & (F.col("level") < self.depth)

    def place(self, x: Column, n: int) -> Column:
        """The cell along axis ``n`` of the deepest level, of the nearest one inside where ``x`` is outside."""
        return place(x, self.low[n], self.width, self.depth)


def place(x: Column, low: float, width: float, depth: int) -> Column:
    last = (1 << depth) - 1
    return F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(last)).cast("long")


def at_level(cell: Column, level: Column, depth: int) -> Column:
    """The ancestor at ``level`` of a cell of the deepest level."""
    return F.call_function("shiftright", cell, (F.lit(depth) - level).cast("int"))


def box_distance2(dims: int, q: str = "q", lo: str = "lo", hi: str = "hi") -> Column:
    """Squared distance of a point to a box, 0 inside."""
    parts = [F.greatest(F.col(f"{lo}{n}") - F.col(f"{q}{n}"), F.col(f"{q}{n}") - F.col(f"{hi}{n}"), F.lit(0.0)) for n in range(dims)]
    return sum((p * p for p in parts), F.lit(0.0))


def far_corner2(dims: int, q: str = "q", lo: str = "lo", hi: str = "hi") -> Column:
    """Squared distance of a point to the farthest corner of a box."""
    parts = [F.greatest(F.abs(F.col(f"{q}{n}") - F.col(f"{lo}{n}")), F.abs(F.col(f"{hi}{n}") - F.col(f"{q}{n}"))) for n in range(dims)]
    return sum((p * p for p in parts), F.lit(0.0))


def build(targets: DataFrame, dims: int, cap: int, keep: int, scratch: Scratch) -> CellTree | None:
    """The tree of (target, t0, t1, ..); None where there are no targets."""
    join_by_measured_size(targets.sparkSession)
    axes = [f"t{n}" for n in range(dims)]
    same = Window.partitionBy(*axes).orderBy("target")
    own = scratch.save(targets.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= keep).drop("_r"), "targets")
    ends = own.agg(F.count("*").alias("n"), *[f(a).alias(f"{p}_{a}") for a in axes for p, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return None
    low = [ends[f"lo_{a}"] for a in axes]
    extent = max(ends[f"hi_{a}"] - ends[f"lo_{a}"] for a in axes) or 1.0
    depth = 0
    crowded = ends["n"] > cap
    while crowded and depth < DEEPEST:  # a level at which no cell is over its cap
        depth += STEP
        width = extent * (1 + 1e-9) / (1 << depth)
        crowded = not own.groupBy(*[place(F.col(a), low[n], width, depth) for n, a in enumerate(axes)]).count().where(F.col("count") > cap).isEmpty()
    width = extent * (1 + 1e-9) / (1 << depth)
    deep = own.select("target", *axes, *[place(F.col(a), low[n], width, depth).alias(f"d{n}") for n, a in enumerate(axes)])
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    of = [at_level(F.col(f"d{n}"), F.col("level"), depth).alias(f"c{n}") for n in range(dims)]
    key = ["level", *[f"c{n}" for n in range(dims)]]
    every = deep.select("*", levels).select("*", *of)
    sizes = scratch.save(every.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    fits = every.select("target", *key).join(sizes.where((F.col("n") <= cap) | (F.col("level") == depth)), key)
    leaf = scratch.save(fits.groupBy("target").agg(F.min("level").alias("leaf")), "leaf")
    boxes = [f(a).alias(f"{p}{n}") for n, a in enumerate(axes) for p, f in (("lo", F.min), ("hi", F.max))]
    cells = scratch.save(every.join(leaf, "target").groupBy(*key).agg(F.count("*").alias("n"), *boxes, F.min("leaf").alias("leaf")), "cells")
    placed = scratch.save(deep.join(leaf.withColumnRenamed("leaf", "level"), "target").select("target", *axes, "level", *of), "leaves")
    scratch.drop(sizes, leaf)
    return CellTree(cells, placed, dims, cap, depth, low, width)


def nearest(tree: CellTree, queries: DataFrame, need: int, scratch: Scratch, within: float | None = None) -> DataFrame:
    """(query, target, d2): for each (query, q0, q1, ..) its targets within a ball that holds ``need`` of them or more, if there are as many.

    The ball reaches the farthest corner of the smallest cell of the query that holds
    ``need`` targets, and no farther than ``within``.  It begins as the few cells of the level whose side is its radius
    and goes down where a cell is divided and touches it.
    """
    dims, depth, key = tree.dims, tree.depth, tree.key
    q = [f"q{n}" for n in range(dims)]
    deep = queries.select("query", *q, *[tree.place(F.col(a), n).alias(f"d{n}") for n, a in enumerate(q)])
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    of = [at_level(F.col(f"d{n}"), F.col("level"), depth).alias(f"c{n}") for n in range(dims)]
    enough = tree.cells.where((F.col("n") >= need) | (F.col("level") == 0)).select(*key, *[f"{p}{n}" for n in range(dims) for p in ("lo", "hi")])
    homes = deep.select("query", *q, levels, *[f"d{n}" for n in range(dims)]).select("query", *q, "level", *of).join(enough, key)
    radius2 = F.max_by(far_corner2(dims), "level") * (1 + 1e-9)
    if within is not None:
        radius2 = F.least(radius2, F.lit(within * within * (1 + 1e-9)))
    balls = homes.groupBy("query", *q).agg(radius2.alias("r2"))
    extent = tree.width * (1 << depth)
    r = F.sqrt("r2")
    level = F.when(F.col("r2") > 0, F.least(F.greatest(F.floor(F.log2(F.lit(extent) / r)), F.lit(0)), F.lit(depth))).otherwise(depth).cast("int")
    front = scratch.save(balls.withColumn("level", level), "balls")
    for n, a in enumerate(q):
        first, last = (at_level(tree.place(F.col(a) + s * r, n), F.col("level"), depth) for s in (-1, 1))
        front = front.withColumn(f"c{n}", F.explode(F.sequence(first, last)))
    leaves = None
    children = lambda n: F.explode(F.array(2 * F.col(f"c{n}"), 2 * F.col(f"c{n}") + 1))
    while True:
        met = scratch.save(front.join(tree.cells, key).where(box_distance2(dims) <= F.col("r2")), "met")
        up = [F.call_function("shiftright", F.col(f"c{n}"), F.col("level") - F.col("leaf")).alias(f"c{n}") for n in range(dims)]
        ends = met.where(~tree.divided).select("query", *q, "r2", F.col("leaf").alias("level"), *up)
        leaves = ends if leaves is None else leaves.union(ends)
        front = met.where(tree.divided).select("query", *q, "r2", (F.col("level") + 1).alias("level"), *[f"c{n}" for n in range(dims)])
        if front.isEmpty():
            break
        for n in range(dims):
            front = front.withColumn(f"c{n}", children(n))
    d2 = sum(((F.col(f"q{n}") - F.col(f"t{n}")) ** 2 for n in range(dims)), F.lit(0.0))
    return leaves.distinct().join(tree.targets, key).select("query", "target", "r2", d2.alias("d2")).where("d2 <= r2").drop("r2")

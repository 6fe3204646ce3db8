"""One-to-one matching of two sides of a candidate edge list.

Maximising the gain of a matching decomposes over the connected components of the
candidate graph.  Components are found by Spark.  Those of up to ``LARGE`` edges are
solved exactly, one after another over their edges alone, about ``SHARE`` edges in a task.  Larger ones are matched by an
auction in rounds over all their edges at once, of which no task holds more than
``BIDDERS`` edges or one node's; the result is within a stated bound of the best.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.operators.components import connected_components
from rarefield.scratch import Scratch, join_by_measured_size

LARGE, BIDDERS, SHARE = 500_000, 50_000, 20_000
TOLERANCE = 1e-3  # of the greatest gain, for each pair

def solve(cost: np.ndarray) -> np.ndarray:
    """The column of each row of a least-cost assignment of a matrix with no more rows than columns."""
    edges = [list(enumerate(map(float, row))) for row in cost]
    owner = _augmented(edges)
    out = np.full(len(cost), -1)
    for column, row in owner.items():
        out[row] = column
    return out


def _augmented(edges: list[list[tuple[int, float]]]) -> dict[int, int]:
    """The row of each taken column in a least-cost assignment of all rows to columns of their edges (column, cost).

    Shortest augmenting paths with row and column potentials, searched by a heap
    over the edges that exist; costs may be any finite numbers.
    """
    owner: dict[int, int] = {}
    row_pot = [0.0] * len(edges)
    col_pot: dict[int, float] = {}
    for start in range(len(edges)):
        reach: dict[int, float] = {}
        came: dict[int, tuple[int, int | None]] = {}  # of a column: the row before it, and the column before that
        settled: set[int] = set()
        length = {start: 0.0}
        heap: list[tuple[float, int]] = []
        row, far, column = start, 0.0, None
        while True:
            for j, c in edges[row]:
                if j not in settled:
                    through = far + c - row_pot[row] - col_pot.get(j, 0.0)
                    if through < reach.get(j, float("inf")):
                        reach[j], came[j] = through, (row, column)
                        heapq.heappush(heap, (through, j))
            far, column = heapq.heappop(heap)
            while column in settled:
                far, column = heapq.heappop(heap)
            settled.add(column)
            if column not in owner:
                break
            row = owner[column]
            length[row] = far
        for r, d in length.items():
            row_pot[r] += far - d
        for j in settled:
            col_pot[j] = col_pot.get(j, 0.0) - (far - reach[j])
        while column is not None:
            row, before = came[column]
            owner[column], column = row, before
    return owner


def best_matching(a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Indices of the edges of a matching of greatest total gain; edges without gain stay out."""
    rows, i = np.unique(a, return_inverse=True)
    cols, j = np.unique(b, return_inverse=True)
    if len(rows) > len(cols):
        i, j, rows, cols = j, i, cols, rows
    best: dict[tuple[int, int], int] = {}
    for k in np.argsort(gain, kind="stable").tolist():
        best[int(i[k]), int(j[k])] = k
    # a column of its own lets each row stay free
    edges = [[(len(cols) + r, 0.0)] for r in range(len(rows))]
    for (r, c), k in best.items():
        edges[r].append((c, -float(gain[k])))
    taken = [best[r, c] for c, r in _augmented(edges).items() if c < len(cols)]
    return np.sort(np.array(taken, np.int64))


def bids(a: np.ndarray, b: np.ndarray, gain: np.ndarray, price: np.ndarray, step: float) -> list[tuple[int, int | None, float, float]]:
    """(a, b, bid, gain) of some bidders: what each holds once none of them is outbid by another, b None where nothing is worth its price.

    A bidder bids for what is worth most to it, up to the price at which the next
    best, or nothing at all, is worth as much, and ``step`` more.
    """
    who, start = np.unique(a, return_index=True)
    ends = np.append(start[1:], len(a))
    offers = {int(w): (b[s:e].tolist(), gain[s:e].tolist()) for w, s, e in zip(who, start, ends, strict=True)}
    asked = dict(zip(b.tolist(), price.tolist(), strict=True))
    held: dict[int, tuple[int, float, float]] = {}
    out: list[tuple[int, int | None, float, float]] = []
    waiting = deque(who.tolist())
    while waiting:
        w = waiting.popleft()
        best, next_, at, worth = 0.0, 0.0, None, 0.0
        for j, g in zip(*offers[w], strict=True):
            value = g - asked[j]
            if value > best:
                best, next_, at, worth = value, best, j, g
            elif value > next_:
                next_ = value
        if at is None:
            out.append((w, None, 0.0, 0.0))
            continue
        asked[at] += best - next_ + step
        if at in held:
            waiting.append(held[at][0])
        held[at] = (w, asked[at], worth)
    return out + [(w, j, p, g) for j, (w, p, g) in held.items()]


def auction(edges: DataFrame, step: float, scratch: Scratch, bidders: int = BIDDERS, rounds: int = 10_000) -> DataFrame:
    """The edges (a, b, gain) of a matching whose total gain is at most ``step`` a pair below the greatest.

    Bertsekas' auction, the a bidding for the b.  In each round those without a b are
    dealt to groups anew; a group settles its own bids, and each b goes to the highest.
    Prices only rise, from 0, and a b once taken stays taken, which makes the bound
    hold.  With whole gains and fewer than 1 / ``step`` pairs the result is the best.
    """
    spark = edges.sparkSession
    edges = scratch.save(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("gain").cast("double")), "bids")
    kind = "a long, b long, bid double, gain double"
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bid", pa.float64()), ("gain", pa.float64())])
    held = spark.createDataFrame([], "b long, price double, owner long, gain double")
    open_ = scratch.save(edges.select("a").distinct(), "open")

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("a", "ascending"), ("b", "ascending")])
        rows = bids(*(t[c].to_numpy() for c in ("a", "b", "gain", "price")), step)
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(4)], schema=schema)

    for k in range(rounds):
        asking = edges.join(open_, "a")
        groups = asking.count() // bidders + 1
        priced = asking.join(held.select("b", "price"), "b", "left").select("a", "b", "gain", F.coalesce("price", F.lit(0.0)).alias("price"), F.pmod(F.xxhash64("a", F.lit(k)), F.lit(groups)).alias("_g"))
        made = scratch.save(priced.groupBy("_g").applyInArrow(lambda t: group(t.drop_columns(["_g"])), kind).where("b is not null"), "made")
        won = made.groupBy("b").agg(F.max(F.struct("bid", (-F.col("a")).alias("m"), "gain")).alias("w")).select("b", F.col("w.bid").alias("price"), (-F.col("w.m")).alias("owner"), F.col("w.gain").alias("gain"))
        won = scratch.save(won, "won")
        outbid = held.join(won.select("b"), "b").select(F.col("owner").alias("a"))
        lost = made.select("a").join(won.select(F.col("owner").alias("a")), "a", "left_anti")
        then = scratch.save(lost.union(outbid), "open")
        kept = scratch.save(held.join(won.select("b"), "b", "left_anti").unionByName(won), "held")
        scratch.drop(open_, made, won)
        if k:
            scratch.drop(held)
        held, open_ = kept, then
        if open_.isEmpty():
            return held.select(F.col("owner").alias("a"), "b", "gain")
    raise RuntimeError(f"an auction did not end in {rounds} rounds")


def match(edges: DataFrame, gain: str = "gain", a: str = "a", b: str = "b", large: int = LARGE, tolerance: float = TOLERANCE, share: int = SHARE) -> DataFrame:
    """The edges (a, b, gain) of a matching of greatest total gain, of those with a positive gain.

    In components of more than ``large`` edges the total may be below the greatest by
    ``tolerance`` times their greatest gain for each of their pairs.
    """
    join_by_measured_size(edges.sparkSession)
    scratch = Scratch(edges.sparkSession, "match")
    useful = scratch.save(edges.where(F.col(gain) > 0).groupBy(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).agg(F.max(F.col(gain).cast("double")).alias("gain")), "edges")
    # both sides share one id space: a as it is, b with all bits turned; ids that meet all the same only join components
    comps = connected_components(useful.select("a", F.bitwise_not("b").alias("b")), scratch)
    keyed = scratch.save(useful.join(comps, useful["a"] == comps["node"]).select("component", "a", "b", "gain"), "keyed")
    giants = scratch.save(keyed.groupBy("component").count().where(F.col("count") > large).select("component"), "giants")

    def several(t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("a", "ascending"), ("b", "ascending")])
        a, b, gain = (t[c].to_numpy() for c in ("a", "b", "gain"))
        starts = np.unique(t["component"].to_numpy(), return_index=True)[1].tolist()
        keep = [s + best_matching(a[s:e], b[s:e], gain[s:e]) for s, e in zip(starts, [*starts[1:], len(a)], strict=True)]
        return t.take(pa.array(np.concatenate(keep))).select(["a", "b", "gain"])

    # small rows, long work: tasks are dealt by the number of edges, as their bytes would make them one
    tasks = useful.count() // share + 1
    solve_each = lambda rows: rows.withColumn("_g", F.pmod(F.xxhash64("component"), F.lit(tasks))).repartition(tasks, "_g").groupBy("_g").applyInArrow(lambda t: several(t.drop_columns(["_g"])), "a long, b long, gain double")
    if giants.isEmpty():
        return solve_each(keyed)
    big = scratch.save(keyed.join(giants, "component", "left_semi"), "big")
    step = big.agg(F.max("gain")).first()[0] * tolerance
    return solve_each(keyed.join(giants, "component", "left_anti")).unionByName(auction(big.select("a", "b", "gain"), step, scratch))


def assign(candidates: DataFrame, unmatched: float, cost: str = "cost", a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, cost): least-cost one-to-one pairs where leaving a side unmatched costs ``unmatched``.

    A pair is worth 2 * unmatched - cost; chosen pairs that cost ``unmatched`` or
    more are discarded afterwards, though they hold their ends.
    """
    edges = candidates.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.lit(2 * unmatched) - F.col(cost)).alias("gain"))
    return match(edges).select("a", "b", (F.lit(2 * unmatched) - F.col("gain")).alias("cost")).where(F.col("cost") < unmatched)


def overlap_match(overlaps: DataFrame, a: str = "c1", b: str = "c2", n: str = "n") -> DataFrame:
    """(a, b, n): the one-to-one correspondence of clusters with the greatest total overlap."""
    return match(overlaps.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).cast("double").alias("gain"))).select("a", "b", F.col("gain").cast("long").alias("n"))


def best_claims(candidates: DataFrame, cost: str = "cost", a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, cost): each a takes its cheapest b, then each b its cheapest claimant; ties to the smaller id."""
    first = candidates.groupBy(a).agg(F.min(F.struct(F.col(cost).alias("c"), F.col(b).alias("o"))).alias("m")).select(a, F.col("m.o").alias(b), F.col("m.c").alias(cost))
    return first.groupBy(b).agg(F.min(F.struct(F.col(cost).alias("c"), F.col(a).alias("o"))).alias("m")).select(F.col("m.o").alias(a), b, F.col("m.c").alias(cost))


def cheapest_edge(candidates: DataFrame, cost: str = "cost", a: str = "a", b: str = "b") -> DataFrame:
    """One edge per pair, the cheapest."""
    return candidates.groupBy(a, b).agg(F.min(cost).alias(cost))

"""Numbers and ranks over whole tables, without a window in one task.

Rows are dealt out by ranges of their order and sorted within them; the ranges' row
counts, one number for each partition, are all that the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.scratch import Scratch

BINS, FEW = 1024, 4096
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def _sorted_parts(rows: DataFrame, order: Sequence[str | Column], scratch: Scratch) -> DataFrame:
    """``rows`` with _p, the range they lie in, and _k, their place there."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    saved = scratch.save(placed, "sorted")
    return saved.withColumn("_p", F.shiftright("_m", _ROW_BITS)).withColumn("_k", F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_m")


def _offsets(parts: DataFrame, size: Column) -> Column:
    """What the ranges before a row's own sum up to."""
    total, pairs = 0, []
    for r in parts.groupBy("_p").agg(size.cast("long").alias("n")).orderBy("_p").collect():  # a row for each partition
        pairs += [F.lit(r["_p"]), F.lit(total)]
        total += r["n"]
    return F.element_at(F.create_map(*pairs), F.col("_p")) if pairs else F.lit(0)


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, start: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``name``: their place in an order, from ``start``; nulls come first.  The order should tell all rows apart."""
    parts = _sorted_parts(rows, order, scratch or Scratch(rows.sparkSession, "numbered"))
    return parts.withColumn(name, (_offsets(parts, F.count("*")) + F.col("_k") + start).cast("long")).drop("_p", "_k")


def with_previous(rows: DataFrame, order: str, previous: str, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with the value of a column in the row before, in its order; null in the first."""
    scratch = scratch or Scratch(rows.sparkSession, "numbered")
    placed = scratch.save(numbered(rows, [order], "_n", scratch=scratch), "placed")
    before = placed.select((F.col("_n") + 1).alias("_n"), F.col(order).alias(previous))
    return placed.join(before, "_n", "left").drop("_n")


def running_sum(rows: DataFrame, order: str, column: str, name: str, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of a column of whole numbers over the rows up to and with each."""
    from pyspark.sql import Window

    parts = _sorted_parts(rows, [order], scratch or Scratch(rows.sparkSession, "numbered"))
    inside = F.sum(column).over(Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_s", inside).withColumn(name, (_offsets(parts, F.sum(column)) + F.col("_s")).cast("long")).drop("_p", "_k", "_s")


def with_file_rows(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``df``, as read from files, with ``name``: the rows' place, file by file in the order of their paths.

    A file's parts are ordered by where they begin in it, whatever task reads them;
    within a part rows come as they are read.
    """
    marked = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_r"))
    saved = Scratch(df.sparkSession, "numbered").save(marked, "read")
    return numbered(saved, ["_f", "_b", "_r"], name, start).drop("_f", "_b", "_r")


def _at_rank(values: DataFrame, k: int, lo: float, hi: float) -> float:
    """The value with ``k`` values before it, of finite x between lo and hi."""
    while lo < hi:
        share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        slot = F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("slot")
        seen = values.where(F.col("x").between(lo, hi)).groupBy(slot).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("slot").collect()
        for r in seen:  # BINS rows at most
            if k < r["n"]:
                break
            k -= r["n"]
        if r["n"] <= FEW:
            few = values.where(F.col("x").between(r["lo"], r["hi"])).collect()
            return sorted(v["x"] for v in few)[k]
        lo, hi = r["lo"], r["hi"]
    return lo


def exact_quantiles(rows: DataFrame, column: str | Column, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a column, linear between ranks, None where it has no values.

    Ranks are selected by histograms of ``BINS`` slots, each over the slot of the one
    before that holds the rank, until it holds ``FEW`` values; memory is bounded by
    these.  NaN counts as the greatest value.
    """
    col = F.col(column) if isinstance(column, str) else column
    x = col.cast("double")
    inf = float("inf")
    values = Scratch(rows.sparkSession, "quantile").save(rows.select(F.when(F.isnan(x), F.lit(inf)).otherwise(x).alias("x")).where("x is not null"), "values")
    finite = values.where(F.abs("x") < inf)
    r = values.agg(F.count("*").alias("n"), F.count(F.when(F.col("x") == -inf, 1)).alias("low"), F.count(F.when(F.col("x") == inf, 1)).alias("high")).first()
    ends = finite.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    known: dict[int, float] = {}

    def at(k: int) -> float:
        if k not in known:
            known[k] = -inf if k < r["low"] else inf if k >= r["n"] - r["high"] else _at_rank(finite, k - r["low"], ends["lo"], ends["hi"])
        return known[k]

    out: list[float | None] = []
    for q in shares:
        if not r["n"]:
            out.append(None)
            continue
        place = min(max(q, 0.0), 1.0) * (r["n"] - 1)
        a, b = math.floor(place), math.ceil(place)
        out.append(at(a) if a == b or at(a) == at(b) else at(a) * (b - place) + at(b) * (place - a))
    return out

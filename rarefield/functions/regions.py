"""Where a grain lies relative to an overlap window, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORE, HIGH, LOW, BND_HIGH, BND_LOW, CROSS = 1, 2, 3, 4, 5, 6

# The action for a matched pair, by the region of A (rows) and of B
# (columns), both in the order CORE, HIGH, LOW, BND-HIGH, BND-LOW, CROSS.
# MC merges, KA keeps A, KB keeps B, RJ rejects the match.
MATCH_RULES = """
MC KB RJ KA KA KA
RJ RJ RJ RJ RJ RJ
KA MC RJ MC KA KA
KB KB RJ KB MC KB
KB KB RJ MC KA KA
KB KB RJ KB MC MC
"""
# The action for an unmatched grain of A and of B, in the same order.
UNMATCHED_A = "REMOVE ERROR KEEP REMOVE KEEP REMOVE"
UNMATCHED_B = "KEEP KEEP ERROR KEEP REMOVE KEEP"


def z_extent(z="Z", radius="GrainRadius", zmin: str | None = None, zmax: str | None = None) -> tuple[Column, Column]:
    """The lower and upper end of a grain: given columns where they hold a value, else the radius and 0.1 % of it."""
    low = F.col(z) - F.col(radius) * 1.001
    high = F.col(z) + F.col(radius) * 1.001
    return (F.coalesce(F.col(zmin), low) if zmin else low), (F.coalesce(F.col(zmax), high) if zmax else high)


def region(low: Column, high: Column, zol: float, zoh: float) -> Column:
    """The region of a grain from ``low`` to ``high`` for the window from ``zol`` to ``zoh``."""
    return (
        F.when(high <= zol, LOW)
        .when(low >= zoh, HIGH)
        .when((low < zol) & (high > zoh), CROSS)
        .when((low < zol) & (high > zol), BND_LOW)
        .when((low < zoh) & (high > zoh), BND_HIGH)
        .otherwise(CORE)
    )


def match_rules(spark: SparkSession) -> DataFrame:
    """(ra, rb, action), 36 rows."""
    rows = [(i + 1, j + 1, a) for i, line in enumerate(MATCH_RULES.split("\n")[1:-1]) for j, a in enumerate(line.split())]
    return spark.createDataFrame(rows, "ra int, rb int, action string")


def unmatched_rules(spark: SparkSession) -> DataFrame:
    """(side, region, decision), 12 rows."""
    rows = [(side, k + 1, d) for side, line in (("A", UNMATCHED_A), ("B", UNMATCHED_B)) for k, d in enumerate(line.split())]
    return spark.createDataFrame(rows, "side string, region int, decision string")


def scan_windows(spark: SparkSession, zlo: float, zhi: float, n: int, overlap: float) -> DataFrame:
    """(scan, z0, z1): n windows of one height that cover [zlo, zhi], each overlapping the next by a share of it."""
    if n < 1 or not 0 <= overlap < 1:
        raise ValueError("at least one scan, and an overlap of at least 0 and below 1")
    h = (zhi - zlo) / (n - (n - 1) * overlap)
    step = h * (1 - overlap)
    return spark.createDataFrame([(k, zlo + k * step, zlo + k * step + h) for k in range(n)], "scan int, z0 double, z1 double")


def window_geometry(zlo: float, zhi: float, n: int, overlap: float) -> tuple[float, float]:
    """(height, step) of the windows."""
    h = (zhi - zlo) / (n - (n - 1) * overlap)
    return h, h * (1 - overlap)

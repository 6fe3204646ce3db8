"""Bounding boxes, filters and rescaling of coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.operators.ranking import numbered

Box = Sequence[tuple[float, float]]


def shrink_filter(points: DataFrame, box: Box, tolerance_percent: float = 0.0, coords: Sequence[str] = ("X", "Y", "Z"), order: str = "id") -> DataFrame:
    """Points within a box shrunk by a share of its extent at each side, both ends included, renumbered as ``row``."""
    ok = F.lit(True)
    for c, (lo, hi) in zip(coords, box, strict=False):
        t = (hi - lo) * tolerance_percent / 100
        ok = ok & F.col(c).between(lo + t, hi - t)
    return numbered(points.where(ok), [order], "row")


def extend_box(points: DataFrame, box: Box, tolerance: float = 0.0, coords: Sequence[str] = ("X", "Y", "Z"), strict: bool = False) -> list[tuple[float, float]]:
    """The box extended to hold all points, then by a share of its size; ``strict`` raises where a point lies outside."""
    r = points.agg(*[f(c).alias(f"{p}{c}") for c in coords for p, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for c, (lo, hi) in zip(coords, box, strict=False):
        if strict and (r[f"lo{c}"] < lo or r[f"hi{c}"] > hi):
            raise ValueError(f"{c} runs from {r[f'lo{c}']} to {r[f'hi{c}']}, beyond [{lo}, {hi}]")
        a, b = min(lo, r[f"lo{c}"]), max(hi, r[f"hi{c}"])
        out.append((a - tolerance * (b - a), b + tolerance * (b - a)))
    return out


def rescale(points: DataFrame, target: Box, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Coordinates mapped linearly from their own extent to the target's."""
    r = points.agg(*[f(c).alias(f"{p}{c}") for c in coords for p, f in (("lo", F.min), ("hi", F.max))]).first()
    out = points
    for c, (lo, hi) in zip(coords, target, strict=False):
        a, b = r[f"lo{c}"], r[f"hi{c}"]
        out = out.withColumn(c, (F.col(c) - a) / (b - a) * (hi - lo) + lo if b > a else F.lit((lo + hi) / 2))
    return out


def drop_small(cells: DataFrame, min_volume: float, volume: str = "volume") -> DataFrame:
    return cells.where(F.col(volume) >= min_volume)

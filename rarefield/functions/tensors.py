"""Tensors from column groups, rotations, interpolation and curve functions."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The two naming dialects, by order of the tensor.  A symmetric
# tensor is stored as six components and expands to nine.
AXES = {"simulation": ("x", "y", "z"), "experiment": ("0", "1", "2")}
FULL = tuple(f"{i}{j}" for i in "123" for j in "123")
SYMMETRIC = ("xx", "yy", "zz", "xy", "xz", "yz")
SYMMETRIC_OF = {"11": "xx", "22": "yy", "33": "zz", "12": "xy", "21": "xy", "13": "xz", "31": "xz", "23": "yz", "32": "yz"}


def component_columns(columns: Sequence[str], field: str, order: int, dialect: str = "simulation") -> list[str]:
    """The columns of a field in order: one, three or nine; six symmetric ones repeat to make nine."""
    have = set(columns)
    sep = "_" if dialect == "simulation" else ""
    if order == 0:
        names = [field]
    elif order == 1:
        names = [f"{field}{sep}{a}" for a in AXES[dialect]]
    elif order == 2:
        names = [f"{field}{sep}{c}" for c in FULL]
        if not have.issuperset(names):
            six = [f"{field}{sep}{SYMMETRIC_OF[c]}" for c in FULL]
            upper = [f"{field}{sep}{min(c)}{max(c)}" for c in FULL]
            names = six if have.issuperset(six) else upper
    else:
        raise ValueError("order is 0, 1 or 2")
    missing = sorted(set(names) - have)
    if missing:
        raise ValueError(f"field {field!r} lacks {missing}")
    return names


def tensor(columns: Sequence[str], field: str, order: int, dialect: str = "simulation") -> Column:
    """The components of a field as one array."""
    return F.array(*[F.col(c).cast("double") for c in component_columns(columns, field, order, dialect)])


def rotate_vector(r: Sequence[Sequence[float]] | np.ndarray, xyz: Sequence[str]) -> list[Column]:
    """Three columns turned by a constant matrix."""
    return [sum((F.col(c) * float(r[i][k]) for k, c in enumerate(xyz)), F.lit(0.0)) for i in range(3)]


def rotate_tensor(r: Sequence[Sequence[float]] | np.ndarray, nine: Sequence[str]) -> list[Column]:
    """R E R^T of nine columns, by row."""
    out = []
    for i in range(3):
        for j in range(3):
            out.append(sum((F.col(nine[3 * a + b]) * float(r[i][a] * r[j][b]) for a in range(3) for b in range(3)), F.lit(0.0)))
    return out


def rotation_xyz(ax: float, ay: float, az: float) -> np.ndarray:
    """Rz Ry Rx of angles in degrees."""
    x, y, z = np.radians([ax, ay, az])
    rx = np.array([[1, 0, 0], [0, np.cos(x), -np.sin(x)], [0, np.sin(x), np.cos(x)]])
    ry = np.array([[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]])
    rz = np.array([[np.cos(z), -np.sin(z), 0], [np.sin(z), np.cos(z), 0], [0, 0, 1]])
    return rz @ ry @ rx


def principal_rotation(points: DataFrame, xyz: Sequence[str]) -> np.ndarray:
    """The rotation to the principal axes, largest spread first; nine sums reach the driver."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    r = points.agg(*[F.covar_pop(xyz[i], xyz[j]).alias(f"c{i}{j}") for i, j in pairs]).first()
    c = np.zeros((3, 3))
    for i, j in pairs:
        c[i, j] = c[j, i] = r[f"c{i}{j}"]
    v = np.linalg.eigh(c)[1][:, ::-1]
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)
    if np.linalg.det(v) < 0:
        v[:, 2] *= -1
    return v.T


def mandel(prefix: str = "eKen") -> Column:
    """Strain in Mandel order 11, 22, 33, 23, 13, 12, shears times the square root of 2."""
    root = 2**0.5
    return F.array(*[F.col(f"{prefix}{c}").cast("double") * (root if c[0] != c[1] else 1.0) for c in ("11", "22", "33", "23", "13", "12")])


def volume_weights(grains: DataFrame, radius: str = "GrainRadius", name: str = "weight", dims: int = 3) -> DataFrame:
    """Shares of the total volume (area in two dimensions); the total is a one-row aggregate."""
    v = F.col(radius) ** dims
    total = grains.agg(F.sum(v).alias("_total"))
    return grains.crossJoin(total).withColumn(name, v / F.col("_total")).drop("_total")  # one row on the right


def resample(curve: DataFrame, at: DataFrame, x: str, y: str, query: str) -> DataFrame:
    """``at`` with ``y`` interpolated linearly at ``query``; null outside the curve."""
    pieces = curve.select(F.col(x).cast("double").alias("_x0"), F.col(y).cast("double").alias("_y0")).withColumn("_x1", F.lead("_x0").over(Window.orderBy("_x0"))).withColumn("_y1", F.lead("_y0").over(Window.orderBy("_x0")))
    last = F.col("_x1").isNull() & (F.col(query) == F.col("_x0"))
    met = at.join(pieces, (F.col(query) >= F.col("_x0")) & ((F.col(query) < F.col("_x1")) | last), "left")
    t = F.try_divide(F.col(query) - F.col("_x0"), F.col("_x1") - F.col("_x0"))
    value = F.when(F.col("_x1").isNull(), F.col("_y0")).otherwise(F.col("_y0") + t * (F.col("_y1") - F.col("_y0")))
    return met.withColumn(y, value).drop("_x0", "_y0", "_x1", "_y1")


def slope(curve: DataFrame, x: str, y: str, low: float, high: float) -> float:
    """The least-squares slope within a window of x; raises for fewer than two points."""
    r = curve.where(F.col(x).between(low, high)).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s")).first()
    if r["n"] < 2 or r["s"] is None:
        raise ValueError(f"{r['n']} points between {low} and {high}; a slope needs two")
    return float(r["s"])


def scale_factor(curve: DataFrame, reference: float, x: str, y: str, low: float, high: float) -> float:
    """reference / slope."""
    return reference / slope(curve, x, y, low, high)


def wide_fields(columns: Sequence[str]) -> dict[str, list[int]]:
    """Fields of ``<field>_<grain>`` columns, and their grains."""
    out: dict[str, list[int]] = {}
    for c in columns:
        m = re.fullmatch(r"(.+)_(\d+)", c)
        if m:
            out.setdefault(m[1], []).append(int(m[2]))
    return {f: sorted(g) for f, g in out.items()}


def distance_norm(predicted: str, measured: str) -> Column:
    """The L2 norm of the difference of two curves, as an aggregate."""
    d = F.col(predicted) - F.col(measured)
    return F.sqrt(F.sum(d * d))


def with_random_strains(grains: DataFrame, deviation: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``grains`` with a symmetric elastic strain eKen11 .. eKen33, each component normal around 0.

    The values follow from the grain's id and the seed alone, however the table is dealt
    out.
    """

    def uniform(k: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)

    def normal(k: int) -> Column:
        return F.sqrt(-2 * F.log(uniform(2 * k))) * F.cos(2 * math.pi * uniform(2 * k + 1)) * deviation

    parts = {"11": 0, "22": 1, "33": 2, "12": 3, "23": 4, "13": 5}
    drawn = {c: normal(k) for c, k in parts.items()}
    return grains.withColumns({f"eKen{i}{j}": drawn[min(i + j, j + i)] for i in "123" for j in "123"})

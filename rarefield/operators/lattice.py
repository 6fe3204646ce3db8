"""Points on a lattice: indices, spacing, neighbour edges, rasterisation.

Indices come from arithmetic on a column's least value and spacing, which are
single-row aggregates, so a point never needs the list of all levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.operators.ranking import exact_quantiles, running_sum, with_previous

AXES = ("x", "y", "z")
INDEX = ("ix", "iy", "iz")


def levels(points: DataFrame, axis: str, tol: float = 1e-9) -> DataFrame:
    """(level, value) of the distinct coordinates of an axis; values no further than ``tol`` apart are one level."""
    return _level_of_values(points, axis, "level", tol).groupBy("level").agg(F.min("value").alias("value"))


def _level_of_values(points: DataFrame, axis: str, name: str, tol: float) -> DataFrame:
    """(value, name) of the distinct coordinates of an axis."""
    distinct = points.select(F.col(axis).cast("double").alias("value")).distinct()
    gap = F.coalesce(F.col("value") - F.col("before"), F.lit(float("inf"))) > tol
    flagged = with_previous(distinct, "value", "before").select("value", gap.cast("long").alias("new"))
    return running_sum(flagged, "value", "new", "_n").select("value", (F.col("_n") - 1).alias(name))


def spacing(points: DataFrame, axis: str, how: str = "median", tol: float = 1e-9) -> DataFrame:
    """One row (n_levels, low, step, deviation): the step between neighbouring levels, and its greatest deviation.

    ``how`` is median or min; step is null for a single level.
    """
    steps = with_previous(levels(points, axis, tol), "value", "before").select("value", (F.col("value") - F.col("before")).alias("d"))
    pick = F.lit(exact_quantiles(steps, "d", [0.5])[0]).cast("double") if how == "median" else F.min("d")
    base = steps.agg(F.count("*").alias("n_levels"), F.min("value").alias("low"), pick.alias("step"), F.min("d").alias("dmin"), F.max("d").alias("dmax"))
    return base.select("n_levels", "low", "step", F.greatest(F.col("dmax") - F.col("step"), F.col("step") - F.col("dmin")).alias("deviation"))


def is_regular(points: DataFrame, axes: Sequence[str] = AXES, tol: float = 1e-6) -> bool:
    """Whether every axis with more than one level has equal steps (three levels at least, within tol * max(1, step))."""
    for axis in axes:
        r = spacing(points, axis).first()
        if r["n_levels"] == 1:
            continue
        if r["n_levels"] < 3 or r["deviation"] > tol * max(1.0, abs(r["step"])):
            return False
    return True


def is_full_grid(points: DataFrame, axes: Sequence[str] = AXES, tol: float = 1e-6) -> bool:
    """Whether the points are regular and occupy each node of the lattice once."""
    if not is_regular(points, axes, tol):
        return False
    sizes = [spacing(points, a).first()["n_levels"] for a in axes]
    n = 1
    for s in sizes:
        n *= s
    got = points.select(*axes).agg(F.count("*").alias("n"), F.count_distinct(*axes).alias("d")).first()
    return got["n"] == got["d"] == n


def voxel_index(c, origin, step) -> Column:
    """round((c - origin) / step), halves to even."""
    col = F.col(c) if isinstance(c, str) else c
    return F.rint((col - origin) / step).cast("long")


def with_index(points: DataFrame, axes: Sequence[str] = AXES, names: Sequence[str] = INDEX, steps: Sequence[float] | None = None, origin: Sequence[float] | None = None) -> DataFrame:
    """``points`` with integer lattice indices; missing origins and steps come from one aggregate each."""
    if origin is None:
        low = points.agg(*[F.min(a).alias(a) for a in axes]).first()
        origin = [low[a] if low[a] is not None else 0.0 for a in axes]
    if steps is None:
        steps = [spacing(points, a).first()["step"] or 1.0 for a in axes]
    out = points
    for a, n, o, s in zip(axes, names, origin, steps, strict=True):
        out = out.withColumn(n, voxel_index(a, float(o), float(s)))
    return out


def with_nearest_level(points: DataFrame, axis: str, name: str, tol: float = 1e-9) -> DataFrame:
    """``points`` with the index of the nearest level of an irregular axis, the lower one on ties.

    A distinct coordinate within ``tol`` of its neighbours joins their level, so the
    index is a lookup by value.
    """
    table = _level_of_values(points, axis, name, tol)
    return points.join(table, points[axis].cast("double") == table["value"], "left").drop("value")


def offsets(radius: int, half: bool = True, metric: str = "manhattan", dims: int = 3) -> list[tuple[int, ...]]:
    """Lattice offsets within ``radius``, without zero; ``half`` keeps one of each opposite pair."""
    out = []
    for d in product(range(-radius, radius + 1), repeat=dims):
        size = sum(map(abs, d)) if metric == "manhattan" else max(map(abs, d))
        if 0 < size <= radius and (not half or d > (0,) * dims):
            out.append(d)
    return out


def grid_edges(nodes: DataFrame, radius: int = 1, id_col: str = "id", index: Sequence[str] = INDEX, metric: str = "manhattan") -> DataFrame:
    """(src, dst), src < dst, of nodes at most ``radius`` lattice steps apart.

    Only half of the offsets are generated, as literals within the row, and met by
    one equi-join on the index.
    """
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(d, ("a", "b", "c"), strict=False)]) for d in offsets(radius, True, metric, len(index))])
    here = nodes.select(F.col(id_col).alias("_i"), *index, F.explode(steps).alias("_d"))
    there = nodes.select(F.col(id_col).alias("_j"), *[F.col(n).alias(f"_{n}") for n in index])
    on = [F.col(n) + F.col(f"_d.{k}") == F.col(f"_{n}") for n, k in zip(index, ("a", "b", "c"), strict=False)]
    met = here
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return met.join(there, cond).where("_i != _j").select(F.least("_i", "_j").alias("src"), F.greatest("_i", "_j").alias("dst"))


def neighbours(nodes: DataFrame, connectivity: int = 6, id_col: str = "id", index: Sequence[str] = INDEX) -> DataFrame:
    """(id, nbr, k): the 6 or 26 lattice neighbours of each node with their offset's number, both directions."""
    if connectivity not in (6, 26):
        raise ValueError("connectivity is 6 or 26")
    ds = offsets(1, False, "manhattan" if connectivity == 6 else "chebyshev", len(index))
    steps = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for v, n in zip(d, ("a", "b", "c"), strict=False)]) for k, d in enumerate(ds)])
    here = nodes.select(F.col(id_col).alias("id"), *index, F.explode(steps).alias("_d"))
    there = nodes.select(F.col(id_col).alias("nbr"), *[F.col(n).alias(f"_{n}") for n in index])
    cond = F.lit(True)
    for n, k in zip(index, ("a", "b", "c"), strict=False):
        cond = cond & (F.col(n) + F.col(f"_d.{k}") == F.col(f"_{n}"))
    return here.join(there, cond).select("id", "nbr", F.col("_d.k").alias("k"))


def first_per_cell(cells: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """One row per cell with the value of its first row by ``order``; combines before it shuffles."""
    return cells.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def occupied(points: DataFrame, origin: Sequence[float], steps: Sequence[float], cluster: str, order: str, axes: Sequence[str] = AXES) -> DataFrame:
    """(ix, iy, iz, cluster) of the occupied cells, the first cluster of each."""
    indexed = with_index(points, axes, INDEX, steps, origin)
    return first_per_cell(indexed, INDEX, cluster, order)


def rasterise(cells: DataFrame, coarse: Sequence[float], fine: float, cluster: str) -> DataFrame:
    """Coarse cells as cells of a finer lattice: every fine cell whose nearest coarse cell is occupied.

    Each coarse cell explodes the fine indices around it and keeps those that round
    back to it, so no two coarse cells claim one fine cell.
    """
    if all(abs(c - fine) < 1e-12 for c in coarse):
        return cells.select(*[F.col(n).alias(f) for n, f in zip(INDEX, ("fx", "fy", "fz"), strict=True)], cluster)
    out = cells
    for n, f, c in zip(INDEX, ("fx", "fy", "fz"), coarse, strict=True):
        ratio = c / fine
        low = F.ceil((F.col(n) - 0.5) * ratio - 1e-9).cast("long")
        high = F.floor((F.col(n) + 0.5) * ratio + 1e-9).cast("long")
        out = out.withColumn(f, F.explode(F.sequence(low, high))).where(F.rint(F.col(f) * fine / c).cast("long") == F.col(n))
    return out.select("fx", "fy", "fz", cluster)


def hex_lattice(nx: int, ny: int, nz: int, a: float, dz: float, spark) -> DataFrame:
    """(x, y, z) of a triangular lattice with side ``a`` in ``nz`` layers, distinct after rounding to 10 places."""
    rows = spark.range(nx * ny * nz)
    ix, iy, iz = F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny))
    x = (ix + F.when(iy % 2 == 1, F.lit(0.5)).otherwise(F.lit(0.0))) * a
    y = iy * (a * 3**0.5 / 2)
    return rows.select(F.round(x, 10).alias("x"), F.round(y, 10).alias("y"), F.round(iz * dz, 10).alias("z")).distinct()

"""Simulation and experiment results: wide tables, tensors by grain or step, macroscopic curves, distributions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefield.functions.tensors import tensor, wide_fields
from rarefield.sources.schema import require_columns, strip_headers

MACRO = ("xx", "xy", "xz", "yy", "yz", "zz")


def long_blocks(wide: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """(step, time, grain, one column a field) of a wide block table with ``time`` and ``<field>_<grain>`` columns."""
    wide = strip_headers(wide)
    require_columns(wide, ["time"])
    known = wide_fields(wide.columns)
    chosen = list(fields) if fields is not None else sorted(known)
    missing = [f for f in chosen if f not in known]
    if missing:
        raise ValueError(f"no columns of the fields {missing}")
    grains = sorted({g for f in chosen for g in known[f]})
    stepped = wide.withColumn("step", F.row_number().over(Window.orderBy("time")) - 1)
    one = lambda g: F.struct(F.lit(g).cast("long").alias("grain"), *[(F.col(f"{f}_{g}") if g in known[f] else F.lit(None)).cast("double").alias(f) for f in chosen])
    return stepped.select("step", "time", F.explode(F.array(*[one(g) for g in grains])).alias("_g")).select("step", "time", "_g.*")


def steps_of(rows: DataFrame, step: str = "step") -> DataFrame:
    return rows.select(step).distinct()


def with_time(rows: DataFrame, step_to_time: Mapping[int, float] | Callable[[float], float] | None = None, step: str = "step") -> DataFrame:
    """``rows`` with ``time``: the step itself, a table's entry, or a function of it, evaluated once per step."""
    if step_to_time is None:
        return rows.withColumn("time", F.col(step).cast("double"))
    known = [r[0] for r in rows.select(step).distinct().collect()]
    get = step_to_time if callable(step_to_time) else lambda s: step_to_time[s]
    table = rows.sparkSession.createDataFrame([(s, float(get(s))) for s in known], f"{step} {rows.schema[step].dataType.simpleString()}, time double")
    return rows.join(F.broadcast(table), step, "left")  # one row a step


def tensor_block(rows: DataFrame, field: str, order: int, sample: str, value: int, dialect: str = "simulation", grain: str = "grain", step: str = "step") -> DataFrame:
    """(step or grain, value): a field of one grain over all steps ('time'), or of all grains at one step ('id').

    Over time, steps in which the grain is missing have NaN components.
    """
    t = tensor(rows.columns, field, order, dialect).alias("value")
    if sample == "id":
        return rows.where(F.col(step) == value).select(grain, t)
    if sample != "time":
        raise ValueError("sample is time or id")
    mine = rows.where(F.col(grain) == value).select(step, t)
    empty = F.array_repeat(F.lit(float("nan")), {0: 1, 1: 3, 2: 9}[order])
    return steps_of(rows, step).join(mine, step, "left").select(step, F.coalesce("value", empty).alias("value"))


def tensor_element(rows: DataFrame, field: str, order: int, sample: str, value: int, dialect: str = "simulation", element: str = "id", step: str = "step") -> DataFrame:
    """As :func:`tensor_block` for element fields; raises where an element has no row or several in a step."""
    if dialect == "experiment":
        raise NotImplementedError("experiments have no element fields")
    if sample == "time":
        n = rows.where(F.col(element) == value).groupBy(step).agg(F.count("*").alias("n"))
        bad = steps_of(rows, step).join(n, step, "left").where(F.coalesce("n", F.lit(0)) != 1)
        if not bad.isEmpty():
            raise ValueError(f"element {value} does not have one row in each step")
    return tensor_block(rows, field, order, sample, value, dialect, element, step)


def track_by_row(rows: DataFrame, step: str = "step", order: str = "row_id") -> DataFrame:
    """``rows`` with ``grain``: the row's place within its step."""
    return rows.withColumn("grain", (F.row_number().over(Window.partitionBy(step).orderBy(order)) - 1).cast("long"))


def macro_curve(rows: DataFrame, fields: Sequence[str], volume: str = "volume", step: str = "step", time: str = "time") -> DataFrame:
    """Volume-weighted means of fields per step, the first step left out."""
    first = rows.agg(F.min(step).alias("_first"))
    weighted = [(F.sum(F.col(f) * F.col(volume)) / F.sum(volume)).alias(f) for f in fields]
    return rows.crossJoin(first).where(F.col(step) > F.col("_first")).groupBy(step, time).agg(*weighted)  # one row on the right


def macro_tensor(rows: DataFrame, field: str, volume: str = "volume", step: str = "step", time: str = "time") -> DataFrame:
    """The six independent components of a symmetric field's macroscopic mean."""
    return macro_curve(rows, [f"{field}_{c}" for c in MACRO], volume, step, time)


def axial_strain(rows: DataFrame, column: str, grain: str = "grain", step: str = "step") -> DataFrame:
    """(step, strain): the mean over grains relative to the first step."""
    mean = rows.groupBy(step).agg(F.avg(column).alias("m"))
    return mean.select(step, (F.col("m") - F.first("m").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))).alias("strain"))


def reconstruct_errors(grains: DataFrame, truth: DataFrame, id_col: str = "id", dims: int = 3) -> DataFrame:
    """(id, position_error, radius_error_percent) of a tessellation against its input."""
    xyz = ("X", "Y", "Z")[:dims]
    t = truth.select(F.col(id_col), *[F.col(c).alias(f"_t{c}") for c in xyz], F.col("GrainRadius").alias("_tr"))
    d2 = sum(((F.col(c) - F.col(f"_t{c}")) ** 2 for c in xyz), F.lit(0.0))
    return grains.join(t, id_col).select(id_col, F.sqrt(d2).alias("position_error"), (F.abs(F.col("GrainRadius") - F.col("_tr")) / F.col("_tr") * 100).alias("radius_error_percent"))

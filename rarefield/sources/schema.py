"""Column checks and coercion shared by the readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raises for missing columns, naming all of them."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns as doubles; what is no number becomes NaN."""
    nan = F.lit(float("nan"))
    return df.withColumns({n: F.coalesce(F.expr(f"try_cast(`{n}` AS double)"), nan) for n in names})


def reject_nan(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raises if a column holds nulls or NaN; one pass over the data."""
    bad = df.agg(*[F.count(F.when(F.col(n).isNull() | F.isnan(F.col(n).cast("double")), 1)).alias(n) for n in names]).first().asDict()
    found = {n: c for n, c in bad.items() if c}
    if found:
        raise ValueError(f"missing or non-numeric values: {found}")
    return df

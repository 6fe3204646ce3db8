"""Load steps as a stream: files that land in a folder become per-step aggregates.

An extension: step files arrive while a simulation runs, and a step's summary can
be kept up to date without polling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_steps(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows of the files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def step_means(rows: DataFrame, fields: Sequence[str], volume: str = "volume", step: str = "step") -> DataFrame:
    """Volume-weighted means per step; state is one row a step."""
    return rows.groupBy(step).agg(*[(F.sum(F.col(f) * F.col(volume)) / F.sum(volume)).alias(f) for f in fields], F.count("*").alias("n"))


def windowed_means(rows: DataFrame, value: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """Means per time window and key; windows close once rows can be no later than ``late``."""
    windowed = rows.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return windowed.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "mean", "n")

"""Keeps the curves of a load test up to date while its result files land.

A test writes measurements step by step: a time, a grain, a field and a value.  Each
run takes the files that came since the last one (a file stream with a checkpoint,
``availableNow``) and leaves three tables below ``out``:

- ``rows``, by step and batch: the measurements taken in, those without a time, a
  field or a finite value left out;
- ``summary``, by step: for each field n, the number of grains, least, greatest,
  sum and sum of squares.  Only the steps that a batch touches are made again, from
  all their rows, so late files of an old step are no special case;
- ``curve``, by field: n, grains, mean, deviation, least and greatest of each step,
  and the change of the mean since the field's first step.

A measurement that is delivered again (same step and id) counts once, as it came
last.  A batch that is tried again overwrites its own partitions, so a run that
failed is run again and gives the same tables; so is one with nothing new.

    python -m jobs.step_curve --source <files> --out <folder> --checkpoint <folder> [--config jobs/step_curve.json]
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import command_line, log, overwrite_partitions, ready_folder
from rarefield.operators.clusters import cluster_summary, rarity_stats
from rarefield.sources.schema import require_columns
from rarefield.streaming.steps import read_steps

#: The settings and what they are by default; ``step_curve.json`` holds the same.
DEFAULTS = {"format": "parquet", "id": "event_id", "time": "ts", "grain": "user_id", "field": "event_type", "value": "value", "step": "day", "files_per_trigger": 100}
ROWS = "id long, grain long, field string, value double, step date, batch long"
SUMMARY = "field string, n long, grains long, value_min double, value_max double, value_sum double, value_sumsq double, step date"
CURVE = "step date, n long, grains long, mean double, std double, low double, high double, change double, field string"


def measurements(rows: DataFrame, c: dict[str, Any]) -> DataFrame:
    """(id, grain, field, value, step) of the rows that can be used; ``step`` is the start of a day, week or month."""
    value = F.col(c["value"]).cast("double")
    usable = F.col(c["time"]).isNotNull() & F.col(c["field"]).isNotNull() & (F.abs(value) < float("inf"))
    step = F.date_trunc(c["step"], F.col(c["time"])).cast("date")
    return rows.where(usable & ~F.isnan(value)).select(F.col(c["id"]).cast("long").alias("id"), F.col(c["grain"]).cast("long").alias("grain"), F.col(c["field"]).cast("string").alias("field"), value.alias("value"), step.alias("step"))


def last_deliveries(rows: DataFrame) -> DataFrame:
    """One row for each step and id, that of the last batch; rows without an id are rows of their own."""
    named = rows.where("id is not null").groupBy("step", "id").agg(F.max(F.struct("batch", "field", "grain", "value")).alias("m")).select("step", "m.field", "m.grain", "m.value")
    return named.unionByName(rows.where("id is null").select("step", "field", "grain", "value"))


def summarised(rows: DataFrame) -> DataFrame:
    """The rows of ``SUMMARY``: the library's cluster summary, a cluster being a step's field."""
    marked = last_deliveries(rows).withColumn("at", F.struct("step", "field"))
    sums = cluster_summary(marked, "at", ["value"], [])
    grains = marked.groupBy("at").agg(F.count_distinct("grain").alias("grains"))
    return sums.join(grains, "at").select("at.field", "n", "grains", "value_min", "value_max", "value_sum", "value_sumsq", "at.step")


def curves(summary: DataFrame) -> DataFrame:
    """The rows of ``CURVE``; a field has one row a step."""
    found = rarity_stats(summary, ["value"])
    first = F.first("value_mean").over(Window.partitionBy("field").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return found.select("step", "n", "grains", F.col("value_mean").alias("mean"), F.col("value_std").alias("std"), F.col("value_min").alias("low"), F.col("value_max").alias("high"), (F.col("value_mean") - first).alias("change"), "field")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict[str, Any] | None = None) -> DataFrame:
    """Takes in what is new below ``source`` and returns the whole ``curve`` table as it stands."""
    c = DEFAULTS | (config or {})
    at = {name: f"{out.rstrip('/')}/{name}" for name in ("rows", "summary", "curve")}
    schema = spark.read.format(c["format"]).load(source).schema
    stream = read_steps(spark, source, schema, c["format"], int(c["files_per_trigger"]))
    require_columns(stream, [c[k] for k in ("id", "time", "grain", "field", "value")])
    for name, kinds, parts in (("rows", ROWS, ("step", "batch")), ("summary", SUMMARY, ("step",)), ("curve", CURVE, ("field",))):
        ready_folder(spark, at[name], kinds, *parts)

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        overwrite_partitions(measurements(batch, c).withColumn("batch", F.lit(number)), at["rows"], "step", "batch")
        rows = own.read.schema(ROWS).parquet(at["rows"])
        touched = rows.where(F.col("batch") == number).select("step").distinct()
        overwrite_partitions(summarised(rows.join(touched, "step", "left_semi")), at["summary"], "step")
        log.info("batch %d: %d measurements kept, %d steps made again", number, rows.where(F.col("batch") == number).count(), touched.count())

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: read %d rows in %d batches", source, sum(p.numInputRows for p in query.recentProgress), len(query.recentProgress))
    overwrite_partitions(curves(spark.read.schema(SUMMARY).parquet(at["summary"])), at["curve"], "field")
    result = spark.read.schema(CURVE).parquet(at["curve"])
    log.info("%s: wrote %d rows", at["curve"], result.count())
    return result


if __name__ == "__main__":
    command_line(run, "Curves by load step, kept up to date", "source", "out", "checkpoint")

"""Runnable jobs: each has a function that takes a session and plain paths, a command line and a small config file."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON object, from any place that Spark can read."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def ready_folder(spark: SparkSession, path: str, schema: str, *partitions: str) -> None:
    """Makes sure that a partitioned table is there, without rows where it is new."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes ``rows``, replacing just the partitions they belong to: a second try leaves the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def overwrite_table(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes ``rows`` in place of the whole table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(path)


def command_line(run: Callable[..., DataFrame], description: str, *paths: str) -> None:
    """Parses the paths and the config file, runs the job in a session of its own and stops that."""
    parser = argparse.ArgumentParser(description=description)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file of settings; the defaults are in the job's own .json file")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = given.pop("config")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        run(spark, **given, config=read_config(spark, config) if config else None)
    finally:
        spark.stop()

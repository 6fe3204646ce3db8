"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again:
an executor that is lost afterwards costs a re-read, never a recomputation of
the rounds before.  The folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PLANNED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        folder = tempfile.mkdtemp(prefix="rarefield-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def join_by_measured_size(spark: SparkSession) -> None:
    """From now on the session broadcasts a join's side by what adaptive execution measured of it, never by the size of its files.

    Parquet holds ids, cells and counters in a hundredth of what they take as a hash
    table, so a side of a few MB on disk can fill the driver.  The threshold stays the
    session's own; explicit ``broadcast`` hints stay as they are.
    """
    if spark.conf.get(_MEASURED, None) is None:
        spark.conf.set(_MEASURED, spark.conf.get(_PLANNED))
    spark.conf.set(_PLANNED, "-1")


class Scratch:
    """Writes intermediate results as Parquet below one folder and removes those that are superseded."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``df`` as a table read back from storage."""
        self._n += 1
        path = f"{self.root}/{name}-{self._n:03d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._rarefield_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables made by :meth:`save` that no later plan reads."""
        for df in frames:
            self.remove(df._rarefield_path)

    def remove(self, folder: str) -> None:
        """Removes a folder below the root."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

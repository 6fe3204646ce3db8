"""Sends this package to the executors, so that Python workers can import it wherever the driver runs from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ensure_shipped(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context, and bounds the bytes of an Arrow batch.

    The default bound is 64 MB, of which a Python worker holds several with what it
    derives from them; rows of long texts would fill an executor.
    """
    spark.conf.set(_LIMIT, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_rarefield_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="rarefield-"), "rarefield.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._rarefield_shipped = True

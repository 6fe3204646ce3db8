"""Finds the tables in a collection of reports and picks out those of a rare shape.

Scan reports come as text with tables in it: lines of cells between bars.  The job
cuts them into cells, groups the lines by shape (language and number of cells), and
treats the shapes as rare-event analysis treats clusters: those no larger than a
quantile of the sizes are rare, and get block numbers from 2 on; all others are in
block 1.  It leaves three tables below ``out``:

- ``lines``: document, line, cells, numbers among them, characters, the block;
- ``cells``, of rare shapes only: what a person looks at next, a number where the
  cell is one;
- ``shapes``: n, documents, mean and deviation of characters and of numbers, the
  block.

All are partitioned by language.  A run makes its tables again, so it is repeated
safely.  With ``languages`` in the config it takes only these, compares their shapes
among themselves and replaces their partitions alone.

    python -m jobs.text_tables --source <documents> --out <folder> [--config jobs/text_tables.json]
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import command_line, log, overwrite_partitions, overwrite_table
from rarefield.operators.clusters import apply_blocks, block_numbers, cluster_summary, default_rare, rarity_stats
from rarefield.sources.schema import require_columns

#: The settings and what they are by default; ``text_tables.json`` holds the same.
DEFAULTS = {"format": "parquet", "id": "doc_id", "text": "text", "lang": "lang", "bar": "|", "least_cells": 2, "quantile": 0.05, "languages": None}
UNKNOWN = "und"  # of documents without a language
NUMBER = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
LINES = "doc_id long, line int, cells int, numbers int, chars int, block_id long, lang string"
CELLS = "doc_id long, line int, cell int, text string, number double, block_id long, lang string"
SHAPES = "cells int, n long, documents long, chars_mean double, chars_std double, numbers_mean double, numbers_std double, block_id long, lang string"
_WHITE = " \t\r\x0b\x0c"


def table_lines(docs: DataFrame, c: dict[str, Any]) -> DataFrame:
    """(doc_id, lang, line, text) of the lines with bars; a document's other lines are never exploded."""
    bar = c["bar"]
    lang = F.coalesce(F.nullif(F.trim(F.col(c["lang"])), F.lit("")), F.lit(UNKNOWN))
    split = F.transform(F.split(F.col(c["text"]), "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    with_bar = F.filter(split, lambda x: F.contains(x["text"], F.lit(bar)))
    rows = docs.where(F.contains(F.col(c["text"]), F.lit(bar))).select(F.col(c["id"]).cast("long").alias("doc_id"), lang.alias("lang"), F.explode(with_bar).alias("x"))
    return rows.select("doc_id", "lang", "x.line", "x.text")


def cut(lines: DataFrame, c: dict[str, Any]) -> DataFrame:
    """(doc_id, lang, line, parts, cells, numbers, chars, shape); bars at a line's ends make no cells."""
    bar = c["bar"]
    inner = F.btrim(F.btrim("text", F.lit(_WHITE)), F.lit(bar))
    parts = F.transform(F.split(inner, f"\\Q{bar}\\E", -1), lambda x: F.btrim(x, F.lit(_WHITE)))
    found = lines.select("doc_id", "lang", "line", parts.alias("parts"), F.length("text").alias("chars"))
    sized = found.withColumn("cells", F.size("parts")).where(F.col("cells") >= int(c["least_cells"]))
    return sized.withColumn("numbers", F.size(F.filter("parts", lambda x: x.rlike(NUMBER)))).withColumn("shape", F.struct("lang", "cells"))


def shapes_of(lines: DataFrame, quantile: float) -> DataFrame:
    """A row for each shape, the library's cluster summary, with its block."""
    sums = rarity_stats(cluster_summary(lines, "shape", [], ["chars", "numbers"]), ["chars", "numbers"])
    documents = lines.select("shape", "doc_id").distinct().groupBy("shape").agg(F.count("*").alias("documents"))
    blocks = block_numbers(default_rare(quantile, label="shape")(sums), label="shape")
    return apply_blocks(sums.join(documents, "shape"), blocks, label="shape")


def run(spark: SparkSession, source: str, out: str, config: dict[str, Any] | None = None) -> DataFrame:
    """Makes the tables again and returns ``lines`` with what ``shapes`` tells of each."""
    c = DEFAULTS | (config or {})
    at = {name: f"{out.rstrip('/')}/{name}" for name in ("lines", "cells", "shapes")}
    docs = spark.read.format(c["format"]).load(source)
    require_columns(docs, [c[k] for k in ("id", "text", "lang")])
    lines = cut(table_lines(docs, c), c)
    if c["languages"]:
        lines = lines.where(F.col("lang").isin(list(c["languages"])))
    write = overwrite_partitions if c["languages"] else overwrite_table
    shapes = shapes_of(lines, float(c["quantile"])).select("shape.cells", "n", "documents", "chars_mean", "chars_std", "numbers_mean", "numbers_std", "block_id", "shape.lang")
    write(shapes, at["shapes"], "lang")
    known = spark.read.schema(SHAPES).parquet(at["shapes"])  # the lines are cut again, the shapes are not counted again
    placed = lines.join(known.select("lang", "cells", "block_id"), ["lang", "cells"])
    write(placed.select("doc_id", "line", "cells", "numbers", "chars", "block_id", "lang"), at["lines"], "lang")
    rare = placed.where("block_id > 1").select("doc_id", "line", F.posexplode("parts").alias("cell", "text"), "block_id", "lang")
    number = F.when(F.col("text").rlike(NUMBER), F.col("text").try_cast("double")).alias("number")
    write(rare.select("doc_id", "line", "cell", "text", number, "block_id", "lang"), at["cells"], "lang")
    written = spark.read.schema(LINES).parquet(at["lines"])
    log.info("%s: read; %s: %d lines in %d shapes, %d rare", source, out, written.count(), known.count(), known.where("block_id > 1").count())
    return written.join(known.drop("block_id"), ["lang", "cells"])


if __name__ == "__main__":
    command_line(run, "Tables in reports, by shape", "source", "out")

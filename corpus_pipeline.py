"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Language identification drops documents without a language; line deduplication
removes repeated lines, and documents of which nothing is left; MinHash keeps one
document of each near-duplicate group; decontamination drops documents that hold
a benchmark item; the last stage encodes what is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefield.llm import decontaminate, language, lines, minhash, pieces
from rarefield.llm.queries import PIECES, tokenizer
from rarefield.scratch import Scratch
from rarefield.shipping import ensure_shipped

ROW = "__row"  # the number of a row within a stage
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a number for each row, written so that the numbers stay; ids may repeat or be null, rows not."""
    return scratch.save(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(numbered: DataFrame, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``numbered`` whose number is not in the only column of ``dropped``, less their number."""
    gone = scratch.save(dropped.select(F.col(dropped.columns[0]).alias("__drop")).distinct(), "dropped")
    return numbered.join(gone, numbered[ROW] == gone["__drop"], "left_anti").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language: those with letters, of any learned language.

    Null and empty texts and texts without letters go; so does everything where no
    row has a language to learn from.  Each row is judged alone, equal rows alike; rows
    with a null id are judged and never learned from; all columns stay as they are.
    """
    ensure_shipped(spark)
    profiles = language.learn_profiles(docs.where(~language.held_out(docs)))
    return language.keep_identified(docs, profiles)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document of which only blank lines are left goes, ``n_chars`` follows the text.

    Null texts and texts without long lines stay as they are, and so do rows with a
    null id; of equal rows (same id and text) all keep the same lines.  A text of any
    length is split whole; ``n_chars`` may be missing.
    """
    ensure_shipped(spark)
    done = lines.dedup_lines(docs).where(F.col("dropped_lines").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("dropped_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return done.select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that of the least id: five-word shingles, similarity 0.8 or more.

    Each row is a document of its own, also where an id repeats or is null, so equal
    rows are a group (one stays) and different texts of one id are not.  Null and
    blank texts are in no group and stay; nulls come last among ids.
    """
    ensure_shipped(spark)
    scratch = Scratch(spark, "pipeline")
    rows = _numbered(docs, scratch)
    found = minhash.near_duplicates(rows, shingle=5, percent=80, id_col=ROW).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ids = rows.select(F.col(ROW).alias("row"), F.col("doc_id").alias("id"))
    placed = scratch.save(found.join(ids, "row"), "placed")
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("m")).select("m.row")
    return _without(rows, placed.join(first, "row", "left_anti").select("row"), scratch)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy, also an edited one, of a benchmark item.

    Each row is judged by its own text, also where an id repeats or is null; null and
    empty texts stay, and so does everything where there are no items.
    """
    ensure_shipped(spark)
    scratch = Scratch(spark, "pipeline")
    rows = _numbered(docs, scratch)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _without(rows, decontaminate.contaminated(rows, benchmark, id_col=ROW).select("doc_id"), scratch)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every document.

    One row for each row of ``docs``, in any number and with any id; a null or empty
    text has no ids.
    """
    ensure_shipped(spark)
    return pieces.encode_checked(docs, tokenizer(PIECES))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("encode", encode),
]

#: SQL expresses neither the fitted profiles nor the tokenizer; the tests hold run() and each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs

"""The jobs as queries: each runs twice over whole tables into one new folder and returns its output as it stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import step_curve, text_tables
from rarefield.scratch import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def job1_step_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    source = f"{sf_dir.rstrip('/')}/event[s].parquet"  # a file stream takes a single file only as a pattern
    for _ in range(2):
        result = step_curve.run(spark, source, out, f"{out}/checkpoint")
    return _rounded(result).withColumn("step", F.col("step").cast("string"))


def job2_text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):
        result = text_tables.run(spark, f"{sf_dir.rstrip('/')}/documents.parquet", out)
    return _rounded(result)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_step_curve": job1_step_curve, "job2_text_tables": job2_text_tables}


_JOB1 = """
WITH m AS (
  SELECT ts::DATE AS step, event_type AS field, count(*) AS n, count(DISTINCT user_id) AS grains, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND isfinite(value) GROUP BY 1, 2
)
SELECT step::VARCHAR AS step, n, grains, round(mean, 4) AS mean, round(std, 4) AS std, round(low, 4) AS low, round(high, 4) AS high,
  round(mean - first_value(mean) OVER (PARTITION BY field ORDER BY step), 4) AS change, field
FROM m
"""

_TRIM = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_JOB2 = f"""
WITH raw AS (
  SELECT doc_id, coalesce(nullif(trim(lang), ''), 'und') AS lang, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, '|')
), lines AS (
  SELECT doc_id, lang, (i - 1)::INT AS line, ls[i] AS text FROM raw, unnest(range(1, len(ls) + 1)) AS t(i) WHERE contains(ls[i], '|')
), parts AS (
  SELECT doc_id, lang, line, length(text)::INT AS chars, list_transform(string_split(trim(trim(text, {_TRIM}), '|'), '|'), lambda x: trim(x, {_TRIM})) AS p FROM lines
), cut AS (
  SELECT *, len(p)::INT AS cells, len(list_filter(p, lambda x: regexp_full_match(x, '[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?')))::INT AS numbers FROM parts WHERE len(p) >= 2
), shapes AS (
  SELECT lang, cells, count(*) AS n, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS documents, avg(chars) AS chars_mean, stddev_pop(chars) AS chars_std, avg(numbers) AS numbers_mean, stddev_pop(numbers) AS numbers_std
  FROM cut GROUP BY 1, 2
), rare AS (
  SELECT lang, cells, row_number() OVER (ORDER BY n, lang, cells) + 1 AS block_id FROM shapes WHERE n <= (SELECT quantile_cont(n, 0.05) FROM shapes)
)
SELECT c.lang, c.cells, c.doc_id, c.line, c.numbers, c.chars, coalesce(r.block_id, 1)::BIGINT AS block_id, s.n, s.documents,
  round(chars_mean, 4) AS chars_mean, round(chars_std, 4) AS chars_std, round(numbers_mean, 4) AS numbers_mean, round(numbers_std, 4) AS numbers_std
FROM cut AS c JOIN shapes AS s USING (lang, cells) LEFT JOIN rare AS r USING (lang, cells)
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_step_curve": _JOB1, "job2_text_tables": _JOB2}

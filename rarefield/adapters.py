"""The shared test tables as points, grains, steps and regions.

Coordinates and sums are exact integers where a comparison depends on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefield.sources.tables import read_table

MX, MY = 20, 20


def field_points(spark: SparkSession, sf_dir: str, mx: int = MX, my: int = MY) -> DataFrame:
    """(id, x, y, z, n, qty, price100, disc100, tax100): lattice cells of ``lineitem``, sums in whole units."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    x, y, z = F.col("l_partkey") % mx, F.col("l_suppkey") % my, F.col("l_linenumber").cast("long")
    whole = lambda c, k: F.sum(F.round(F.col(c) * k).cast("long"))
    cells = li.groupBy(x.alias("ix"), y.alias("iy"), z.alias("iz")).agg(
        F.count("*").alias("n"), whole("l_quantity", 1).alias("qty"), whole("l_extendedprice", 100).alias("price100"), whole("l_discount", 100).alias("disc100"), whole("l_tax", 100).alias("tax100")
    )
    node = F.col("ix") + mx * (F.col("iy") + my * F.col("iz"))
    return cells.select(node.cast("long").alias("id"), *[F.col(f"i{a}").cast("double").alias(a) for a in "xyz"], "n", "qty", "price100", "disc100", "tax100")


FIELD_SQL = f"""
SELECT (l_partkey % {MX}) + {MX} * ((l_suppkey % {MY}) + {MY} * l_linenumber::BIGINT) AS id,
  (l_partkey % {MX})::DOUBLE AS x, (l_suppkey % {MY})::DOUBLE AS y, l_linenumber::DOUBLE AS z, count(*) AS n,
  sum(round(l_quantity)::BIGINT)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price100,
  sum(round(l_discount * 100)::BIGINT)::BIGINT AS disc100, sum(round(l_tax * 100)::BIGINT)::BIGINT AS tax100
FROM lineitem GROUP BY ALL"""


def region_clouds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two clouds of cells with a cluster id: large mean quantities, and large mean taxes."""
    p = field_points(spark, sf_dir)
    cluster = (F.floor(F.col("x") / 5) * 4 + F.floor(F.col("y") / 5)).cast("long")
    base = lambda cond: p.where(cond).select("x", "y", "z", cluster.alias("rare_cluster_id"), F.col("id").alias("row_id"))
    return base(F.col("qty") > 26 * F.col("n")), base(F.col("tax100") > 4 * F.col("n"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, time, grain, value, volume) of ``events``: days and sixteenths of the users; values are sums of cents."""
    e = read_table(spark, sf_dir, "events", ["ts", "user_id", "value"])
    step = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return e.groupBy(step.alias("step"), (F.col("user_id") % 16).alias("grain")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"), F.count("*").alias("volume")
    ).withColumn("time", F.col("step").cast("double"))


STEPS_SQL = """
SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS step, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS time,
  user_id % 16 AS grain, sum(round(value * 100)::BIGINT)::BIGINT AS value, count(*) AS volume
FROM events GROUP BY ALL"""


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, X, Y, Z, GrainRadius, Eul0..2) from ``part`` by modular arithmetic."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    k = F.col("p_partkey")
    number = lambda m, a: ((k * a) % m).cast("double")
    return p.select(
        k.alias("id"), number(997, 331).alias("X"), number(991, 577).alias("Y"), number(983, 127).alias("Z"), (F.col("p_size") + 5.0).alias("GrainRadius"),
        number(360, 7).alias("Eul0"), number(180, 11).alias("Eul1"), number(360, 13).alias("Eul2"),
    )


GRAINS_SQL = """
SELECT p_partkey AS id, ((p_partkey * 331) % 997)::DOUBLE AS X, ((p_partkey * 577) % 991)::DOUBLE AS Y, ((p_partkey * 127) % 983)::DOUBLE AS Z,
  p_size + 5.0::DOUBLE AS GrainRadius, ((p_partkey * 7) % 360)::DOUBLE AS Eul0, ((p_partkey * 11) % 180)::DOUBLE AS Eul1, ((p_partkey * 13) % 360)::DOUBLE AS Eul2
FROM part"""

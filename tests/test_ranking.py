"""Numbers, ranks and quantiles over whole tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rarefield.operators import ranking


def test_numbers_follow_the_order(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, "a", "b", "c"]), rnd.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, s string, v int").repartition(7)
    got = {r["id"]: r["n"] for r in ranking.numbered(df, [F.desc("v"), F.col("s"), F.col("id")], "n", 1).collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[1] is not None, r[1] or "", r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    assert ranking.numbered(df.limit(0), ["id"], "n").count() == 0


def test_no_plan_puts_all_rows_into_one_task(spark):
    df = spark.range(0, 20000, numPartitions=8).select(F.xxhash64("id").alias("v"))
    for out in (ranking.numbered(df, ["v"], "n"), ranking.with_previous(df, "v", "p"), ranking.running_sum(df.withColumn("w", F.lit(2)), "v", "w", "s")):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_previous_values_and_running_sums(spark):
    rnd = random.Random(6)
    values = sorted({rnd.randrange(10000) for _ in range(800)})
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, w long").repartition(5)
    got = {r["v"]: r["p"] for r in ranking.with_previous(df, "v", "p").collect()}
    assert got == dict(zip(values, [None, *values], strict=False))
    sums, total = {}, 0
    for v in values:
        total += v % 7
        sums[v] = total
    assert {r["v"]: r["s"] for r in ranking.running_sum(df, "v", "w", "s").collect()} == sums


@pytest.mark.parametrize("few", [3, 4096])
def test_quantiles_equal_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    monkeypatch.setattr(ranking, "BINS", 8)
    rnd = random.Random(2)
    values = [rnd.lognormvariate(0, 4) * rnd.choice([-1, 1, 1]) for _ in range(900)] + [5.0] * 700 + [0.0, 1e-300, 1e300]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    shares = [0.0, 0.05, 0.33, 0.5, 0.77, 1.0]
    want = df.agg(*[F.percentile("v", F.lit(q)).alias(f"q{k}") for k, q in enumerate(shares)]).first()
    assert ranking.exact_quantiles(df, "v", shares) == pytest.approx(list(want), rel=1e-12)


def test_quantiles_of_odd_columns(spark):
    inf = float("inf")
    one = lambda values, q: ranking.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [q])[0]
    assert one([], 0.5) is None and one([None], 0.5) is None
    assert one([-inf, 1.0, inf], 0.5) == 1.0 and one([-inf, 1.0, inf], 0.0) == -inf
    assert one([1.0, float("nan")], 1.0) == inf and one([2.0, 2.0], 0.3) == 2.0
    assert one([-1.7e308, 1.7e308, 0.0], 0.5) == 0.0


def test_rows_of_split_files_stay_in_order(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 90) for k in range(4000)]
    for name, part in (("b.txt", lines[1500:]), ("a.txt", lines[:1500])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.text(str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        got = ranking.with_file_rows(df, "n").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in got] == lines and [r["n"] for r in got] == list(range(len(lines)))

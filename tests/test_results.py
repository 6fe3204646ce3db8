"""Results of simulations against numpy: macroscopic curves, strains, slopes, resampling and errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefield.functions import tensors
from rarefield.plans import results


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(4)
    return [(k, k * 0.5, g, float(rng.random() + 0.1), float(rng.normal())) for k in range(4) for g in range(30)]


@pytest.fixture(scope="module")
def rows(spark, made):
    return spark.createDataFrame(made, "step int, time double, row_id long, volume double, s double")


def test_macro_curve_leaves_the_first_step_out(rows, made):
    got = {r["step"]: r["s"] for r in results.macro_curve(rows, ["s"]).collect()}
    want = {k: np.average([r[4] for r in made if r[0] == k], weights=[r[3] for r in made if r[0] == k]) for k in (1, 2, 3)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_axial_strain_starts_at_zero(rows, made):
    mean = [np.mean([r[4] for r in made if r[0] == k]) for k in range(4)]
    got = [r["strain"] for r in results.axial_strain(rows, "s").orderBy("step").collect()]
    assert got == pytest.approx([m - mean[0] for m in mean])


def test_rows_are_tracked_by_their_place(rows):
    shifted = rows.withColumn("row_id", F.col("row_id") * 7 + F.col("step"))
    assert results.track_by_row(shifted).where(F.col("grain") != (F.col("row_id") - F.col("step")) / 7).isEmpty()


def test_curves(spark):
    x = [0.0, 1.0, 2.5, 4.0]
    y = [1.0, 3.0, 2.0, 8.0]
    curve = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    at = spark.createDataFrame([(q,) for q in (-0.5, 0.0, 0.25, 1.0, 3.1, 4.0, 4.5)], "q double")
    got = {r["q"]: r["y"] for r in tensors.resample(curve, at, "x", "y", "q").collect()}
    assert got[-0.5] is None and got[4.5] is None
    assert all(got[q] == pytest.approx(np.interp(q, x, y)) for q in (0.0, 0.25, 1.0, 3.1, 4.0))
    fit = np.polyfit(x[:3], y[:3], 1)[0]
    assert tensors.slope(curve, "x", "y", 0, 3) == pytest.approx(fit)
    assert tensors.scale_factor(curve, 6.0, "x", "y", 0, 3) == pytest.approx(6.0 / fit)
    with pytest.raises(ValueError, match="two"):
        tensors.slope(curve, "x", "y", 3, 5)
    assert curve.agg(tensors.distance_norm("x", "y").alias("d")).first()["d"] == pytest.approx(np.linalg.norm(np.subtract(x, y)))


def test_errors_of_a_tessellation(spark):
    schema = "id long, X double, Y double, Z double, GrainRadius double"
    grains = spark.createDataFrame([(1, 0.0, 3.0, 4.0, 1.1), (2, 1.0, 1.0, 1.0, 2.0), (9, 0.0, 0.0, 0.0, 1.0)], schema)
    truth = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 1.0, 1.0, 2.0, 4.0)], schema)
    got = {r["id"]: (r["position_error"], r["radius_error_percent"]) for r in results.reconstruct_errors(grains, truth).collect()}
    assert got.keys() == {1, 2} and got[1] == pytest.approx((5.0, 10.0)) and got[2] == pytest.approx((1.0, 50.0))
    flat = {r["id"]: r["position_error"] for r in results.reconstruct_errors(grains, truth, dims=2).collect()}
    assert flat == pytest.approx({1: 3.0, 2: 0.0})

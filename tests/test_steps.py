"""Step files by their listing, scans by their headers, and grains between steps against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefield.operators import tracking
from rarefield.sources import delimited


def steps(tmp_path, n=4):
    folder = tmp_path / "steps"
    folder.mkdir()
    for k in range(n):
        (folder / f"out_{k:04d}.csv").write_text(" id , x,value\n" + "".join(f"{i},{i * 0.5},{k * 10 + i}\n" for i in range(3)))
    (folder / "notes.txt").write_text("nothing")
    return str(folder)


def test_one_step_opens_one_file(spark, tmp_path):
    folder = steps(tmp_path)
    for k in (0, 1, 3):  # a file that were opened would be no table
        (tmp_path / "steps" / f"out_{k:04d}.csv").write_bytes(b"\xff\xfe\x00broken")
    df = delimited.read_step(spark, folder, 2)
    assert df.columns == ["id", "x", "value", "step"] and [f.rsplit("/", 1)[-1] for f in df.inputFiles()] == ["out_0002.csv"]
    assert [(r["id"], r["value"], r["step"]) for r in df.orderBy("id").collect()] == [(0, 20, 2), (1, 21, 2), (2, 22, 2)]
    with pytest.raises(ValueError, match="7"):
        delimited.read_step(spark, folder, 7)


def test_all_steps_and_their_errors(spark, tmp_path):
    folder = steps(tmp_path)
    assert [r["n"] for r in delimited.read_steps(spark, folder, n_steps=4).groupBy("step").agg(F.count("*").alias("n")).collect()] == [3] * 4
    assert {r["step"] for r in delimited.read_steps(spark, folder, steps=[1, 3]).select("step").collect()} == {1, 3}
    assert delimited.read_steps(spark, folder, schema="id long, x double, value double").schema["value"].dataType.typeName() == "double"
    with pytest.raises(ValueError, match="out of range"):
        delimited.read_steps(spark, folder, n_steps=3)
    with pytest.raises(ValueError, match="4"):
        delimited.read_steps(spark, folder, n_steps=5)
    with pytest.raises(ValueError, match="no file"):
        delimited.list_steps(spark, folder, r"_(\d+)\.dat$")
    (tmp_path / "steps" / "again_2.csv").write_text("id,x,value\n")
    with pytest.raises(ValueError, match="step 2"):
        delimited.list_steps(spark, folder)


def test_scans_are_probed_before_they_are_read(spark, tmp_path):
    head = "X,Y, Z ,GrainRadius,Eul0,Eul1,Eul2"
    for name, columns in (("low.csv", head), ("high.csv", head), ("bad.csv", "X,Y,Z")):
        (tmp_path / name).write_text(columns + "\n" + ",".join("1" for _ in columns.split(",")) + "\n")
    paths = [str(tmp_path / n) for n in ("low.csv", "high.csv", "bad.csv")]
    scans = delimited.read_scans(spark, paths[:2])
    assert [(r["ScanID"], r["scan"], r["Z"]) for s in scans for r in s.collect()] == [(0, "low", 1.0), (1, "high", 1.0)]
    with pytest.raises(ValueError, match="Eul0, Eul1, Eul2, GrainRadius"):
        delimited.read_scans(spark, paths)
    delimited.probe(spark, {"first": paths[2]}, ["X", "Z"])
    assert delimited.columns_of(spark, paths[0]) == ["X", "Y", "Z", "GrainRadius", "Eul0", "Eul1", "Eul2"]


def grains_and_edges(spark, n=30):
    rng = np.random.default_rng(3)
    xyz, mrp = rng.random((n, 3)) * 10, rng.uniform(-0.3, 0.3, (n, 3))
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n - 1, (60, 2)) if a != b})
    grains = spark.createDataFrame([(k, *map(float, xyz[k]), *map(float, mrp[k])) for k in range(n)], "id long, X double, Y double, Z double, Eul0 double, Eul1 double, Eul2 double")
    return xyz, mrp, edges, grains, spark.createDataFrame(edges, "src long, dst long")


def rotation(p):
    """The matrix of modified Rodrigues parameters, by its quaternion."""
    s = p @ p
    w, v = (1 - s) / (1 + s), 2 * p / (1 + s)
    x, y, z = v
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def cubic():
    out = []
    for order in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
        for signs in np.ndindex(2, 2, 2):
            m = np.zeros((3, 3))
            for r, c in enumerate(order):
                m[r, c] = 1 - 2 * signs[r]
            if np.linalg.det(m) > 0:
                out.append(m)
    return out


def test_features_equal_numpy_over_three_rounds(spark):
    xyz, mrp, edges, grains, table = grains_and_edges(spark)
    m = [rotation(p) for p in mrp]
    both = edges + [(b, a) for a, b in edges]
    f = np.concatenate([xyz, np.zeros((len(xyz), 1))], axis=1)
    for k in range(3):
        add = np.zeros(len(xyz))
        for a, b in both:
            if k == 0:
                trace = max(np.trace(s @ m[a] @ m[b].T) for s in cubic())
                add[b] += np.arccos(np.clip((trace - 1) / 2, -1, 1))
            else:
                add[b] += np.linalg.norm(f[b] - f[a])
        f[:, 3] += add
    got = {r["id"]: r["features"] for r in tracking.orientation_features(grains, table, 3).collect()}
    assert np.allclose([got[k] for k in range(len(xyz))], f, atol=1e-6)
    alone = {r["id"]: r["features"][3] for r in tracking.orientation_features(grains, table, 0).collect()}
    assert set(alone.values()) == {0.0}


def test_matches_are_written(spark, tmp_path):
    _, _, _, grains, edges = grains_and_edges(spark)
    f = tracking.orientation_features(grains, edges, 2)
    moved = f.withColumn("id", F.col("id") + 100).where("id != 104")
    moved_edges = edges.select((F.col("src") + 100).alias("src"), (F.col("dst") + 100).alias("dst"))
    matches = tracking.select_neighbours(f, moved, edges, moved_edges, 3, iterations=1)
    for _ in range(2):
        tracking.write_matches(matches, f, moved, str(tmp_path), "t", {"topk": 3})
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/t_{name}")
    assert read("matches").columns == ["i_in_A", "j_in_B", "cost"] and read("matches").count() == matches.count()
    a_to_b = {r["i_in_A"]: r["j_in_B"] for r in read("a_to_b").collect()}
    assert set(a_to_b) == set(range(30)) and a_to_b[4] == -1 and a_to_b[0] == 100
    assert {(r["graph"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/t_features").groupBy("graph").count().collect()} == {("A", 30), ("B", 29)}
    meta = json.loads(spark.read.text(f"{tmp_path}/t_meta").first()[0])
    assert meta["parameters"] == {"topk": 3} and (meta["n_a"], meta["n_b"], meta["n_matches"]) == (30, 29, matches.count())

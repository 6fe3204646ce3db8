"""Readers and writers: files are written, read and compared."""

import json

import pytest

from rarefield.sources import delimited, textual, writers


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_grain_files(spark, tmp_path):
    path = put(tmp_path, "g.csv", "X,Y,Z,GrainRadius,Eul0,Eul1,Eul2\n1,2,3,4,0,0,3.141592653589793\n")
    r = delimited.read_grains(spark, path, degrees_in=False).first()
    assert (r["X"], r["GrainRadius"]) == (1.0, 4.0) and r["Eul2"] == pytest.approx(180)
    with pytest.raises(ValueError, match="angle"):
        delimited.read_grains(spark, put(tmp_path, "h.csv", "X,Y,Z,Eul0\n1,2,3,4\n"))


def test_voxel_and_curve_files(spark, tmp_path):
    r = delimited.read_voxels(spark, put(tmp_path, "v.csv", "X,Y\n1,2\n")).first()
    assert (r["x"], r["y"], r["z"]) == (1.0, 2.0, 0.0)
    got = delimited.read_curve(spark, put(tmp_path, "c.csv", "1000,5\n2000,6\n"), microstrain=True).orderBy("stress").collect()
    assert [r["strain"] for r in got] == pytest.approx([0.001, 0.002])


def test_step_files(spark, tmp_path):
    for k in range(3):
        put(tmp_path, f"out_{k}.csv", f"a\n{k * 10}\n")
    assert {(r["step"], r["a"]) for r in delimited.read_steps(spark, str(tmp_path), n_steps=3).collect()} == {(0, 0), (1, 10), (2, 20)}
    with pytest.raises(ValueError, match="3"):
        delimited.read_steps(spark, str(tmp_path), n_steps=4)


def test_numbered_files(spark, tmp_path):
    for name in ("0.5.csv", "10.csv", "notes.csv"):
        put(tmp_path, name, "a\n1\n")
    assert sorted(r["level"] for r in delimited.read_numbered(spark, str(tmp_path)).collect()) == [0.5, 10.0]


def test_layers(spark, tmp_path):
    row = "1 2 3 {x} 5 6 7 8 9 10 0.5 1\n"
    for k in (3, 4):
        put(tmp_path, f"layer{k}.mic", "% a comment\n" + row.format(x=k))
    put(tmp_path, "layer9.csv", "not read, as there are .mic files\n")
    got = sorted((r["layer"], r["X"], r["Z"]) for r in textual.read_layers(spark, str(tmp_path), 2.0).collect())
    assert got == [(0, 3.0, 0.0), (1, 4.0, 2.0)]
    put(tmp_path, "layer6.mic", row.format(x=6))
    with pytest.raises(ValueError, match="contiguous"):
        textual.read_layers(spark, str(tmp_path), 2.0)


def test_layers_by_their_headers(spark, tmp_path):
    put(tmp_path, "scan_Layer-01_v2.csv", "%TriEdgeSize 1\nsecond line\nthird 4 5\n%OrientationRowNr X Y Confidence Own\n1 10 20 0.5 7\n2 11 x 0.25\n\n3 12 22 1 8\n")
    put(tmp_path, "scan_layer 2 v1.csv", "a\nb\nc\nY X Confidence\n30 40 0.75\n")
    got = sorted(((r["layer"], r["X"], r["Y"], r["Confidence"], r["Own"], r["Z"]) for r in textual.read_layers(spark, str(tmp_path), 0.5).collect()), key=str)
    assert got == [(0, 10.0, 20.0, 0.5, 7.0, 0.0), (0, 11.0, None, 0.25, None, 0.0), (0, 12.0, 22.0, 1.0, 8.0, 0.0), (1, 40.0, 30.0, 0.75, None, 0.5)]
    put(tmp_path, "other7.csv", "X Y\n1 2\n")
    with pytest.raises(ValueError, match="other7"):
        textual.read_layers(spark, str(tmp_path), 0.5)
    (tmp_path / "none").mkdir()
    put(tmp_path, "none/readme.txt", "x")
    with pytest.raises(ValueError, match="holds no"):
        textual.read_layers(spark, str(tmp_path / "none"), 0.5)


def test_cells_and_seeds_side_by_side(spark):
    cells = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, vol double")
    seeds = spark.createDataFrame([(2, 9.0), (3, 8.0)], "id long, x double")
    got = sorted((tuple(r) for r in textual.cells_and_seeds(cells, seeds).collect()), key=str)
    assert got == [(1, 0.5, None, None), (2, 0.25, 2, 9.0), (None, None, 3, 8.0)]


def test_random_strains(spark):
    from pyspark.sql import functions as F

    from rarefield.functions import tensors

    grains = spark.range(4000)
    out = tensors.with_random_strains(grains, 50.0, 3)
    assert out.columns[1:] == [f"eKen{i}{j}" for i in "123" for j in "123"]
    assert out.where("eKen12 != eKen21 or eKen13 != eKen31 or eKen23 != eKen32").isEmpty()
    r = out.agg(*[F.avg(c).alias(f"m{c}") for c in out.columns[1:]], *[F.stddev(c).alias(f"s{c}") for c in out.columns[1:]], F.corr("eKen11", "eKen12").alias("r")).first()
    assert all(abs(r[f"m{c}"]) < 4 and 47 < r[f"s{c}"] < 53 for c in out.columns[1:]) and abs(r["r"]) < 0.06
    again = tensors.with_random_strains(grains.repartition(7), 50.0, 3)
    assert out.exceptAll(again).isEmpty() and not out.exceptAll(tensors.with_random_strains(grains, 50.0, 4)).isEmpty()


def test_orientation_files(spark, tmp_path):
    got = textual.read_orientations(spark, put(tmp_path, "o.txt", "1 0 0 0 1 0 0 0 1\n0.1, 0.2, 0.3\n")).orderBy("row").collect()
    assert [(r["row"], r["kind"], len(r["v"])) for r in got] == [(0, "matrix", 9), (1, "mrp", 3)]
    with pytest.raises(ValueError, match="2 numbers"):
        textual.read_orientations(spark, put(tmp_path, "p.txt", "1 2\n"))


def test_nested_sample(spark, tmp_path):
    r = delimited.read_sample(spark, put(tmp_path, "s.json", json.dumps({"a": {"b": 1, "c": [1, 2]}, "d": "x"}))).first()
    assert (r["a.b"], r["a.c"], r["d"]) == (1, [1, 2], "x")


def test_tables_and_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "src long, dst long, weight double")
    for fmt in ("parquet", "csv"):
        writers.write_table(df, str(tmp_path / fmt), fmt, single=True)
    assert sorted(spark.read.parquet(str(tmp_path / "parquet")).collect()) == sorted(df.collect())
    assert sorted(map(tuple, delimited.read_csv(spark, str(tmp_path / "csv")).collect())) == sorted(map(tuple, df.collect()))
    writers.save_checkpoint(df, str(tmp_path / "ck"), {"k": 3})
    assert writers.load_checkpoint(spark, str(tmp_path / "ck"), {"k": 3}).count() == 2
    with pytest.raises(ValueError, match="k"):
        writers.load_checkpoint(spark, str(tmp_path / "ck"), {"k": 4})


def test_point_files_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k), 0.0, 1.0, k % 2) for k in range(20)], "id long, x double, y double, z double, rare int")
    writers.write_lines(writers.vtk_points(df, ["rare"]), str(tmp_path / "vtk"))
    lines = [line for f in sorted((tmp_path / "vtk").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[4] == "POINTS 20 double" and [tuple(map(float, x.split())) for x in lines[5:25]] == [(k, 0, 1) for k in range(20)]
    assert lines[25:28] == ["POINT_DATA 20", "SCALARS rare int 1", "LOOKUP_TABLE default"] and lines[28:] == [str(k % 2) for k in range(20)]


def test_metrics_document(spark):
    assert json.loads(writers.metrics_json(spark.createDataFrame([(1, 0.5)], "b int, a double"))) == {"a": 0.5, "b": 1}

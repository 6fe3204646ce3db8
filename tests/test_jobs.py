"""The jobs over growing copies of small inputs, run again, and against plain Python."""

import datetime as dt
import math
import re
import statistics

import pytest

from jobs import read_config, registered, step_curve, text_tables

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, day, hour=3, grain=1, field="strain", value=1.0):
    return (i, None if day is None else dt.datetime(2024, 1, day, hour), grain, field, value, "{}")


FIRST = [event(k, 1 + k % 3, k % 24, k % 5, "strain" if k % 2 else "stress", k * 0.5) for k in range(60)]
ODD = [event(60, None), event(61, 1, field=None), event(62, 1, value=None), event(63, 1, value=math.nan), event(64, 2, value=math.inf), event(None, 2, value=7.0), event(None, 2, value=7.0)]
#: A later file: a new day, a late row of an old one, and id 3 delivered again with another value.
SECOND = [event(70, 5, value=3.0), event(71, 2, value=-4.0), event(3, 1, 3, 3, "strain", 99.0)]


def land(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def curve_by_hand(*files):
    rows = {}
    for n, file in enumerate(files):
        for k, (i, ts, grain, field, value, _) in enumerate(file):
            if ts is not None and field is not None and value is not None and math.isfinite(value):
                rows[(ts.date(), i if i is not None else ("row", n, k))] = (field, grain, value)
    by = {}
    for (step, _), (field, grain, value) in rows.items():
        by.setdefault((field, step), []).append((grain, value))
    first = {f: statistics.fmean(v for _, v in by[f, min(s for g, s in by if g == f)]) for f, _ in by}
    out = []
    for (field, step), found in by.items():
        values = [v for _, v in found]
        mean = statistics.fmean(values)
        out.append((step, field, len(values), len({g for g, _ in found}), mean, statistics.pstdev(values), min(values), max(values), mean - first[field]))
    return sorted(out)


def curve_rows(frame):
    return sorted((r["step"], r["field"], r["n"], r["grains"], r["mean"], r["std"], r["low"], r["high"], r["change"]) for r in frame.collect())


def same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for g, w in zip(got, want, strict=True) for a, b in zip(g[4:], w[4:], strict=True))


def test_curves_follow_growing_input(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    run = lambda: step_curve.run(spark, source, out, mark)
    land(spark, source, FIRST + ODD)
    same(curve_rows(run()), curve_by_hand(FIRST + ODD))
    before = spark.read.parquet(f"{out}/rows").groupBy("batch").count().collect()
    land(spark, source, SECOND)
    same(curve_rows(run()), curve_by_hand(FIRST + ODD, SECOND))
    after = {r["batch"]: r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("batch").count().collect()}
    assert after.pop(1) == len(SECOND) and after == {r["batch"]: r["count"] for r in before}, "the second run takes only the second file"
    files = set(spark.read.parquet(f"{out}/summary").inputFiles())
    same(curve_rows(run()), curve_by_hand(FIRST + ODD, SECOND))
    assert files == set(spark.read.parquet(f"{out}/summary").inputFiles()), "a run with nothing new leaves the summary alone"


def test_untouched_steps_are_not_written_again(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    land(spark, source, FIRST)
    step_curve.run(spark, source, out, mark)
    of_step = lambda: {f for f in spark.read.parquet(f"{out}/summary").inputFiles() if "2024-01-03" in f}
    before = of_step()
    land(spark, source, SECOND)
    step_curve.run(spark, source, out, mark)
    assert before and of_step() == before


def test_a_batch_that_failed_midway_is_taken_whole(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    land(spark, source, FIRST)

    def fails(rows):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(step_curve, "summarised", fails)
        with pytest.raises(Exception, match="lost"):
            step_curve.run(spark, source, out, mark)
    same(curve_rows(step_curve.run(spark, source, out, mark)), curve_by_hand(FIRST))


def test_curves_without_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    land(spark, source, [])
    assert step_curve.run(spark, source, out, mark).count() == 0
    with pytest.raises(ValueError, match="absent"):
        step_curve.run(spark, source, out, mark, {"value": "absent"})


DOCS = "doc_id long, text string, lang string, source string"
REPORTS = [
    (1, "Scan 4\n| X | Y | Z |\n| 1.5 | -2 | .5e3 |\r\nend | of\nplain", "en", "a"),
    (2, "x | y\n1 | 2\n" * 30, "en", "a"),
    (3, "\n".join(" | ".join(map(str, range(n))) for n in (4, 4, 9)), "de", "b"),
    (4, None, "de", "b"),
    (5, "", None, "b"),
    (6, "a||b\n|\n||\n", None, "b"),
    (6, "a||b\n|\n||\n", "", "b"),
    (None, "p | q", " ", "b"),
    (7, "r | s " * 3000, "fr", "b"),
]


def lines_by_hand(rows, quantile=0.05):
    found = []
    for i, text, lang, _ in rows:
        for n, line in enumerate((text or "").split("\n")):
            if "|" in line:
                cells = [c.strip(" \t\r\x0b\x0c") for c in line.strip(" \t\r\x0b\x0c").strip("|").split("|")]
                numbers = [c for c in cells if re.fullmatch(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?", c)]
                if len(cells) >= 2:
                    found.append(((lang or "").strip(" ") or "und", len(cells), i, n, len(numbers), len(line)))
    sizes = {}
    for f in found:
        sizes[f[:2]] = sizes.get(f[:2], 0) + 1
    ordered = sorted(sizes.values())
    at = quantile * (len(ordered) - 1)
    low = ordered[int(at)]
    limit = low + (ordered[min(int(at) + 1, len(ordered) - 1)] - low) * (at - int(at))
    rare = sorted((s for s in sizes if sizes[s] <= limit), key=lambda s: (sizes[s], s))
    return sorted(((*f, rare.index(f[:2]) + 2 if f[:2] in rare else 1, sizes[f[:2]]) for f in found), key=str)


def line_rows(frame):
    return sorted(((r["lang"], r["cells"], r["doc_id"], r["line"], r["numbers"], r["chars"], r["block_id"], r["n"]) for r in frame.collect()), key=str)


def test_tables_against_plain_python_and_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(REPORTS, DOCS).write.parquet(source)
    for _ in range(2):
        assert line_rows(text_tables.run(spark, source, out)) == lines_by_hand(REPORTS)
    cells = spark.read.parquet(f"{out}/cells").where("line = 2 and doc_id = 3").orderBy("cell").collect()
    assert [(r["text"], r["number"]) for r in cells] == [(str(k), float(k)) for k in range(9)]
    # fewer documents: nothing of the others stays
    less = REPORTS[:2]
    spark.createDataFrame(less, DOCS).write.mode("overwrite").parquet(source)
    assert line_rows(text_tables.run(spark, source, out)) == lines_by_hand(less)


def test_one_language_leaves_the_others_alone(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(REPORTS, DOCS).write.parquet(source)
    text_tables.run(spark, source, out)
    shown = lambda: line_rows(spark.read.schema(text_tables.LINES + ", n long").parquet(f"{out}/lines").where("lang != 'en'"))
    before = shown()
    text_tables.run(spark, source, out, {"languages": ["en"], "quantile": 1.0})
    assert shown() == before
    got = spark.read.schema(text_tables.LINES).parquet(f"{out}/lines").where("lang = 'en'").select("block_id").distinct().collect()
    assert sorted(r[0] for r in got) == [2, 3]


def test_tables_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "in"))
    assert text_tables.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0


def test_config_files_hold_the_defaults(spark):
    import os

    folder = os.path.dirname(step_curve.__file__)
    assert read_config(spark, f"{folder}/step_curve.json") == step_curve.DEFAULTS
    assert read_config(spark, f"{folder}/text_tables.json") == text_tables.DEFAULTS


def test_registered_jobs_use_a_folder_of_their_own(spark, tmp_path):
    land(spark, str(tmp_path / "events.parquet"), FIRST)
    spark.createDataFrame(REPORTS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    for _ in range(2):
        assert registered.job1_step_curve(spark, str(tmp_path)).count() == len(curve_by_hand(FIRST))
        assert registered.job2_text_tables(spark, str(tmp_path)).count() == len(lines_by_hand(REPORTS))

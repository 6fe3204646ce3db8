"""Readers of the text formats of measurements and tessellations.

Whole-file formats are small headers of one microstructure each: a file is one
row, parsed inside the task that read it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefield.operators.ranking import numbered, running_sum, with_file_rows
from rarefield.scratch import Scratch
from rarefield.sources.delimited import list_files

LAYER_COLUMNS = ("OrientationRowNr", "NrMatches", "RunTime", "X", "Y", "TriEdgeSize", "UpDown", "Eul1", "Eul2", "Eul3", "Confidence", "PhaseNr")


def split_line(line="value"):
    return F.split(F.trim(F.col(line) if isinstance(line, str) else line), r"[,\s]+")


def read_layers(spark: SparkSession, folder: str, dz: float, token: str = "layer") -> DataFrame:
    """The rows of a near-field scan's layer files, with ``layer`` and Z = dz times it.

    Files are the ``.mic`` files of the folder, or its ``.csv`` files where there are
    none.  A layer's number follows ``token`` in the file's name, in any case; a name
    without one and a gap in the numbers are errors.  The first line that names X and Y
    is the header and gives each file's columns; without one the columns of the format
    are taken in their order.  Lines before the header, comments and blank lines are no
    rows.  A short line and what is no number are nulls, not missing rows.
    """
    files = list_files(spark, folder)
    kind = next((k for k in (".mic", ".csv") if not files.where(F.endswith("name", F.lit(k))).isEmpty()), None)
    if kind is None:
        raise ValueError(f"{folder} holds no .mic and no .csv files")
    number = F.regexp_extract("name", rf"(?i){re.escape(token)}[\s_\-]*([0-9]+)", 1).try_cast("int")
    named = files.where(F.endswith("name", F.lit(kind))).select("path", "name", number.alias("number")).orderBy("number").collect()  # a row for each layer
    nameless = [r["name"] for r in named if r["number"] is None]
    if nameless:
        raise ValueError(f"no number follows {token!r} in {nameless[0]}")
    numbers = [r["number"] for r in named]
    if numbers != list(range(numbers[0], numbers[0] + len(numbers))):
        raise ValueError(f"layer numbers {numbers} are not contiguous")
    place = F.create_map(*[F.lit(v) for r in named for v in (r["name"], r["number"] - numbers[0])])
    file = F.col("_metadata.file_name")  # with %20 for a space
    raw = spark.read.text([r["path"] for r in named]).withColumn("layer", F.coalesce(F.try_element_at(place, file), F.try_element_at(place, F.url_decode(file))))
    lines = Scratch(spark, "layers").save(with_file_rows(raw, "_n"), "lines")
    names = F.split(F.trim(F.regexp_replace("value", "^\\s*[%#]", "")), r"[,\s]+")
    heads = lines.where(F.array_contains(names, "X") & F.array_contains(names, "Y")).groupBy("layer").agg(F.min(F.struct("_n", names.alias("names"))).alias("h"))
    found = {r["layer"]: r["h"]["names"] for r in heads.collect()}  # a header for each layer
    columns = list(dict.fromkeys([*LAYER_COLUMNS, *[n for h in found.values() for n in h]]))
    told = lines.join(heads.select("layer", F.col("h._n").alias("_h"), F.col("h.names").alias("names")), "layer", "left")
    rows = told.where(~F.trim("value").rlike("^[%#]") & (F.trim("value") != "") & F.coalesce(F.col("_n") > F.col("_h"), F.lit(True)))
    own = F.coalesce("names", F.array(*[F.lit(c) for c in LAYER_COLUMNS]))
    cut = rows.select("layer", split_line().alias("v"), own.alias("names"))
    value = lambda c: F.get("v", F.nullif(F.array_position("names", c), F.lit(0)) - 1).try_cast("double").alias(c)
    return cut.select(*[value(c) for c in columns], "layer").withColumn("Z", F.col("layer") * float(dz))


def read_orientations(spark: SparkSession, path: str) -> DataFrame:
    """(row, kind, v) of an orientation file: nine numbers a line are a matrix, three are MRP, others an error."""
    lines = with_file_rows(spark.read.text(path).where(F.trim("value") != ""), "row")
    rows = lines.select("row", F.transform(split_line(), lambda x: x.try_cast("double")).alias("v"))
    bad = rows.where(~F.size("v").isin(3, 9)).limit(1).collect()
    if bad:
        raise ValueError(f"a line has {len(bad[0]['v'])} numbers; 3 or 9 are expected")
    return rows.select("row", F.when(F.size("v") == 9, "matrix").otherwise("mrp").alias("kind"), "v")


def _sections(text: str) -> dict[str, list[list[str]]]:
    """A tessellation file's sections: ``**name`` and ``*name`` lines open one, the lines below are its words."""
    out: dict[str, list[list[str]]] = {}
    path = ["", ""]
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("***"):
            continue
        if s.startswith("**"):
            path = [s[2:].strip(), ""]
            out.setdefault(path[0], [])
        elif s.startswith("*"):
            path[1] = s[1:].strip()
            out.setdefault(f"{path[0]}/{path[1]}", [])
        elif s:
            out.setdefault("/".join(p for p in path if p), []).append(s.split())
    return out


def parse_tessellation(text: str) -> dict[str, list]:
    """Seeds, orientations, vertices, edges, faces and cells of a tessellation; ids count from 0, a face's sign in a cell stays.

    Signed references keep their sign as a separate number, since 0 has none.
    """
    s = _sections(text)
    out: dict[str, list] = {"seeds": [], "orientations": [], "descriptor": [], "vertices": [], "edges": [], "faces": [], "cells": []}
    for row in s.get("cell/seed", []):
        if len(row) >= 5:
            out["seeds"].append((int(row[0]) - 1, *map(float, row[1:5])))
    ori = s.get("cell/ori", [])
    if ori:
        out["descriptor"] = [ori[0][0].split(":")[0]]
        out["orientations"] = [tuple(map(float, row)) for row in ori[1:]]
    for row in s.get("vertex", [])[1:]:
        out["vertices"].append((int(row[0]) - 1, *map(float, row[1:4])))
    for row in s.get("edge", [])[1:]:
        out["edges"].append((int(row[0]) - 1, int(row[1]) - 1, int(row[2]) - 1))
    rows = s.get("face", [])[1:]
    k = 0
    while k + 3 < len(rows) or k < len(rows) and len(rows[k]) > 2:
        n = int(rows[k][1])
        out["faces"].append((int(rows[k][0]) - 1, [int(v) - 1 for v in rows[k][2 : 2 + n]]))
        k += 4  # vertices, edges, the plane, and the state
    for row in s.get("polyhedron", [])[1:]:
        n = int(row[1])
        refs = [int(v) for v in row[2 : 2 + n]]
        out["cells"].append((int(row[0]) - 1, [abs(v) - 1 for v in refs], [1 if v > 0 else -1 for v in refs]))
    return out


def _parsed(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = spark.createDataFrame([], f"file string, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [dict(zip(["file", *names], (file, *r), strict=True)) for r in rows_of(parse_tessellation(text))]
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.mapInArrow(run, kinds)


def tessellation_vertices(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, lambda t: t["vertices"], "vertex long, x double, y double, z double")


def tessellation_faces(spark: SparkSession, path: str) -> DataFrame:
    """(file, face, vertex list)."""
    return _parsed(spark, path, lambda t: t["faces"], "face long, vertices array<long>")


def tessellation_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, face, sign), one row for each face of a cell."""
    return _parsed(spark, path, lambda t: [(c, f, s) for c, fs, ss in t["cells"] for f, s in zip(fs, ss, strict=True)], "cell long, face long, sign int")


def tessellation_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, x, y, z, weight, descriptor, orientation)."""

    def rows(t: dict[str, list]) -> list[tuple]:
        d = t["descriptor"][0] if t["descriptor"] else None
        ori = t["orientations"]
        return [(*s, d, list(ori[k]) if k < len(ori) else None) for k, s in enumerate(t["seeds"])]

    return _parsed(spark, path, rows, "cell long, x double, y double, z double, weight double, descriptor string, orientation array<double>")


def raster_cells(spark: SparkSession, sizes: tuple[int, int, int], voxel: tuple[float, float, float], values: DataFrame, orientations: DataFrame | None = None) -> DataFrame:
    """(X, Y, Z, CellID, Eul0..2) of a raster whose ``values`` (index, cell) run with x fastest; void cells are -1.

    Voxel centres come from the index alone.
    """
    nx, ny, _ = sizes
    i = F.col("index")
    ix, iy, iz = i % nx, F.floor(i / nx) % ny, F.floor(i / (nx * ny))
    cell = F.when(F.coalesce("cell", F.lit(0)) <= 0, F.lit(-1)).otherwise(F.col("cell"))
    out = values.select("index", *[((k + 0.5) * h).alias(n) for k, h, n in zip((ix, iy, iz), voxel, "XYZ", strict=True)], cell.cast("long").alias("CellID"))
    if orientations is not None:
        out = out.join(orientations, "CellID", "left")
    return out


def read_raster(spark: SparkSession, path: str) -> tuple[tuple[int, int, int], tuple[float, float, float], DataFrame]:
    """(sizes, voxel sizes, (index, cell)) of an ASCII raster file; the header is read on the driver, the data stay with Spark."""
    lines = with_file_rows(spark.read.text(path), "o").select("o", F.trim("value").alias("v"))
    marks = {r["v"]: r["o"] for r in lines.where(F.col("v").rlike(r"^\*")).collect()}
    at = lambda name: lines.where((F.col("o") > marks[name]) & (F.col("v") != "")).orderBy("o").limit(2).collect()
    general = at("**general")
    sizes = tuple(map(int, general[1]["v"].split()[:3] if len(general[0]["v"].split()) == 1 else general[0]["v"].split()[:3]))
    voxel_line = lines.where((F.col("o") > marks["**general"]) & (F.col("v") != "")).orderBy("o").limit(3).collect()[-1]["v"].split()
    voxel = tuple(map(float, voxel_line[:3]))
    end = min((o for o in marks.values() if o > marks["**data"]), default=1 << 62)
    data = lines.where((F.col("o") > marks["**data"]) & (F.col("o") < end) & ~F.col("v").rlike("^[a-z]"))
    numbers = data.select("o", F.posexplode(F.split("v", r"\s+")).alias("k", "n")).select("o", "k", F.col("n").try_cast("long").alias("cell")).where("cell is not null")
    # a line's first index is the number of values on the lines before it
    per = data.select("o", F.size(F.split("v", r"\s+")).alias("c"))
    before = running_sum(per, "o", "c", "_s").select("o", (F.col("_s") - F.col("c")).alias("first"))
    return sizes, voxel, numbers.join(before, "o").select((F.col("first") + F.col("k")).alias("index"), "cell")


def positional_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both frames by position, as many as the shorter has; frames that were read from files go by ``_row``, their place in these."""

    def number(df: DataFrame) -> DataFrame:
        if "_row" in df.columns:
            return df
        return numbered(Scratch(df.sparkSession, "merge").save(df.withColumn("_m", F.monotonically_increasing_id())), ["_m"], "_row").drop("_m")

    return number(left).join(number(right), "_row").drop("_row")


def cells_and_seeds(cells: DataFrame, seeds: DataFrame, id_col: str = "id") -> DataFrame:
    """Every cell and every seed, side by side where the ids are equal; columns end in ``_cell`` and ``_seed``."""
    left = cells.select(*[F.col(c).alias(f"{c}_cell") for c in cells.columns])
    right = seeds.select(*[F.col(c).alias(f"{c}_seed") for c in seeds.columns])
    return left.join(right, left[f"{id_col}_cell"] == right[f"{id_col}_seed"], "full")


def read_cell_table(spark: SparkSession, cells: str, orientations: str, names: tuple[str, ...] = ("X", "Y", "Z", "Volume"), min_volume: float = 0.0) -> DataFrame:
    """A cell statistics file merged by position with an orientation file; small cells are left out, radii follow from volumes."""
    rows = lambda path: with_file_rows(spark.read.text(path).where(F.trim("value") != ""), "_row")
    stats = rows(cells).select("_row", *[F.get(split_line(), F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)])
    angles = rows(orientations).select("_row", *[F.get(split_line(), F.lit(k)).try_cast("double").alias(f"Eul{k}") for k in range(3)])
    merged = positional_merge(stats, angles)
    if "Volume" in names:
        merged = merged.where(F.col("Volume") >= min_volume).withColumn("GrainRadius", F.cbrt(F.col("Volume") * 3 / (4 * 3.141592653589793)))
    return merged

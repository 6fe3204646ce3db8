"""Readers of delimited tables: points, grains, scans, voxels, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefield.sources.schema import numeric, reject_nan, require_columns, strip_headers

ANGLES = ("Eul0", "Eul1", "Eul2")
STRAINS = tuple(f"eKen{i}{j}" for i in "123" for j in "123")


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, header: bool = True) -> DataFrame:
    """Comma-separated files; with a schema there is no pass to infer it."""
    reader = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return strip_headers((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def with_row_order(df: DataFrame) -> DataFrame:
    """``df`` with ``file`` and ``row_id``, an order that follows the rows of each file."""
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("row_id", F.monotonically_increasing_id())


def read_points(spark: SparkSession, path: str, coords: Sequence[str] = ("x", "y", "z"), features: Sequence[str] = ()) -> DataFrame:
    """A point table with its required columns checked."""
    df = read_csv(spark, path)
    require_columns(df, [*coords, *features])
    return df


def read_grains(spark: SparkSession, path: str, dims: int = 3, degrees_in: bool = True, microstrain: bool = False) -> DataFrame:
    """A grain table: coordinates by dimension, an optional radius, all or none of the angles and of the strains; angles in degrees."""
    df = read_csv(spark, path)
    require_columns(df, ["X", "Y", "Z"][:dims])
    for group, what in ((ANGLES, "angle"), (STRAINS, "strain")):
        have = [c for c in group if c in df.columns]
        if have and len(have) < len(group):
            raise ValueError(f"some {what} columns are missing: {sorted(set(group) - set(have))}")
    numbers = [c for c in ("X", "Y", "Z", "GrainRadius", *ANGLES, *STRAINS) if c in df.columns]
    df = numeric(df, numbers)
    if ANGLES[0] in numbers and not degrees_in:
        df = df.withColumns({a: F.degrees(a) for a in ANGLES})
    if STRAINS[0] in numbers and microstrain:
        df = df.withColumns({s: F.col(s) * 1e-6 for s in STRAINS})
    return df


def read_voxels(spark: SparkSession, path: str, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """A voxel table with lower-case coordinates; two-dimensional data get z = 0, missing values are refused."""
    df = read_csv(spark, path)
    for c in "XYZ":
        if c in df.columns and c.lower() not in df.columns:
            df = df.withColumnRenamed(c, c.lower())
    if "z" not in df.columns:
        df = df.withColumn("z", F.lit(0.0))
    require_columns(df, list(columns))
    return reject_nan(numeric(df, ["x", "y", "z"]), ["x", "y", "z"])


def read_curve(spark: SparkSession, path: str, microstrain: bool = False) -> DataFrame:
    """(strain, stress) of a file with two columns and no header."""
    df = read_csv(spark, path, "strain double, stress double", header=False)
    return df.withColumn("strain", F.col("strain") * (1e-6 if microstrain else 1.0))


def read_numbered(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """All files of a folder whose name is a number, with it as ``level``; other files are left out."""
    df = read_csv(spark, f"{folder.rstrip('/')}/*{suffix}")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return df.withColumn("level", name.try_cast("double")).where("level is not null")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of the files of a folder, by Spark's own listing; nothing in them is read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length")


def list_steps(spark: SparkSession, folder: str, pattern: str = r"_(\d+)\.csv$", n_steps: int | None = None) -> DataFrame:
    """(step, path) of a folder's step files; other names are left out.

    Raises where there are none, where a step is not below ``n_steps`` and where two
    files name the same step.
    """
    named = list_files(spark, folder).select(F.regexp_extract("name", pattern, 1).try_cast("int").alias("step"), "path").where("step is not null")
    r = named.agg(F.count("*").alias("n"), F.count_distinct("step").alias("steps"), F.min("step").alias("low"), F.max("step").alias("high")).first()
    if not r["n"]:
        raise ValueError(f"no file of {folder} has a name like {pattern}")
    if n_steps is not None and (r["low"] < 0 or r["high"] >= n_steps):
        raise ValueError(f"step {r['high']} is out of range, there are {n_steps}")
    if r["n"] != r["steps"]:
        twice = named.groupBy("step").count().where("count > 1").orderBy("step").first()["step"]
        raise ValueError(f"step {twice} has several files")
    return named


def read_steps(spark: SparkSession, folder: str, pattern: str = r"_(\d+)\.csv$", n_steps: int | None = None, steps: Sequence[int] | None = None, schema: str | None = None) -> DataFrame:
    """Step files of a folder with ``step`` from their names, or just the files of some ``steps``.

    Files are chosen by their listing, so no other file is opened, not for the schema
    either; that is inferred from the first file chosen, unless it is given.  Raises
    where a wanted step has no file: any below ``n_steps``, or one of ``steps``.
    """
    listed = list_steps(spark, folder, pattern, n_steps)
    wanted = listed if steps is None else listed.where(F.col("step").isin([int(s) for s in steps]))
    files = {r["step"]: r["path"] for r in wanted.collect()}  # a path for each step that is read
    missing = sorted(set(range(n_steps) if steps is None and n_steps is not None else steps or ()) - set(files))
    if missing:
        raise ValueError(f"no file of the steps {missing}")
    ordered = [files[s] for s in sorted(files)]
    kind = schema or read_csv(spark, ordered[0]).schema
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(kind).csv(ordered)
    return rows.withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("int"))


def read_step(spark: SparkSession, folder: str, step: int, pattern: str = r"_(\d+)\.csv$", schema: str | None = None) -> DataFrame:
    """The rows of one step; its file is the only one opened."""
    return read_steps(spark, folder, pattern, steps=[step], schema=schema)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of a delimited file with a header, from its first line alone."""
    first = spark.read.text(path).limit(1).first()
    return [] if first is None else [c.strip().strip('"').strip() for c in first["value"].split(",")]


def probe(spark: SparkSession, files: dict[str, str], needed: Sequence[str]) -> None:
    """Raises if a file (label: path) lacks a needed column; reads headers only."""
    for label, path in files.items():
        lacking = sorted(set(needed) - set(columns_of(spark, path)))
        if lacking:
            raise ValueError(f"{label} lacks the columns {', '.join(lacking)}")


SCAN_COLUMNS = ("X", "Y", "Z", "GrainRadius", *ANGLES)


def read_scans(spark: SparkSession, files: Sequence[str], dims: int = 3, degrees_in: bool = True, microstrain: bool = False) -> list[DataFrame]:
    """The scans of several grain files, with ``ScanID`` by the files' order and the file's ``scan`` name, their columns checked first."""
    probe(spark, {f"scan {f}": f for f in files}, SCAN_COLUMNS)
    name = lambda f: f.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [read_grains(spark, f, dims, degrees_in, microstrain).withColumns({"ScanID": F.lit(k), "scan": F.lit(name(f))}) for k, f in enumerate(files)]


def read_experiment_steps(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """One file a step: ordered by the number in their names, names without one after these, by name."""
    import re

    def order(f: str) -> tuple:
        m = re.findall(r"\d+(?:\.\d+)?", f.rsplit("/", 1)[-1])
        return (0, float(m[0]), f) if m else (1, 0.0, f)

    out = None
    for k, f in enumerate(sorted(files, key=order)):
        part = read_csv(spark, f).withColumn("row_id", F.monotonically_increasing_id()).withColumn("step", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no step files")
    return out


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON document as one row of dotted columns."""
    df = spark.read.option("multiLine", True).json(path)

    def leaves(schema, prefix: str = "") -> list[str]:
        out = []
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            out += leaves(f.dataType, f"{name}.") if f.dataType.typeName() == "struct" else [name]
        return out

    return df.select(*[F.col(n).alias(n) for n in leaves(df.schema)])


def suggest_box(points: DataFrame, coords: Sequence[str] = ("X", "Y", "Z"), angles: Sequence[str] = ANGLES) -> DataFrame:
    """One row: each coordinate's range widened by 2 % (by 1 where it is zero) and rounded to 4 places, and the unit of the angles."""
    aggs = []
    for c in coords:
        pad = F.when(F.max(c) > F.min(c), (F.max(c) - F.min(c)) * 0.02).otherwise(F.lit(1.0))
        aggs += [F.round(F.min(c) - pad, 4).alias(f"{c}_lo"), F.round(F.max(c) + pad, 4).alias(f"{c}_hi")]
    present = [a for a in angles if a in points.columns]
    if present:
        largest = F.greatest(*[F.max(F.abs(F.col(a))) for a in present]) if len(present) > 1 else F.max(F.abs(F.col(present[0])))
        aggs.append(F.when(largest > 6.283185307179586, "degrees").otherwise("radians").alias("angle_unit"))
    return points.agg(*aggs)


def missing_inputs(given: dict[str, object]) -> list[str]:
    """What no file tells and the caller has to: the names of absent entries."""
    # Inputs that cannot be inferred from tables.
    needed = ("material", "crystal_symmetry", "euler_convention", "length_unit", "loading_direction", "scan_overlap")
    return [n for n in needed if given.get(n) in (None, "")]

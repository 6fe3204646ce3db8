"""Sinks: tables, text formats, JSON metrics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEBUG_COLUMNS = ("Matched_when_merged", "Cell", "Unmatched_location", "ScanID")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single: bool = False) -> None:
    """A table as Parquet or CSV; ``single`` makes one file, for small results."""
    out = df.coalesce(1) if single else df
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def stitched_columns(df: DataFrame, required: Sequence[str] = ("X", "Y", "Z", "GrainRadius", "Eul0", "Eul1", "Eul2")) -> DataFrame:
    """The required columns and those debug columns that are there."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*required, *[c for c in DEBUG_COLUMNS if c in df.columns])


def _number(c: str) -> Column:
    return F.format_string("%.9g", F.col(c).cast("double"))


def _write_lines(lines: DataFrame, path: str) -> None:
    """(part, k, value) as ordered text: range partitions keep the order across files."""
    lines.repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)


def vtk_points(df: DataFrame, scalars: Sequence[str], xyz: Sequence[str] = ("x", "y", "z"), order: str = "id", title: str = "points") -> DataFrame:
    """(part, k, value): the lines of a legacy ASCII point set with scalar arrays."""
    n = df.count()
    spark = df.sparkSession
    head = ["# vtk DataFile Version 3.0", title, "ASCII", "DATASET POLYDATA", f"POINTS {n} double"]
    parts = [spark.createDataFrame([(0, k, v) for k, v in enumerate(head)], "part int, k long, value string")]
    parts.append(df.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("k"), F.concat_ws(" ", *[_number(c) for c in xyz]).alias("value")))
    at = 2
    for s in scalars:
        whole = df.schema[s].dataType.typeName() in ("integer", "long", "short", "byte")
        lead = ([f"POINT_DATA {n}"] if at == 2 else []) + [f"SCALARS {s} {'int' if whole else 'double'} 1", "LOOKUP_TABLE default"]
        parts.append(spark.createDataFrame([(at, k, v) for k, v in enumerate(lead)], "part int, k long, value string"))
        parts.append(df.select(F.lit(at + 1).alias("part"), F.col(order).cast("long").alias("k"), (F.col(s).cast("string") if whole else _number(s)).alias("value")))
        at += 2
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def vtk_grid(df: DataFrame, sizes: tuple[int, int, int], scalars: Sequence[str], index: Sequence[str] = ("ix", "iy", "iz"), xyz: Sequence[str] = ("x", "y", "z"), title: str = "grid") -> DataFrame:
    """(part, k, value): the lines of a structured grid, x fastest; raises where a node is missing."""
    nx, ny, nz = sizes
    if df.select(*index).distinct().count() != nx * ny * nz:
        raise ValueError("the grid is not full")
    ordered = df.withColumn("_k", F.col(index[0]) + nx * (F.col(index[1]) + ny * F.col(index[2])))
    lines = vtk_points(ordered, scalars, xyz, "_k", title)
    value = F.when((F.col("part") == 0) & (F.col("k") == 3), f"DATASET STRUCTURED_GRID\nDIMENSIONS {nx} {ny} {nz}").otherwise(F.col("value"))
    return lines.withColumn("value", value)


def vtk_raster(values: DataFrame, sizes: tuple[int, int, int], voxel: tuple[float, float, float], name: str = "CellID") -> DataFrame:
    """(part, k, value): the lines of structured points from (index, name), x fastest."""
    nx, ny, nz = sizes
    head = ["# vtk DataFile Version 3.0", name, "ASCII", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}", "ORIGIN 0 0 0", "SPACING {:.9g} {:.9g} {:.9g}".format(*voxel), f"POINT_DATA {nx * ny * nz}", f"SCALARS {name} int 1", "LOOKUP_TABLE default"]
    first = values.sparkSession.createDataFrame([(0, k, v) for k, v in enumerate(head)], "part int, k long, value string")
    return first.union(values.select(F.lit(1).alias("part"), F.col("index").alias("k"), F.col(name).cast("string").alias("value")))


def layer_lines(layer: DataFrame, columns: Sequence[str], order: str, header: Sequence[str]) -> DataFrame:
    """(part, k, value): a near-field layer file, header lines and tab-separated rows."""
    first = layer.sparkSession.createDataFrame([(0, k, v) for k, v in enumerate(header)], "part int, k long, value string")
    return first.union(layer.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("k"), F.concat_ws("\t", *[_number(c) for c in columns]).alias("value")))


def seed_lines(grains: DataFrame, dims: int = 3, order: str = "id") -> dict[str, DataFrame]:
    """Points, weights (shares of the volume, of the area in two dimensions) and orientations as ordered lines."""
    from rarefield.functions.tensors import volume_weights

    w = volume_weights(grains, "GrainRadius", "_w", dims)
    line = lambda cols: w.select(F.lit(0).alias("part"), F.col(order).cast("long").alias("k"), F.concat_ws(" ", *[_number(c) for c in cols]).alias("value"))
    return {"points": line(["X", "Y", "Z"][:dims]), "weights": line(["_w"]), "orientations": line(["Eul0", "Eul1", "Eul2"])}


def strain_lines(seeds: DataFrame, grains: DataFrame, order: str = "id") -> DataFrame:
    """(part, k, value): seed coordinates and nine strains of each grain, without a header."""
    strains = [f"eKen{i}{j}" for i in "123" for j in "123"]
    joined = seeds.select(order, "x", "y", "z").join(grains.select(order, *strains), order)
    return joined.select(F.lit(0).alias("part"), F.col(order).cast("long").alias("k"), F.concat_ws(",", *[_number(c) for c in ("x", "y", "z", *strains)]).alias("value"))


def phase_ids(voxels: DataFrame, phase: str = "phase", index: Sequence[str] = ("ix", "iy", "iz")) -> DataFrame:
    """(part, k, value): consecutive phase numbers, z fastest."""
    from rarefield.operators.clusters import relabel

    sizes = voxels.agg(*[(F.max(i) + 1).alias(i) for i in index]).first()
    k = (F.col(index[0]) * sizes[index[1]] + F.col(index[1])) * sizes[index[2]] + F.col(index[2])
    return relabel(voxels, phase, "_n").select(F.lit(0).alias("part"), k.cast("long").alias("k"), F.col("_n").cast("string").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    _write_lines(lines, path)


def metrics_json(row: DataFrame) -> str:
    """A one-row table as a JSON document."""
    r = row.select(F.to_json(F.struct(*row.columns)).alias("j")).first()
    return json.dumps(json.loads(r["j"]), indent=2, sort_keys=True)


def save_checkpoint(edges: DataFrame, path: str, meta: dict) -> None:
    """Edges and what they were made with."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    text = json.dumps(meta, sort_keys=True)
    edges.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_checkpoint(spark, path: str, meta: dict) -> DataFrame:
    """The edges; raises if they were made with other settings."""
    saved = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if saved != json.loads(json.dumps(meta)):
        changed = sorted(k for k in {*saved, *meta} if saved.get(k) != meta.get(k))
        raise ValueError(f"the checkpoint was made with other settings of {changed}")
    return spark.read.parquet(f"{path}/edges")

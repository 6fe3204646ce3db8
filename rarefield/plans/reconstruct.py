"""Voxel segmentation drivers: from an orientation field to consecutive cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.functions.orientation import euler_to_matrix
from rarefield.functions.similarity import misorientation_metric
from rarefield.operators import community, graph, lattice, voxels
from rarefield.operators.clusters import relabel
from rarefield.scratch import Scratch


def reconstruct(field: DataFrame, method: str = "flood", tolerance: float = 5.0, min_size: int = 8, connectivity: int = 6, order: str = "small_first", convention: str = "bunge", segmenter: str = "auto", id_col: str = "id") -> DataFrame:
    """``field`` (id, x, y, z, phase, Eul0..2) with ``cell_id``: consecutive segments from 1, void 0.

    ``order`` says whether small segments are merged before unassigned voxels are
    filled ('small_first') or after ('infill_first').  An existing ``cell_id`` is
    kept, -1 becoming 0.
    """
    if method not in ("flood", "graph"):
        raise ValueError("method is flood or graph")
    if order not in ("small_first", "infill_first"):
        raise ValueError("order is small_first or infill_first")
    if "cell_id" in field.columns:
        return field.withColumn("cell_id", F.when(F.col("cell_id") == -1, F.lit(0)).otherwise(F.col("cell_id")))
    scratch = Scratch(field.sparkSession, "reconstruct")
    indexed = lattice.with_index(field, ("x", "y", "z"))
    indexed = scratch.save(indexed.withColumn("matrix", euler_to_matrix("Eul0", "Eul1", "Eul2", convention)), "indexed")
    if method == "flood":
        labels = voxels.flood(indexed, tolerance, 1, connectivity, id_col=id_col)
    else:
        solid = indexed.where("phase > 0")
        edges = lattice.grid_edges(solid, 1, id_col)
        far = graph.edge_distances(edges, solid, misorientation_metric(("Eul0", "Eul1", "Eul2"), convention), id_col).where(F.col("distance") < tolerance)
        found = community.segment(solid, graph.weigh(far, "exp", sigma=tolerance), segmenter, id_col=id_col)
        numbered = relabel(found, "label", "segment", 1).select(F.col(id_col).alias("id"), "segment")
        labels = indexed.select(F.col(id_col).alias("id")).join(numbered, "id", "left").select("id", F.coalesce("segment", F.lit(0).cast("long")).alias("segment"))
    own = scratch.save(indexed.join(labels.select(F.col("id").alias(id_col), "segment"), id_col), "segments")
    steps = [lambda d: voxels.remove_small(d, min_size, connectivity=connectivity, id_col=id_col), lambda d: voxels.infill(d, connectivity=connectivity, id_col=id_col)]
    for step in steps if order == "small_first" else reversed(steps):
        own = scratch.save(step(own), "segments")
    positive = relabel(own.where("segment > 0"), "segment", "cell_id", 1).select(id_col, "cell_id")
    return field.join(positive, id_col, "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(0).cast("long")))


def layers_to_grid(layers: DataFrame, step: float, dz: float, confidence: float = 0.0) -> DataFrame:
    """(id, x, y, z, phase, Eul0..2): every cell of a square grid over a layer takes its nearest measured point.

    Cells further from a point than one step are void; points below the confidence
    do not count.
    """
    from rarefield.operators.neighbors import knn

    spark = layers.sparkSession
    scratch = Scratch(spark, "layers")
    good = scratch.save(layers.where(F.col("Confidence") >= confidence).withColumn("_pid", F.monotonically_increasing_id()), "points")
    e = good.agg(F.min("X").alias("x0"), F.max("X").alias("x1"), F.min("Y").alias("y0"), F.max("Y").alias("y1"), F.max("layer").alias("n")).first()
    nx, ny, nz = int((e["x1"] - e["x0"]) / step) + 1, int((e["y1"] - e["y0"]) / step) + 1, int(e["n"]) + 1
    ids = spark.range(nx * ny * nz)
    ix, iy, iz = F.col("id") % nx, F.floor(F.col("id") / nx) % ny, F.floor(F.col("id") / (nx * ny))
    # layers are told apart by a third axis far longer than any step
    far = (e["x1"] - e["x0"] + e["y1"] - e["y0"] + step) * 4
    grid = ids.select("id", (ix * step + e["x0"]).alias("x"), (iy * step + e["y0"]).alias("y"), (iz * dz).alias("z"), iz.alias("layer"))
    grid = scratch.save(grid, "grid")
    q = grid.select("id", F.col("x").alias("X"), F.col("y").alias("Y"), (F.col("layer") * far).alias("L"))
    near = knn(q, good.select("_pid", "X", "Y", (F.col("layer") * far).alias("L")), 1, ("X", "Y", "L"), "id", "_pid")
    near = near.where(F.col("distance") <= step)
    values = good.select("_pid", F.col("PhaseNr").cast("long").alias("phase"), *[F.col(f"Eul{k + 1}").alias(f"Eul{k}") for k in range(3)])
    joined = grid.join(near.select(F.col("query").alias("id"), F.col("target").alias("_pid")), "id", "left").join(values, "_pid", "left")
    zero = F.lit(0.0)
    return joined.select("id", "x", "y", "z", F.coalesce("phase", F.lit(0).cast("long")).alias("phase"), *[F.coalesce(f"Eul{k}", zero).alias(f"Eul{k}") for k in range(3)])

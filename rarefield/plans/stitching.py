"""Stitching of layered scans into one grain table, and comparison of the result with a truth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.functions import orientation as rot
from rarefield.functions import regions
from rarefield.functions.similarity import candidate_cost, gates, relative_radius
from rarefield.operators.assignment import assign
from rarefield.operators.neighbors import knn
from rarefield.operators.ranking import exact_quantiles
from rarefield.scratch import Scratch

ANGLES = ("Eul0", "Eul1", "Eul2")
XYZ = ("X", "Y", "Z")


@dataclass
class MatchSpec:
    """Tolerances (-1: no gate) and weights of position, orientation and relative radius."""

    pos_tol: float = 50.0
    ori_tol: float = 5.0
    rad_tol: float = -1.0
    w_pos: float = 1.0
    w_ori: float = 1.0
    w_rad: float = 0.0
    neighbours: int = 10
    convention: str = "bunge"
    symmetry: str = "432"
    degrees_in: bool = True

    @property
    def unmatched(self) -> float:
        return self.w_pos + self.w_ori + self.w_rad + 1e-6


def naive_stitch(scans: Sequence[DataFrame]) -> DataFrame:
    """All scans one below the other with ``ScanID``, the position in the list."""
    if not scans:
        raise ValueError("no scans")
    out = None
    for k, s in enumerate(scans):
        part = s.withColumn("ScanID", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def load_scans(scans: Sequence[DataFrame]) -> list[DataFrame]:
    """Scans with their ``ScanID``, by their lowest Z."""
    lows = [(s.agg(F.min("Z")).first()[0], k) for k, s in enumerate(scans)]
    return [scans[k].withColumn("ScanID", F.lit(k)) for _, k in sorted(lows, key=lambda v: (v[0] is None, v[0], v[1]))]


def matrix(spec: MatchSpec, prefix: str = "") -> Column:
    return rot.euler_to_matrix(*[f"{prefix}{a}" for a in ANGLES], convention=spec.convention, degrees_in=spec.degrees_in)


def candidates(a: DataFrame, b: DataFrame, spec: MatchSpec, pos_scale: float | None = None, id_col: str = "_gid") -> DataFrame:
    """(a, b, dpos, dori, drad, cost) of the nearest pairs within the gates: for each row of ``a`` its nearest of ``b``."""
    within = None if spec.pos_tol == -1 else spec.pos_tol  # the gate drops what is farther
    near = knn(a, b, spec.neighbours, XYZ, id_col, id_col, within=within).select(F.col("query").alias("a"), F.col("target").alias("b"), F.col("distance").alias("dpos"))
    pa = a.select(F.col(id_col).alias("a"), matrix(spec).alias("ma"), F.col("GrainRadius").alias("ra"))
    pb = b.select(F.col(id_col).alias("b"), matrix(spec).alias("mb"), F.col("GrainRadius").alias("rb"))
    pairs = near.join(pa, "a").join(pb, "b").select("a", "b", "dpos", rot.misorientation("ma", "mb", spec.symmetry).alias("dori"), relative_radius("ra", "rb").alias("drad"))
    kept = pairs.where(gates([("dpos", spec.pos_tol), ("dori", spec.ori_tol), ("drad", spec.rad_tol)]))
    scale = spec.pos_tol if pos_scale is None else pos_scale
    return kept.withColumn("cost", candidate_cost([(spec.w_pos, "dpos", scale), (spec.w_ori, "dori", spec.ori_tol), (spec.w_rad, "drad", spec.rad_tol)]))


def merge_rows(pairs: DataFrame, a: DataFrame, b: DataFrame, spec: MatchSpec, id_col: str = "_gid") -> DataFrame:
    """One row per pair (a, b): volume-weighted position, the radius of the mean volume, the mean orientation, all else from ``a``."""
    va, vb = F.col("_ra") ** 3, F.col("_rb") ** 3
    ma = a.withColumn("_ma", matrix(spec)).withColumn("_ra", F.col("GrainRadius"))
    mb = b.select(F.col(id_col).alias("b"), *[F.col(x).alias(f"_b{x}") for x in XYZ], F.col("GrainRadius").alias("_rb"), matrix(spec).alias("_mb"))
    joined = pairs.select("a", "b").join(ma, F.col("a") == F.col(id_col)).join(mb, "b")
    out = joined.withColumns({x: (F.col(x) * va + F.col(f"_b{x}") * vb) / (va + vb) for x in XYZ}).withColumn("GrainRadius", F.cbrt((va + vb) / 2))
    mean = mean_orientations(out.select("a", "_ma", "_mb", (va / (va + vb)).alias("share")), spec.symmetry)
    out = out.join(mean, "a").withColumn("_e", rot.matrix_to_euler("_mean", spec.convention, spec.degrees_in))
    out = out.withColumns({e: F.get("_e", F.lit(k)) for k, e in enumerate(ANGLES)})
    return out.withColumn("Matched_when_merged", F.lit(True)).select(*a.columns, "Matched_when_merged")


def mean_orientations(pairs: DataFrame, symmetry: str = "432") -> DataFrame:
    """(a, _mean) of rows (a, two matrices, share of the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = [batch.column(k).flatten().to_numpy().reshape(-1, 3, 3) for k in (1, 2)]
                mean = rot.weighted_means(*m, batch.column(3).to_numpy(), symmetry).reshape(-1, 9)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(mean), pa.list_(pa.float64()))], ["a", "_mean"])

    return pairs.mapInArrow(run, "a long, _mean array<double>")


def _with_region(df: DataFrame, zol: float, zoh: float) -> DataFrame:
    zmin, zmax = (c if c in df.columns else None for c in ("Zmin", "Zmax"))
    low, high = regions.z_extent("Z", "GrainRadius", zmin, zmax)
    return df.withColumn("Region", regions.region(low, high, zol, zoh))


def stitch_pair(a: DataFrame, b: DataFrame, zol: float, zoh: float, spec: MatchSpec, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(grains, decisions) of two overlapping scans; both have a unique ``_gid``."""
    spark = a.sparkSession
    drop = [c for c in ("Region", "Matched_when_merged", "Cell", "Unmatched_location") if c in a.columns]
    ra, rb = scratch.save(_with_region(a.drop(*drop), zol, zoh), "a"), scratch.save(_with_region(b.drop(*[c for c in drop if c in b.columns]), zol, zoh), "b")
    pairs = scratch.save(assign(candidates(rb, ra, spec).select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"), spec.unmatched), "pairs")
    acted = pairs.join(ra.select(F.col("_gid").alias("a"), F.col("Region").alias("ra")), "a").join(rb.select(F.col("_gid").alias("b"), F.col("Region").alias("rb")), "b")
    acted = scratch.save(acted.join(F.broadcast(regions.match_rules(spark)), ["ra", "rb"]), "acted")
    merged = merge_rows(acted.where("action = 'MC'"), ra, rb, spec)
    pick = lambda df, side, action: df.join(acted.where(F.col("action") == action).select(F.col(side).alias("_gid")), "_gid", "left_semi")
    settled = acted.where("action != 'RJ'")
    rules = F.broadcast(regions.unmatched_rules(spark))
    free = []
    for df, side in ((ra, "a"), (rb, "b")):
        rest = df.join(settled.select(F.col(side).alias("_gid")), "_gid", "left_anti")
        free.append(rest.join(rules.where(F.col("side") == side.upper()).select(F.col("region").alias("Region"), "decision"), "Region").withColumn("Unmatched_location", F.lit(side.upper())))
    kept = [f.where("decision = 'KEEP'").drop("decision") for f in free]
    out = merged
    for part in (pick(ra, "a", "KA"), pick(rb, "b", "KB"), *kept):
        out = out.unionByName(part, allowMissingColumns=True)
    log = acted.select(F.col("a").alias("a"), F.col("b").alias("b"), F.col("action").alias("decision"))
    for f, side in zip(free, ("a", "b"), strict=True):
        other = "b" if side == "a" else "a"
        log = log.unionByName(f.select(F.col("_gid").alias(side), F.lit(None).cast("long").alias(other), "decision"))
    return scratch.save(out.drop("Region"), "grains"), scratch.save(log, "decisions")


def stitch_slabs(a: DataFrame, b: DataFrame, spec: MatchSpec, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(grains, decisions) of two scans that touch: grains near the common face may be one grain cut in two; every match merges."""
    edge = a.agg(F.max("Z").alias("z")).crossJoin(b.agg(F.min("Z").alias("w"))).first()  # one row each
    (middle,) = exact_quantiles(a.select("GrainRadius").union(b.select("GrainRadius")), "GrainRadius", [0.5])
    t = 2 * (middle or 0.0)
    near_a, near_b = scratch.save(a.where(F.col("Z") >= edge["z"] - t), "slab_a"), scratch.save(b.where(F.col("Z") <= edge["w"] + t), "slab_b")
    pairs = scratch.save(assign(candidates(near_a, near_b, spec, pos_scale=t), spec.unmatched), "pairs")
    merged = merge_rows(pairs, a, b, spec)
    rest = [df.join(pairs.select(F.col(s).alias("_gid")), "_gid", "left_anti") for df, s in ((a, "a"), (b, "b"))]
    out = merged
    for part in rest:
        out = out.unionByName(part, allowMissingColumns=True)
    return scratch.save(out, "grains"), scratch.save(pairs.select("a", "b", F.lit("MC").alias("decision")), "decisions")


def stitch(scans: Sequence[DataFrame], zlo: float, zhi: float, overlap: float, spec: MatchSpec | None = None) -> tuple[DataFrame, DataFrame]:
    """(grains, decisions) of scans stacked along Z, folded from the lowest up; each pair is written before the next."""
    spec = spec or MatchSpec()
    if not scans:
        raise ValueError("no scans")
    scratch = Scratch(scans[0].sparkSession, "stitch")
    ordered = load_scans(scans)
    if len(ordered) == 1:
        return ordered[0], ordered[0].sparkSession.createDataFrame([], "a long, b long, decision string")
    numbered = [scratch.save(_numbered(s, k), "scan") for k, s in enumerate(ordered)]
    now, log = numbered[0], None
    h, step = regions.window_geometry(zlo, zhi, len(numbered), overlap)
    for k, scan in enumerate(numbered[1:]):
        if overlap > 0:
            now, said = stitch_pair(now, scan, zlo + (k + 1) * step, zlo + k * step + h, spec, scratch)
        else:
            now, said = stitch_slabs(now, scan, spec, scratch)
        log = said if log is None else log.unionByName(said)
    return now.drop("_gid"), log


def _numbered(scan: DataFrame, k: int) -> DataFrame:
    """A grain id unique over all scans: the scan's place and a row number that the written table then fixes."""
    return scan.withColumn("_gid", F.lit(k << 54) + F.monotonically_increasing_id())


# -- comparison with a truth


def compare_scans(source: DataFrame, target: DataFrame, spec: MatchSpec | None = None, id_col: str = "id") -> DataFrame:
    """(source, target, dpos, dori, drad, valid): one-to-one matches; unmatched sources have target -1 and infinite errors.

    The cost of leaving a grain unmatched counts only gated terms of positive
    weight, and the radius gates only where it has a weight.
    """
    spec = spec or MatchSpec()
    used = MatchSpec(**{**spec.__dict__, "rad_tol": spec.rad_tol if spec.w_rad > 0 else -1.0})
    near = Scratch(source.sparkSession, "compare").save(candidates(source, target, used, id_col=id_col), "candidates")
    (middle,) = exact_quantiles(near, "dpos", [0.5])
    rescaled = near.withColumn("cost", candidate_cost([(spec.w_pos, "dpos", spec.pos_tol if spec.pos_tol > 0 else (middle or 1.0)), (spec.w_ori, "dori", spec.ori_tol), (spec.w_rad, "drad", spec.rad_tol)]))
    unmatched = sum(w for w, t in ((spec.w_pos, spec.pos_tol), (spec.w_ori, spec.ori_tol), (spec.w_rad, spec.rad_tol)) if w > 0 and t != -1) + 1e-6
    chosen = assign(rescaled, unmatched).select("a", "b").join(near, ["a", "b"])
    ids = source.select(F.col(id_col).alias("a"))
    inf = F.lit(float("inf"))
    out = ids.join(chosen, "a", "left")
    valid = F.col("b").isNotNull() & gates([("dpos", spec.pos_tol), ("dori", spec.ori_tol)])
    return out.select(F.col("a").alias("source"), F.coalesce("b", F.lit(-1)).alias("target"), F.coalesce("dpos", inf).alias("dpos"), F.coalesce("dori", inf).alias("dori"), F.coalesce("drad", inf).alias("drad"), F.coalesce(valid, F.lit(False)).alias("valid"))


def match_statistics(matches: DataFrame, n_target: int) -> DataFrame:
    """One row: counts, and mean and median errors of the valid matches, null where there are none."""
    v = lambda c: F.when(F.col("valid"), F.col(c))
    return matches.agg(
        F.count("*").alias("n_source"),
        F.lit(n_target).cast("long").alias("n_target"),
        F.count(v("target")).alias("n_matched"),
        *[f(v(c)).alias(f"{n}_{c}") for c in ("dpos", "dori", "drad") for n, f in (("mean", F.avg), ("median", F.median))],
    )


def unmatched_targets(matches: DataFrame, target: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``target`` that no valid match claims."""
    claimed = matches.where("valid").select(F.col("target").alias(id_col))
    return target.join(claimed, id_col, "left_anti")


def splits(matches: DataFrame) -> DataFrame:
    """(target, sources) of targets with several valid sources; one-to-one matches have none, other match tables may."""
    return matches.where("valid").groupBy("target").agg(F.sort_array(F.collect_list("source")).alias("sources")).where(F.size("sources") > 1)

"""Operator 4: embedding near-duplicates with randomised-rotation binary codes.

A unit vector is rotated by a fixed random rotation and kept as its sign bits,
with one stored correction factor, the inner product of the vector and its code
(RaBitQ, Gao and Long, 2024).  Divided by the factor, the inner product of a
rotated query and a code is an unbiased estimate of the cosine, with an error
bound that both factors give.  A pair whose bound stays below the threshold is
dropped; every other pair is recomputed exactly, in double precision.

Pairs are sought in cells: ``tables`` cross-polytope hashes, each the largest
coordinate of another rotation, within equal labels.  How often vectors at the
threshold share a cell is drawn from the model of the hash for the dimension at
hand (``hash_rate``); the number of tables makes the miss probability at the
threshold at most ``MISS``, and more hashes per table keep cells small as the
input grows: a table has (2 d)**hashes cells.  Cells beyond ``BLOCK`` members are compared
block by block, every block with every other, so no task holds a whole hot cell.

Equal vectors form one class first.  A block reports, for each member, how many
vectors it links to and one edge towards its group, never its pairs; a pair that
several tables find counts in the first of them only.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component, and rows with a null label, are linked with nothing; vectors of
different lengths are not compared; a row with a null id has no links and a null
component; each row counts as one vector, also where an id repeats; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.llm import linkage
from rarefield.scratch import Scratch

BLOCK = 1024
CELL = 512  # members of a cell to aim at
DRAWS = 4000  # of pairs, to estimate how often they share a hash
MISS = 1e-4
SIGMAS = 4.5
_SEED = 41


@functools.lru_cache(maxsize=64)
def rotation(d: int, k: int) -> np.ndarray:
    """The ``k``-th random rotation of ``d`` dimensions, the same in every worker."""
    q, r = np.linalg.qr(np.random.default_rng([_SEED, d, k]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


@functools.lru_cache(maxsize=64)
def hash_rate(d: int, threshold: float) -> float:
    """A lower bound of the probability that two vectors at the threshold share a hash, three deviations below its estimate.

    A random rotation maps a pair at cosine c to z and c z + sqrt(1 - c**2) w, up to
    lengths, with independent normal z and w; vectors that are closer share more.
    """
    rng = np.random.default_rng([_SEED, d, 0, 1])
    same = 0
    for n in [DRAWS // 8] * 8:
        z, w = rng.normal(size=(2, n, d))
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        w -= (w * z).sum(axis=1, keepdims=True) * z
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        other = threshold * z + math.sqrt(1 - threshold**2) * w
        i, j = np.abs(z).argmax(axis=1), np.abs(other).argmax(axis=1)
        same += int(((i == j) & (z[np.arange(n), i] * other[np.arange(n), i] > 0)).sum())
    p = same / DRAWS
    return min(0.99, max(0.05, p - 3 * math.sqrt(p * (1 - p) / DRAWS)))


def plan(n: int, d: int, threshold: float) -> tuple[int, int]:
    """(hashes per table, tables) for ``n`` vectors of ``d`` dimensions."""
    m = 1
    while n / (2 * max(d, 2)) ** m > CELL:
        m += 1
    return m, math.ceil(math.log(MISS) / math.log(1 - hash_rate(d, threshold) ** m))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def cell_keys(unit: np.ndarray, label: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """A key for each vector and table: label, length, table and the hashes of the table."""
    n, d = unit.shape
    out = np.empty((n, tables), np.uint64)
    for t in range(tables):
        key = _mix(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d * 4096 + t))
        for h in range(hashes):
            z = unit @ rotation(d, 1 + t * hashes + h)
            at = np.abs(z).argmax(axis=1)
            key = _mix(key * np.uint64(0xD1342543DE82EF95) + (at * 2 + (z[np.arange(n), at] > 0)).astype(np.uint64))
        out[:, t] = key
    return out


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors, and their correction factors."""
    z = unit @ rotation(unit.shape[1], 0)
    return np.packbits(z > 0, axis=1), np.abs(z).sum(axis=1) / math.sqrt(unit.shape[1])


_CODED = "id long, label long, copies long, vector array<double>, code binary, factor double, cells array<long>"


def _coded(vectors: DataFrame, hashes: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate(([0], np.cumsum(size)))
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                v = flat[(start[rows][:, None] + np.arange(d)[None, :])].astype(float)
                unit = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)
                take = pa.array(rows)
                code, factor = codes(unit)
                cells = cell_keys(unit, batch.column(1).take(take).to_numpy(), hashes, tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        batch.column(2).take(take),
                        batch.column(3).take(take),
                        pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(factor),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(cells.reshape(-1).view(np.int64))),
                    ],
                    ["id", "label", "copies", "vector", "code", "factor", "cells"],
                )

    return vectors.mapInArrow(run, _CODED)


def _links_of_block(t: pa.Table, threshold: float) -> pa.Table:
    """(a, n, b): each linked member, the vectors it links to that count here, and the least member of its group."""
    t = t.combine_chunks()
    n = t.num_rows
    ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
    d = len(t["vector"][0])
    vec = t["vector"].combine_chunks().flatten().to_numpy().reshape(n, d)
    cells = t["cells"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    block, table = t["block"].to_numpy(), int(t["t"][0].as_py())
    same = t["bi"][0].as_py() == t["bj"][0].as_py()
    left = np.arange(n) if same else np.flatnonzero(block == t["bi"][0].as_py())
    right = np.arange(n) if same else np.flatnonzero(block == t["bj"][0].as_py())
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    label, factor = t["label"].to_numpy(), t["factor"].to_numpy()
    bits = np.unpackbits(np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(n, -1), axis=1, count=d)
    signs = (bits.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    query = (unit @ rotation(d, 0)).astype(np.float32)
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1)) * math.sqrt(1 - threshold**2)
    most = threshold - SIGMAS * spread - 1e-5
    first, second = [], []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        estimate = query[rows] @ signs[right].T / factor[right].astype(np.float32)
        i, j = np.nonzero(estimate >= most[right])
        i, j = rows[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        keep = label[i] == label[j]
        first.append(i[keep])
        second.append(j[keep])
    i, j = np.concatenate(first), np.concatenate(second)
    hit = np.concatenate([_cosine(vec, i[k : k + 65536], j[k : k + 65536]) >= threshold for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    i, j = i[hit], j[hit]
    if table and len(i):
        new = ~(cells[i, :table] == cells[j, :table]).any(axis=1)
        i, j = i[new], j[new]
    count = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    order = np.argsort(ids, kind="stable")
    group = np.empty(n, np.int64)
    group[order] = np.arange(n)
    while len(i):
        before = group.copy()
        np.minimum.at(group, i, group[j])
        np.minimum.at(group, j, group[i])
        if (group == before).all():
            break
    on = np.flatnonzero(count)
    return pa.table({"a": ids[on], "n": count[on].astype(np.int64), "b": ids[order[group[on]]]})


def _cosine(vec: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    x, y = vec[i], vec[j]
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    v = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    h1, h2 = F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), "vector", "label")
    named = own.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), h1).alias("h1"), h2.alias("h2"), F.size("vector").alias("d"))
    named = scratch.save(named, "named")
    grouped = named.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.max("d").alias("d"))
    # the written table fixes each class's number: an id may repeat with other vectors
    classes = scratch.save(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    n, d = classes.agg(F.count("*"), F.max("d")).first()
    hashes, tables = plan(n, d or 1, threshold)
    hashed = own.where(usable).select("vec_id", "label", "vector", h1.alias("h1"), h2.alias("h2"))
    leaders = classes.select("id", "copies", "h1", "h2", F.col("least").alias("vec_id"))
    reps = hashed.join(leaders, ["vec_id", "h1", "h2"]).dropDuplicates(["id"])
    coded = scratch.save(_coded(reps.select("id", "label", "copies", "vector"), hashes, tables), "coded")
    rows = coded.select("*", F.posexplode("cells").alias("t", "cell"))
    sizes = coded.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (
        rows.join(scratch.save(sizes, "sizes"), "cell")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bi", F.least("block", "other"))
        .withColumn("bj", F.greatest("block", "other"))
    )
    keyed = dealt.select("cell", "bi", "bj", "block", "t", "id", "label", "copies", "vector", "code", "factor", "cells")

    def links(t: pa.Table) -> pa.Table:
        return _links_of_block(t, threshold)

    found = scratch.save(keyed.groupBy("cell", "bi", "bj").applyInArrow(links, "a long, n long, b long"), "found")
    comps = linkage.connected_components(found.select("a", "b"), scratch)
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    placed = classes.join(counts, classes["id"] == counts["a"], "left").join(comps, classes["id"] == comps["node"], "left")
    linked = scratch.save(placed.select("h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c")), "linked")
    least = linked.groupBy("c").agg(F.min("least").alias("component_id"))
    per_class = linked.join(least, "c").select("h1", "h2", "n_links", "component_id")
    joined = named.join(scratch.save(per_class, "per_class"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

"""Operator 1: MinHash near-duplicates by min-max hashing.

Each permutation yields two signature values, the least and the greatest hash of
the shingle set.  Both agree between two sets with the probability of their
Jaccard similarity, so half the hash evaluations give a signature of the same
length with a lower variance.  Bands of the signature are candidate buckets;
candidates are confirmed on the full shingle sets with integer arithmetic.

Documents with the same set form one class first (a 128-bit sum over the set),
and only class representatives are banded, so groups of copies cost one row each
way.  With ``PERMUTATIONS`` = 64, bands of 5 values and 25 bands a pair at
similarity 0.85 is missed with probability 4e-7.

Defined cases: a null or blank text has no shingles and is linked with nothing;
a text of fewer words than a shingle is one shingle; a row with a null id keeps
its shingle count, has a null component and is never a duplicate; each row is a
document, also where an id repeats, and its component is the smallest id among
the rows it is linked with; an empty table gives an empty table; texts are read
whole, in batches of bounded size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.llm import linkage, wordhash
from rarefield.llm.workers import releasing
from rarefield.scratch import Scratch

PERMUTATIONS = 64
ROWS, BANDS = 5, 25
_SEED = 7


def signature_parameters(permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    odd = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, permutations, dtype=np.uint64)


def min_max_signatures(shingles: np.ndarray, firsts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of 2 * permutations values for each run of ``shingles`` that begins at ``firsts`` (no run is empty)."""
    odd, add = signature_parameters(permutations)
    out = np.empty((len(firsts), 2 * permutations), np.uint64)
    for p in range(permutations):
        v = shingles * odd[p]
        v += add[p]
        v ^= v >> np.uint64(31)
        out[:, 2 * p] = np.minimum.reduceat(v, firsts)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, firsts)
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(signatures), (b + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for r in range(rows):
            k = wordhash.mix(k ^ signatures[:, b * rows + r])
        keys[:, b] = k
    return keys


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingles of each row) for runs of rows."""
    for row, _, data, offsets in wordhash.text_arrays(column):
        h, first, _, _ = wordhash.words(data, offsets)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = np.sort(wordhash.ngrams(h[a:b], n))
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            sets.append(s)
        yield row, sets


_SIGNED = "doc_id long, t long, n_shingles long, h1 long, h2 long, bands array<long>"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, t, n_shingles, h1, h2, bands) of (doc_id, text, t): h1 and h2 name the set, bands is empty for an empty one."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), shingle):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                keys = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    firsts = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    keys = band_keys(min_max_signatures(flat, firsts))
                    h1[full] = np.add.reduceat(wordhash.mix(flat ^ np.uint64(0xA5A5A5A5)), firsts)
                    h2[full] = np.add.reduceat(wordhash.mix(flat * np.uint64(0xC2B2AE3D27D4EB4F)), firsts)
                ends = np.cumsum((size > 0) * BANDS)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
                own = [batch.column(k).slice(row, len(sets)) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands], ["doc_id", "t", "n_shingles", "h1", "h2", "bands"])

    return docs.mapInArrow(run, _SIGNED)


def _one_by_one(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The shingle set of each row; a text that repeats the one before, as hubs do, is not read again."""
    before, kept = None, None
    for _, sets in shingle_sets(column.dictionary_encode().dictionary, shingle):
        before = sets if before is None else before + sets
    for k in column.dictionary_encode().indices.to_pylist():
        kept = before[k] if k is not None else np.zeros(0, np.uint64)
        yield kept


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of the full shingle sets of ``texts``."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*(_one_by_one(batch.column(k), shingle) for k in (2, 3)), strict=True):
                short, long = (x, y) if len(x) < len(y) else (y, x)
                both = 0
                if 100 * len(short) >= percent * len(long) and len(short):
                    at = np.searchsorted(long, short)
                    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("_ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("_tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


SLOTS = 1 << 18
_PARITY = [f"p{k}" for k in range(8)]


def slot_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many of ``texts`` have a shingle in each of ``SLOTS`` slots; a table of a fixed size."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(1), shingle):
                n += np.bincount((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    got = texts.select("id", "text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def difference_keys(pairs: DataFrame, texts: DataFrame, counts: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(key, id, sketch, size): an exact index of the sets that were compared with one hub.

    Let D(x) be the symmetric difference of x and the hub, and t the greatest
    difference that the similarity allows two sets.  If x is not linked to the hub
    but to y, |D(x)| + |D(y)| exceeds t, so D(x) and D(y) share more than
    (|D(x)| + |D(y)| - t) / 2 elements, at least one.  What copies of one text have
    in common cancels out: copies with edits of their own share nothing, however
    many there are.  D is ordered by rarity and cut to the prefix in which a first
    shared element must lie; the sketch holds how many elements of D begin there,
    and how many D has.  ``p0`` to ``p7`` are the parities of D's elements in 512
    slots: no two sets differ by less than these do.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(counts)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sides = [_one_by_one(batch.column(k), shingle) for k in (2, 3)]
            keys, owner, sketch, size, parity = [], [], [], [], []
            for h, i, a, b in zip(hubs, ids, *sides, strict=True):
                d = np.setxor1d(a, b, assume_unique=True)
                if not len(d) or not len(b):
                    continue
                d = d[np.lexsort((d, sent.value[(d % np.uint64(SLOTS)).astype(np.int64)]))]
                largest = 100 * len(b) // percent
                prefix = min(len(d), (100 - percent) * (len(b) + largest) // (100 + percent) + 1)
                keys.append(wordhash.mix(d[:prefix] ^ np.uint64(h * 0x9E3779B97F4A7C15 % (1 << 64))))
                owner.append(np.full(prefix, i, np.int64))
                sketch.append((len(d) - np.arange(prefix, dtype=np.int64)) << 32 | len(d))
                size.append(np.full(prefix, len(b), np.int64))
                odd = np.bincount((d >> np.uint64(20) & np.uint64(511)).astype(np.int64), minlength=512) & 1
                parity.append(np.broadcast_to(np.packbits(odd.astype(bool)).view(np.int64), (prefix, 8)))
            if keys:
                columns = [np.concatenate(keys).view(np.int64), *(np.concatenate(x) for x in (owner, sketch, size)), *np.ascontiguousarray(np.concatenate(parity).T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "sketch", "size", *_PARITY])

    th = texts.select(F.col("id").alias("hub"), F.col("text").alias("_th"))
    tx = texts.select("id", F.col("text").alias("_tx"))
    return pairs.join(th, "hub").join(tx, "id").select("hub", "id", "_th", "_tx").mapInArrow(run, "key long, id long, sketch long, size long" + "".join(f", {p} long" for p in _PARITY))


def _possible(percent: int) -> Column:
    """Whether two sets can be linked if the key's element is the first that their differences share."""
    rest = F.least(F.shiftright("sketch", 32), F.shiftright("hs", 32))
    low = F.lit((1 << 32) - 1)
    both = F.col("sketch").bitwiseAND(low) + F.col("hs").bitwiseAND(low)
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"h_{p}"))) for p in _PARITY), F.lit(0))
    return F.greatest(both - 2 * rest, apart) * (100 + percent) <= (F.col("size") + F.col("h_size")) * (100 - percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    signed = scratch.save(signatures(own, shingle), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    grouped = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("t", "doc_id").alias("rep_t"))
    # the written table fixes each class's number
    classes = scratch.save(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    named = classes.select("id", F.col("rep").alias("doc_id"), F.col("rep_t").alias("t"))
    banded = usable.select("doc_id", "t", "bands").join(named, ["doc_id", "t"]).dropDuplicates(["id"])
    buckets = banded.select("id", F.explode("bands").alias("key"))

    prepared: list[DataFrame] = []

    def prepare(ids: DataFrame) -> linkage.Verify:
        asked = named.join(ids, "id", "left_semi")
        texts = scratch.save(own.join(asked, ["doc_id", "t"]).select("id", "text").dropDuplicates(["id"]), "texts")
        prepared.append(texts)
        return lambda pairs: confirm(pairs, texts, shingle, percent)

    def index(pairs: DataFrame) -> DataFrame:
        counts = slot_counts(prepared[0], shingle)
        return difference_keys(pairs, prepared[0], counts, shingle, percent)

    comps = linkage.link_buckets(buckets, prepare, scratch, index=index, possible=_possible(percent))
    placed = classes.join(comps, classes["id"] == comps["node"], "left").select("h1", "h2", "rep", F.coalesce("component", "id").alias("c"))
    least = placed.groupBy("c").agg(F.min("rep").alias("component_id"))
    joined = signed.join(scratch.save(placed.join(least, "c").select("h1", "h2", "component_id"), "placed"), ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

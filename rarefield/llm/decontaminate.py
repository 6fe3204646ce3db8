"""Operator 6: benchmark decontamination by rare seeds and word alignment.

Test items and documents meet at word 3-grams (seeds).  One scan of the
documents tests every 3-gram against a bit table of the items' seeds and, where
it hits, cuts out the passage around it, as word hashes, for each item with that
seed.  Seeds that are frequent in the corpus, and are not among the rarer half
of their item's seeds, lose their vote; a passage with a vote left is aligned
with its item by Smith-Waterman over words, which tolerates replaced, missing
and added words.  The score is the best local alignment over the item's length.

Items are searched in blocks of at most ``BLOCK_WORDS`` words, so what reaches
the workers has a fixed size; a larger test set takes more scans, not more
memory.  A worker holds ``_PAIRS`` hits of seeds with their items at a time, passages of
``_WORDS_OUT`` words, and alignments of ``_BATCH_CELLS`` words, or one pair's.  Document
texts are never shuffled.

Defined cases: a null text, an item with fewer than ``SEED`` words or a null id
takes no part; items of equal text are reported each; a document that holds an
item several times is reported once, with its best passage; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.llm import wordhash
from rarefield.llm.workers import releasing
from rarefield.scratch import Scratch

SEED = 3
BLOCK_WORDS = 1_000_000
FREQUENT_SHARE, FREQUENT_DOCS = 1e-3, 256
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
_BATCH_CELLS = 1 << 16
_PAIRS, _WORDS_OUT = 1 << 18, 1 << 18


@dataclass
class Items:
    """A block of test items: their word hashes, seeds by value, and a bit table of these."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seed: np.ndarray  # sorted
    item: np.ndarray  # of each seed, an index
    at: np.ndarray  # of each seed, its place within the item
    table: np.ndarray
    bits: int

    def of(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]


def items_block(ids: list[int], texts: list[str]) -> Items:
    words, seeds, item, at = [], [], [], []
    for row, _, data, offsets in wordhash.text_arrays(pa.array(texts, pa.string())):
        h, first, _, _ = wordhash.words(data, offsets)
        for k in range(len(first) - 1):
            w = h[first[k] : first[k + 1]]
            words.append(w)
            if len(w) >= SEED:
                s = wordhash.ngrams(w, SEED)
                seeds.append(s)
                item.append(np.full(len(s), row + k))
                at.append(np.arange(len(s)))
    seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    order = np.argsort(seed, kind="stable")
    bits = max(20, int(np.ceil(np.log2(max(1, len(seed)) * 256))))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for shift in (0, 32):
        p = (seed >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        np.bitwise_or.at(table, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    cat = lambda x: np.concatenate(x)[order] if x else np.zeros(0, np.int64)
    return Items(
        np.array(ids, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64), np.cumsum([0, *map(len, words)]), seed[order], cat(item), cat(at), table, bits
    )


def _hits(grams: np.ndarray, items: Items) -> np.ndarray:
    """Places of the n-grams that are seeds, first by the bit table, then by value."""
    mask = np.uint64((1 << items.bits) - 1)
    p = grams & mask
    on = np.flatnonzero((items.table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
    if len(on):
        at = np.minimum(np.searchsorted(items.seed, grams[on]), len(items.seed) - 1)
        on = on[items.seed[at] == grams[on]]
    return on


_PASSAGES = "doc_id long, item int, start long, window array<long>, seeds array<long>"


def _document_runs(doc: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of hits of whole documents, of ``_PAIRS`` pairs with items at most or of one document."""
    total = np.cumsum(n)
    s = 0
    while s < len(doc):
        e = int(np.searchsorted(total, (total[s - 1] if s else 0) + _PAIRS, "right"))
        if e < len(doc):
            e = int(np.searchsorted(doc, doc[e]))
        if e <= s:
            e = int(np.searchsorted(doc, doc[s], "right"))
        yield s, e
        s = e


def _met(low: np.ndarray, n: np.ndarray, items: Items, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hit, place among the seeds) of each hit with each item that has its seed, for the items of one part of ``parts``."""
    total = np.cumsum(n)
    found = []
    s = 0
    while s < len(n):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + _PAIRS, "right")))
        m = n[s:e]
        hit = np.repeat(np.arange(s, e), m)
        k = np.arange(len(hit)) - np.repeat(np.cumsum(m) - m, m) + low[hit]
        if parts > 1:
            mine = items.item[k] % parts == part
            hit, k = hit[mine], k[mine]
        found.append((hit, k))
        s = e
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _passage_rows(out: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([o[0] for o in out], pa.int64()),
            pa.array([o[1] for o in out], pa.int32()),
            pa.array([o[2] for o in out], pa.int64()),
            pa.array([o[3].view(np.int64) for o in out], pa.list_(pa.int64())),
            pa.array([o[4].view(np.int64) for o in out], pa.list_(pa.int64())),
        ],
        ["doc_id", "item", "start", "window", "seeds"],
    )


def search_batch(batch: pa.RecordBatch, it: Items) -> Iterator[pa.RecordBatch]:
    """The passages of a batch of (id, text), a few at a time."""
    length = np.diff(it.first)
    out: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
    held = 0
    ids = batch.column(0).to_pylist()
    for row, _, data, offsets in wordhash.text_arrays(batch.column(1)):
        h, first, _, _ = wordhash.words(data, offsets)
        if len(h) < SEED or not len(it.seed):
            continue
        grams = wordhash.ngrams(h, SEED)
        on = _hits(grams, it)
        doc = np.searchsorted(first, on, "right") - 1
        inside = on + SEED <= first[doc + 1]
        on, doc = on[inside], doc[inside]
        low, high = np.searchsorted(it.seed, grams[on]), np.searchsorted(it.seed, grams[on], "right")
        for s, e in _document_runs(doc, high - low):
            n = high[s:e] - low[s:e]
            parts = -(-int(n.sum()) // _PAIRS)
            for part in range(parts):
                hit, k = _met(low[s:e], n, it, part, parts)
                pos, d, item = on[s + hit], doc[s + hit], it.item[k]
                begin = pos - it.at[k]
                order = np.lexsort((begin, item, d))
                pos, d, item, begin = pos[order], d[order], item[order], begin[order]
                slack = length[item] // 2 + 8
                new = np.ones(len(pos), bool)
                new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])
                for a, b in pairwise([*np.flatnonzero(new).tolist(), len(pos)]):  # none where no hit is left
                    if ids[row + int(d[a])] is None:
                        continue
                    lo = max(int(first[d[a]]), int(begin[a]) - int(slack[a]))
                    hi = min(int(first[d[a] + 1]), int(begin[b - 1]) + int(length[item[a]]) + int(slack[a]))
                    out.append((ids[row + int(d[a])], int(item[a]), lo - int(first[d[a]]), h[lo:hi], np.unique(grams[pos[a:b]])))
                    held += hi - lo
                    if held >= _WORDS_OUT:
                        yield _passage_rows(out)
                        out, held = [], 0
    if out:
        yield _passage_rows(out)


def passages(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item, start, window, seeds): the words around the hits of one item that lie together."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from search_batch(batch, sent.value)

    return docs.mapInArrow(run, _PASSAGES)


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the window position after its end."""
    n = len(windows)
    best, end = np.zeros(n), np.zeros(n, np.int64)
    order = sorted(range(n), key=lambda k: (len(windows[k]), len(items[k])))
    at = 0
    while at < n:
        w = m = 1
        to = at
        while to < n:  # as many pairs as fit in the table of the widest of them
            wide, tall = max(w, len(windows[order[to]])), max(m, len(items[order[to]]))
            if to > at and (to + 1 - at) * max(wide, tall) > _BATCH_CELLS:
                break
            w, m, to = wide, tall, to + 1
        part = order[at:to]
        win, it = np.zeros((len(part), w), np.uint64), np.ones((len(part), m), np.uint64)
        for r, k in enumerate(part):
            win[r, : len(windows[k])] = windows[k]
            it[r, : len(items[k])] = items[k]
        slope = -GAP * np.arange(w, dtype=np.float32)
        above = np.zeros((len(part), w + 1), np.float32)
        top, place = np.zeros(len(part), np.float32), np.zeros(len(part), np.int64)
        rows = np.arange(len(part))
        for i in range(m):
            cell = np.where(win == it[:, i : i + 1], np.float32(MATCH), np.float32(MISMATCH))
            cell += above[:, :-1]
            np.maximum(cell, above[:, 1:] + np.float32(GAP), out=cell)
            np.maximum(cell, 0, out=cell)
            cell += slope
            np.maximum.accumulate(cell, axis=1, out=cell)
            cell -= slope
            above[:, 1:] = cell
            j = cell.argmax(axis=1)
            v = cell[rows, j]
            better = v > top
            top[better], place[better] = v[better], j[better] + 1
        best[part], end[part] = top, place
        at = to
    return best, end


_FOUND = "doc_id long, item_id long, score double, start_word long, end_word long"


def aligned(found: DataFrame, items: Items, rare: np.ndarray, threshold: float) -> DataFrame:
    """The passages with a rare seed whose alignment reaches the threshold."""
    sent = found.sparkSession.sparkContext.broadcast((items, rare))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, votes = sent.value
        for batch in batches:
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            where = np.repeat(np.arange(len(batch)), np.diff(batch.column(4).offsets.to_numpy()))
            item = batch.column(1).to_numpy(zero_copy_only=False)
            # a vote is a seed of an item: both decide
            key = wordhash.mix(flat.view(np.uint64) ^ wordhash.mix(item[where].astype(np.uint64)))
            at = np.minimum(np.searchsorted(votes, key), max(0, len(votes) - 1))
            hit = votes[at] == key if len(votes) else np.zeros(len(key), bool)
            rows = np.unique(where[hit])
            wins = [batch.column(3)[int(r)].values.to_numpy().view(np.uint64) for r in rows]
            their = [it.of(int(item[r])) for r in rows]
            best, end = align(wins, their)
            share = best / np.maximum([len(x) for x in their], 1) if len(rows) else best
            ok = np.flatnonzero(share >= threshold)
            back, length = align([wins[k][: end[k]][::-1] for k in ok], [their[k][::-1] for k in ok])
            first = batch.column(2).to_numpy(zero_copy_only=False)[rows[ok]] if len(ok) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[ok], pa.int64())),
                    pa.array(it.ids[item[rows[ok]]], pa.int64()),
                    pa.array(share[ok], pa.float64()),
                    pa.array(first + end[ok] - length, pa.int64()),
                    pa.array(first + end[ok], pa.int64()),
                ],
                ["doc_id", "item_id", "score", "start_word", "end_word"],
            )

    return found.mapInArrow(run, _FOUND)


def rare_votes(found: DataFrame, items: Items, n_docs: int) -> np.ndarray:
    """Sorted keys of the (seed, item) pairs that count as rare.

    The counts are document frequencies over the whole corpus; the block's size
    bounds their number.
    """
    frequency = found.select("doc_id", F.explode("seeds").alias("seed")).distinct().groupBy("seed").count()
    got = frequency.collect()
    seed = np.array([r["seed"] for r in got], np.int64).view(np.uint64)
    df = np.array([r["count"] for r in got], np.int64)
    if not len(seed):
        return np.zeros(0, np.uint64)
    order = np.argsort(seed)
    seed, df = seed[order], df[order]
    at = np.minimum(np.searchsorted(seed, items.seed), len(seed) - 1)
    present = seed[at] == items.seed
    s, item, n = items.seed[present], items.item[present], df[at[present]]
    order = np.lexsort((n, item))
    s, item, n = s[order], item[order], n[order]
    low, high = np.searchsorted(item, item), np.searchsorted(item, item, "right")
    half = n[low + (high - low - 1) // 2]
    keep = (n <= half) | (n <= max(FREQUENT_DOCS, FREQUENT_SHARE * n_docs))
    return np.unique(wordhash.mix(s[keep] ^ wordhash.mix(item[keep].astype(np.uint64))))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of every document and test item that it holds a copy of."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tests = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    parts: list[DataFrame] = []
    n_docs = own.count()
    ids: list[int] = []
    texts: list[str] = []
    size = 0

    def search() -> None:
        items = items_block(ids, texts)
        found = scratch.save(passages(own, items), "passages")
        parts.append(aligned(found, items, rare_votes(found, items, n_docs), threshold))

    for r in tests.orderBy("item_id", "text").toLocalIterator():
        n = r["text"].count(" ") + r["text"].count("\n") + 1
        if ids and size + n > BLOCK_WORDS:
            search()
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    search()
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), (-F.col("end_word")).alias("e"))).alias("b")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("start_word"), (-F.col("b.e")).alias("end_word"))

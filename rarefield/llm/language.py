"""Operator 10: language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams in order (Cavnar and
Trenkle, 1994).  A document's own most frequent n-grams are compared with each
profile by the out-of-place distance: the sum of rank differences, with the
profile's length for an n-gram that it lacks.

Profiles are learned from a bounded number of labelled documents per language
(about ``TRAIN_DOCS``, one at least, chosen by a hash of their id and text; equal
rows count once), whose n-gram counts are
summed by Spark, so the driver receives only the ranked profiles.

Defined cases: a null text or one without letters is ``und`` with score 0; equal
distances go to the alphabetically first language; with no profile every
document is ``und``, and an empty table gives no profile; texts are read whole,
piece by piece; rows that repeat an id are rows of their own; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefield.llm.workers import releasing

TRAIN_DOCS = 1500  # per language
PROFILE = 400
ORDERS = 3  # n-grams of 1 to 3 characters
PIECE = 1 << 18
UNKNOWN = "und"

_LETTER = None


def _letters() -> np.ndarray:
    """For each code point: its lower-case form, or a space where it is no letter."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER = table
    return _LETTER


def gram_codes(text: str) -> np.ndarray:
    """Codes of all letter n-grams of a text; words are padded by one space each side, and n-grams do not cross words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.concatenate(([32], _letters()[np.minimum(points, 0x10FFFF)], [32])).astype(np.uint64)
    gap = low == 32
    if len(low) > 2:
        keep = ~(gap & np.concatenate(([False], gap[:-1])))  # runs of spaces become one
        low, gap = low[keep], gap[keep]
    parts = [low[~gap]]
    if not len(parts[0]):
        return parts[0]
    shift = np.uint64(21)
    two = (low[:-1] << shift) | low[1:]
    parts.append(two)
    if ORDERS > 2 and len(low) > 2:
        parts.append(((two[:-1] << shift) | low[2:])[~gap[1:-1]])
    return np.concatenate(parts)


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` frequent codes, most frequent first, ties by code."""
    return most_frequent(*np.unique(codes, return_counts=True), most)


def most_frequent(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    if len(values) > most:
        cut = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= cut
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:most]


def pieces_of(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters that end between words, so that their n-grams are the text's."""
    at = 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to].isalpha():
            to += 1
        yield text[at:to]
        at = to


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a text's n-grams, sorted by code; memory is bounded by a piece and by the different n-grams."""
    values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for piece in pieces_of(text):
        v, n = np.unique(gram_codes(piece), return_counts=True)
        values, back = np.unique(np.concatenate([values, v]), return_inverse=True) if len(values) else (v, np.arange(len(v)))
        counts = np.bincount(back, np.concatenate([counts, n]), len(values)).astype(np.int64)
    return values, counts


def _counts(docs: DataFrame) -> DataFrame:
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, counts = gram_counts(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long")


def slot_bound(wanted: int, n: int, least: int) -> int:
    """The largest 64-bit hash of a row that is taken, so that of ``n`` rows about ``wanted`` are, the least always."""
    share = min((wanted << 64) // max(n, 1), 1 << 64)
    return max(share - (1 << 63) - 1, least)


def learn_profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", train_docs: int = TRAIN_DOCS, size: int = PROFILE, id_col: str = "doc_id") -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams in about ``train_docs`` of its documents, one at least.

    The number of languages bounds what reaches the driver: ``size`` numbers each.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("slot"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("slot").alias("least")).collect()  # a row for each language
    if not known:
        return {}
    bound = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], slot_bound(train_docs, r["n"], r["least"]))])
    taken = rows.where(F.col("slot") <= F.element_at(bound, F.col("lang"))).dropDuplicates(["lang", "slot"]).select("lang", "text")
    totals = _counts(taken).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("lang", "gram", "r")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():
        found.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {lang: [g for _, g in sorted(v)] for lang, v in sorted(found.items())}


class Profiles:
    """Out-of-place distances of texts to a set of profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.size = max((len(p) for p in profiles.values()), default=0)
        grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64)) if self.size else np.zeros(0, np.uint64)
        self.grams = grams
        self.rank = np.full((len(grams), len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            at = np.searchsorted(grams, np.array(profiles[lang], np.int64).view(np.uint64))
            self.rank[at, k] = np.arange(len(at))

    def identify(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 for a perfect match and 0 for one with nothing in common."""
        values, counts = gram_counts(text) if text else (np.zeros(0, np.uint64),) * 2
        if not len(values) or not self.langs:
            return UNKNOWN, 0.0
        own = most_frequent(values, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = np.where((self.grams[at] == own)[:, None], self.rank[at], -1)
        away = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))[:, None]), self.size)
        total = away.sum(axis=0)
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(sent.value)
        for batch in batches:
            found = [p.identify(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, all columns as they are; texts stay in their partition."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([p.identify(t.as_py())[0] != UNKNOWN for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(docs: DataFrame, id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether a row is kept from training: crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold

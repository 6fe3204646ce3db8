"""Operator 5: quality scores by compression against two zstandard dictionaries.

One dictionary is built from good and one from bad labelled texts.  A text that
resembles the good ones compresses better with the good dictionary; the raw
score is the difference of the compressed sizes, normalised by the size without
any dictionary.  A logistic curve over it and over the plain compression ratio
(repetitive text compresses too well with any dictionary), fitted on labelled
texts that are in neither dictionary, turns it into a probability.

Long texts are compressed in windows of ``WINDOW`` bytes, all of them, so that a
dictionary counts throughout and not only near the beginning; the sizes are sums
over a text's windows.

The fit uses a bounded sample of the labelled training rows: at most
``SAMPLE_PER_CLASS`` of each label, the first by a hash of their text.  Every
other row is only scored.

Defined cases: null and empty texts get the calibrated score of no evidence (the
labelled share of good texts); with no labels, or of one kind only, every score
is that share or 0.5; several labels for one id all count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.llm.workers import releasing

SAMPLE_PER_CLASS = 2000
DICTIONARY_BYTES = 400_000
WINDOW = 1024
LEVEL = 3


@dataclass
class Model:
    """Two dictionaries and the logistic curve over (difference, plain ratio, 1)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


class Scorer:
    """Scores of one worker; the compressors keep their digested dictionaries."""

    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        self.ready = bool(model.good and model.bad)
        if self.ready:
            made = [z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT) for d in (model.good, model.bad)]
            for d in made:
                d.precompute_compress(level=LEVEL)
            self.good, self.bad = (z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in made)
            self.plain = z.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def measure(self, text: str | None) -> tuple[float, float]:
        """((bad size - good size) / plain size, plain size / size) over all windows; zeros for no text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data or not self.ready:
            return 0.0, 0.0
        g = b = p = 0
        for at in range(0, len(data), WINDOW):
            part = data[at : at + WINDOW]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
            p += len(self.plain.compress(part))
        return (b - g) / p, p / len(data)

    def score(self, text: str | None) -> float:
        m = self.model
        if not text or not self.ready:
            return m.prior
        z = sum(w * x for w, x in zip(m.weights, (*self.measure(text), 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts: of each label, every other one fills the dictionary and the rest fit the curve."""
    prior = (sum(labels) + 1) / (len(labels) + 2)
    by: dict[int, list[bytes]] = {0: [], 1: []}
    rest: list[tuple[str, int]] = []
    seen = {0: 0, 1: 0}
    for t, y in zip(texts, labels, strict=True):
        seen[y] += 1
        if seen[y] % 2:
            by[y].append(t.encode("utf-8", "surrogatepass"))
        else:
            rest.append((t, y))
    if not by[0] or not by[1] or len({y for _, y in rest}) < 2:
        return Model(b"", b"", (0.0, 0.0, 0.0), prior)
    model = Model(dictionary(by[1]), dictionary(by[0]), (0.0, 0.0, 0.0), prior)
    scorer = Scorer(model)
    model.weights = logistic(np.array([scorer.measure(t) for t, _ in rest]), np.array([y for _, y in rest], float))
    return model


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of up to ``size`` bytes: zstandard's own selection, or the samples themselves where they are too few for it."""
    import zstandard as z

    parts = [s[at : at + 2048] for s in samples for at in range(0, len(s), 2048)]
    try:
        return z.train_dictionary(size, parts, k=256, d=8, level=LEVEL).as_bytes()
    except z.ZstdError:
        return (b"".join(samples) or b"\0" * 8)[:size]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[float, ...]:
    """Weights, the constant last, of a lightly penalised logistic curve, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    a = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(a.shape[1]), 1e-3 * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[:-1] / scale
    return (*map(float, slope), float(w[-1] - slope @ mean))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Up to ``per_class`` labelled texts of each label 0 and 1, by a hash of their id, in that order.

    Only ids are ordered; the chosen ones, at most twice ``per_class``, are then
    looked up, so the driver receives that many texts and no more; where an id
    repeats, the least of its texts is taken.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    picked = [rows.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    both = picked[0].union(picked[1]).dropDuplicates(["_id", "_label"])
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    got = own.join(F.broadcast(both), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    got.sort(key=lambda r: (r["_label"], r["_id"], r["_text"]))
    return [r["_text"] for r in got], [r["_label"] for r in got]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``; the model is two dictionaries of a fixed size and three numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in batches:
            found = [s.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")

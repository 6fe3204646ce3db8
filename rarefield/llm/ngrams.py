"""Operator 12: scores of texts by a word trigram model in Elias-Fano tries.

The model is learned from the rows that ``train`` marks, over all their n-grams, and
every row is scored:

    P1(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P2(w|v)   = c(v w) / (c(v) + PAIR) + PAIR / (c(v) + PAIR) P1(w)
    P3(w|u v) = c(u v w) / (c(u v) + TRIPLE) + TRIPLE / (c(u v) + TRIPLE) P2(w|v)

Tokens are the words between white space, A-Z in lower case, and one end for each
text; two begin marks are context only.  The fractions by counts are kept as bytes
(24 steps for each factor of ten), so a text's score has that error.

No task and no driver holds the model.  Texts are read once and become batches of
about ``BATCH`` tokens: numbers of words, and the list of different words.  Batches
ask shards for what they need, twice, each time only once for each different word
or n-gram:

1. words are dealt to shards by hash; a shard counts its words over all batches and
   answers with their numbers (frequent words small) and counts;
2. n-grams ``u v w`` are dealt by v; a shard builds a trie of the training n-grams
   that reached it and looks up all that were asked.

So what is shuffled grows with the input, and a shard's size is set by ``shard_bytes``.
A word v that holds more than ``hot`` tokens is split by u over several shards, and
its pairs ``v w``, which need all u, by w; the scores don't change by it.

Defined cases: a null text is empty and has one token, the end; rows with a null id
are rows like others; equal rows count as often as they occur; with no training row
every probability is 1 and the scores are 0; an empty table gives an empty table; a
text longer than a batch is read in several, in pieces that carry their context;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.llm import trie
from rarefield.llm.workers import releasing
from rarefield.scratch import Scratch

BATCH = 1 << 19
SHARD_BYTES = 4 << 20  # of text, for each shard of n-grams
HOT = 1 << 20
PAIR, TRIPLE = 8.0, 4.0
PIECE = 4 << 20
_END, _BEGIN = b" ", b"\t"  # no words: they hold white space


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2**63, compressed with like bytes side by side."""
    head = np.array([len(arrays), *map(len, arrays)], "<i8")
    planes = [head.tobytes()]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = (top.bit_length() + 7) // 8
        planes.append(bytes([width]) + np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for size in sizes.tolist():
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, width * size, at + 1).reshape(width, size)
        a = np.zeros(size, np.int64)
        for k in range(width):
            a |= planes[k].astype(np.int64) << np.int64(8 * k)
        out.append(a)
        at += 1 + width * size
    return out


class _Words(dict):
    """Numbers words in the order they first come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_lists(data: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lower case, in lists of bounded size."""
    at = 0
    while len(data) - at > piece:
        to = at + piece
        while to < len(data) and data[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield data[at:to].lower().split()
        at = to
    yield data[at:].lower().split()


def _batches(docs: DataFrame, shards: int, batch_tokens: int) -> DataFrame:
    """Token batches (shard -1) and, for each shard, the different words of a batch with their training counts."""
    schema = "batch long, shard int, data binary, ids array<long>, n_train long"
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, row = TaskContext.get().partitionId() << 32, 0, 0
        words: _Words = _Words()
        toks: list[int] = []
        pieces: list[tuple[int, int, int, int, int]] = []  # row, train, context tokens, tokens, whether the id is null
        ids: list[int | None] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal words, toks, pieces, ids, made
            if not pieces:
                return
            names = list(words)
            shard = np.fromiter((xxhash.xxh64_intdigest(x) % shards for x in names), np.int64, len(names))
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            t = place[np.array(toks, np.int64)]
            own = np.array(pieces, np.int64)
            scored, learned = _scored(own)
            n = np.bincount(t[learned], minlength=len(names))
            n[place[words[_BEGIN]]] = int((own[:, 1] & (t[np.cumsum(own[:, 3]) - own[:, 3] + 1] == place[words[_BEGIN]])).sum())
            out = [(part + made, -1, pack(t, *own.T, np.array([len(names), place[words[_BEGIN]], place[words[_END]]])), ids, len(learned))]
            names = [names[k] for k in order]
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                a, b = int(cuts[s]), int(cuts[s + 1])
                told = zstandard.ZstdCompressor(level=1).compress(b"\n".join(names[a:b]))
                out.append((part + made, int(s), len(told).to_bytes(8, "little") + told + pack(n[a:b]), None, None))
            made += 1
            words, toks, pieces, ids = _Words(), [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["batch", "shard", "data", "ids", "n_train"])

        for batch in batches:
            for doc_id, text, train in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                before = [_BEGIN, _BEGIN]
                for part_words in _and_end(word_lists(text.as_py() or b"")):
                    for at in range(0, len(part_words), batch_tokens):
                        own = part_words[at : at + batch_tokens]
                        if len(toks) + len(own) > batch_tokens:
                            yield from flush()
                        toks.extend(map(words.__getitem__, before))
                        toks.extend(map(words.__getitem__, own))
                        words[_BEGIN], words[_END]  # both have numbers in every batch
                        pieces.append((part + row, int(train), 2, 2 + len(own), int(doc_id is None)))
                        ids.append(doc_id or 0)
                        before = (before + own[-2:])[-2:]
                row += 1
        yield from flush()

    return docs.mapInArrow(run, schema)


def _and_end(lists: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
    held = next(lists)
    for more in lists:
        if held:
            yield held
        held = more
    yield [*held, _END]


def _scored(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that are scored, and of those that are learned from."""
    n, context = pieces[:, 3], pieces[:, 2]
    first = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(first, n)
    scored = inside >= np.repeat(context, n)
    return np.flatnonzero(scored), np.flatnonzero(scored & np.repeat(pieces[:, 1] > 0, n))


def _by_shard(asked: DataFrame, answer: Callable[[int, list[bytes]], tuple[list[bytes], int]]) -> DataFrame:
    """(batch, shard, data, total): ``answer`` gets all requests of a shard and returns one reply to each, and a total."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, froms, held = -1, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                replies, total = answer(shard, held)
                for k in range(len(held)):
                    yield pa.RecordBatch.from_arrays([pa.array([froms[k]], pa.int64()), pa.array([shard], pa.int32()), pa.array([replies[k]], pa.binary()), pa.array([total if k == 0 else 0], pa.int64())], ["batch", "shard", "data", "total"])

        for batch in batches:
            for b, s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != shard:
                    yield from flush()
                    shard, froms, held = s, [], []
                froms.append(b)
                held.append(data.as_py())
        yield from flush()

    return asked.select("batch", "shard", "data").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "batch long, shard int, data binary, total long")


def _number_words(shards: int) -> Callable[[int, list[bytes]], tuple[list[bytes], int]]:
    def answer(shard: int, asked: list[bytes]) -> tuple[list[bytes], int]:
        words, places, counts = _Words(), [], []
        for data in asked:
            size = int.from_bytes(data[:8], "little")
            names = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]).split(b"\n")
            places.append(np.fromiter(map(words.__getitem__, names), np.int64, len(names)))
            counts.extend(unpack(data[8 + size :]))
        total = np.bincount(np.concatenate(places), np.concatenate(counts), len(words)).astype(np.int64)
        names = list(words)
        order = sorted(range(len(names)), key=lambda k: (-total[k], names[k]))
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names)) * shards + shard
        known = int((total > 0).sum()) - int(_BEGIN in words and total[words[_BEGIN]] > 0)
        return [pack(number[p], total[p]) for p in places], known

    return answer


def _look_up(asked: list[bytes]) -> tuple[list[bytes], int]:
    """Builds a shard's trie from the training n-grams among the requests and answers them all."""
    rows = [unpack(data) for data in asked]
    sizes = np.cumsum([0, *(len(r[1]) for r in rows)])
    v = np.concatenate([np.repeat(np.cumsum(r[0]), r[3]) for r in rows])
    total = np.concatenate([np.repeat(r[4], r[3]) for r in rows])
    u = np.concatenate([r[1] for r in rows]) - 1
    w, n = (np.concatenate([r[k] for r in rows]) for k in (2, 5))
    del rows
    (lv, iv), (lu, iu), (lw, iw) = map(trie.distinct, (v, u, w))
    context, n_contexts = iv * np.int64(len(lu)) + iu, len(lv) * len(lu)
    if n_contexts * len(lw) >= 1 << 63:
        context = np.unique(context, return_inverse=True)[1]
    key = context * np.int64(len(lw)) + iw
    del context, iv, iu, iw
    # a row of each different n-gram, and of which each row is; equal ones agree in all but their counts
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    at = order[first]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    del order, first
    count = np.bincount(back, n, len(at)).astype(np.int64)
    v, u, w, total = v[at], u[at], w[at], total[at]
    del key, n, at
    seen = count > 0
    known = trie.Trie(trie.build(v[seen], u[seen], w[seen], count[seen], total[seen], PAIR, TRIPLE))
    codes = [c.astype(np.int64)[back] for c in known.look_up(v, u, w)]
    return [pack(*(c[a:b] for c in codes)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)], int(seen.sum())


class _Asked:
    """The different n-grams of a batch, in the order in which they are asked."""

    def __init__(self, data: bytes, numbers: list[bytes], shards: int, hot: int):
        t, *rest = unpack(data)
        self.pieces = np.stack(rest[:5], axis=1)
        size, begin, end = rest[5].tolist()
        told = [unpack(x) for x in numbers]
        ids, counts = (np.concatenate([x[k] for x in told]) for k in (0, 1))
        rank = np.argsort(np.argsort(ids))
        by_rank = np.argsort(ids)
        scored, learned = _scored(self.pieces)
        r = rank[t]
        n = np.int64(size)
        key = (r[scored - 1] * n + r[scored - 2]) * n + r[scored]
        self.counts, self.word = counts, t[scored]
        self.context_count = counts[t[scored - 1]]
        keys, self.of_token = np.unique(key, return_inverse=True)
        train = np.zeros(len(t), bool)
        train[learned] = True
        times = np.bincount(self.of_token, train[scored], len(keys)).astype(np.int64)
        v, u, w = keys // (n * n), keys // n % n, keys % n
        vc = counts[by_rank[v]]
        # pairs of the words that are split come from a shard of their own
        self.hot = vc > hot
        pair, self.pair_of = np.unique(v[self.hot] * n + w[self.hot], return_inverse=True)
        pair_times = np.bincount(self.pair_of, times[self.hot], len(pair)).astype(np.int64)
        v = np.concatenate([v, pair // n])
        w = np.concatenate([w, pair % n])
        u = np.concatenate([u, np.full(len(pair), -1)])
        times = np.concatenate([times, pair_times])
        vc = counts[by_rank[v]]
        v, w = ids[by_rank[v]], ids[by_rank[w]]
        u = np.where(u < 0, -1, ids[by_rank[u]])
        salts = np.where(vc > hot, np.minimum(vc // hot + 1, shards), 1)
        salt = np.where(salts > 1, _mixed(np.where(u < 0, w, u)) % salts, 0)
        shard = (_mixed(v) + salt) % shards
        self.triples = len(keys)
        # by shard, then v; short numbers are sorted by their digits
        by_v = np.argsort(v, kind="stable")
        self.order = by_v[np.argsort(shard[by_v].astype(np.uint16 if shards <= 1 << 16 else np.int64), kind="stable")]
        self.columns, self.shard = (v, u + 1, w, times, vc), shard

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """Each shard's n-grams, by v: the different v, the rest of each n-gram, how many each v has, its count, and the training counts."""
        shard, *columns = (x[self.order] for x in (self.shard, *self.columns))
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            v, u, w, times, vc = (x[a:b] for x in columns)
            first = np.flatnonzero(np.concatenate(([True], np.diff(v) > 0)))
            yield int(shard[a]), pack(np.diff(v[first], prepend=0), u, w, np.diff(np.append(first, b - a)), vc[first], times)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash below 2**31 of whole numbers."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)).astype(np.int64)


def _gathered(replies: DataFrame, name: str) -> DataFrame:
    """One row for each batch: the replies in the order of their shards."""
    sorted_ = F.sort_array(F.collect_list(F.struct("shard", "data")))
    return replies.groupBy(F.col("batch").alias(f"b_{name}")).agg(F.transform(sorted_, lambda x: x["data"]).alias(name))


def score_corpus(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row; ``trained``: the model learned from it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // shard_bytes + 1
    word_shards = shards // 4 + 1
    # batches lie in buckets, so that neither of the two joins with replies deals them out again
    name = f"ngrams_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _batches(own, word_shards, batch_tokens).write.bucketBy(buckets, "batch").option("path", f"{scratch.root}/{name}").saveAsTable(name)
    table = spark.table(name)
    tokens = table.where("shard = -1").select("batch", "data", "ids")
    numbers = scratch.save(_by_shard(table.where("shard >= 0"), _number_words(word_shards)), "numbers")
    n_all = table.where("shard = -1").agg(F.sum("n_train")).first()[0] or 0
    v_all = numbers.agg(F.sum("total")).first()[0] or 0
    numbered = tokens.join(_gathered(numbers, "numbers"), F.col("batch") == F.col("b_numbers"))

    @releasing
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for shard, data in _Asked(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), shards, hot).requests():
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["batch", "shard", "data"])

    asked = numbered.select("batch", "data", "numbers").mapInArrow(ask, "batch long, shard int, data binary")
    replies = _by_shard(asked, lambda _, held: _look_up(held))

    @releasing
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ids, numbers_, grams in zip(*batch.columns, strict=True):
                yield _finished(_Asked(data.as_py(), numbers_.as_py(), shards, hot), ids, grams.as_py(), n_all, v_all)

    ready = numbered.join(_gathered(replies, "grams"), F.col("batch") == F.col("b_grams")).select("data", "ids", "numbers", "grams")
    parts = ready.mapInArrow(finish, "row long, doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("trained").alias("trained"), *sums)
    done = scratch.save(whole.select("doc_id", "trained", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score"), "scores")
    spark.sql(f"DROP TABLE {name}")
    scratch.remove(f"{scratch.root}/{name}")
    scratch.drop(numbers)
    return done


def _finished(asked: _Asked, ids: pa.ListScalar, grams: list[bytes], n_all: int, v_all: int) -> pa.RecordBatch:
    """The sums of each piece of a batch."""
    told = [unpack(x) for x in grams]
    codes = np.empty((3, len(asked.order)), np.uint8)
    for k in range(3):
        codes[k, asked.order] = np.concatenate([x[k] for x in told])
    triple, mass, pair = codes[:, : asked.triples]
    pair[asked.hot] = codes[2, asked.triples :][asked.pair_of]
    count = asked.counts[asked.word].astype(np.float64)
    one = (count + 0.1) / (n_all + 0.1 * (v_all + 1))
    vc = asked.context_count
    t = asked.of_token
    two = trie.probability(pair)[t] + PAIR / (vc + PAIR) * one
    left = np.where(mass == trie.NONE, 1.0, trie.probability(mass))
    three = trie.probability(triple)[t] + left[t] * two
    pieces = asked.pieces
    n = pieces[:, 3] - pieces[:, 2]
    first = np.cumsum(n) - n
    sums = lambda x: np.add.reduceat(x, first)  # noqa: E731  every piece has a token
    columns = [
        pa.array(pieces[:, 0]),
        pa.array([None if null else i for i, null in zip(ids.as_py(), pieces[:, 4], strict=True)], pa.int64()),
        pa.array(pieces[:, 1] > 0),
        pa.array(n),
        pa.array(sums((count > 0).astype(np.int64))),
        pa.array(sums(np.log10(one))),
        pa.array(sums(np.log10(three))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "trained", "n_tokens", "n_known", "base_score", "score"])

"""Operator 2: SentencePiece BPE encoding and decoding with a prefix table.

A BPE encoding is determined by its adjacent pairs: a sequence of pieces is the
encoding of its text exactly when every adjacent pair is the encoding of its
own concatenation.  Hence each prefix of a text has one possible last piece.
The encoder walks an Aho-Corasick automaton over the pieces; at each position
it keeps the one match whose left neighbour (the last piece of the prefix
before it) is compatible, and reads the ids backwards from the end.

The argument needs distinct merge priorities.  The model's runs of white space
share one priority, so segments with two or more leading space marks are merged
directly, as are the short concatenations that decide compatibility.

Defined cases: a null text encodes as the empty text, with no ids; characters
outside the vocabulary become byte pieces; texts of any length are encoded
whole; extra columns are ignored, repeated rows give repeated results.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.llm.workers import releasing

MARK = "▁"  # the space mark of the piece vocabulary
CACHE_SEGMENTS = 150_000  # segments remembered per worker; a bound on memory only
CACHE_PAIRS = 1_500_000


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("rarefield_one_by_one", _one_by_one)


class PieceCodec:
    """Encodes and decodes as the library does for one model file, without begin or end ids."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        n = model.vocab_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.plain: list[str] = [p.replace(MARK, " ") for p in self.piece]
        self.byte_of: dict[int, int] = {}
        self.silent = {i for i in range(n) if model.is_control(i)}
        for i, p in enumerate(self.piece):
            if model.is_byte(i):
                self.byte_of[i] = int(p[3:5], 16)
                self.byte_id[self.byte_of[i]] = i
            elif model.is_unknown(i):
                self.plain[i] = " ⁇ "
            elif i in self.silent:
                self.plain[i] = ""
            else:
                self.ids[p] = i
                self.score[p] = model.get_score(i)
        for i, b in self.byte_of.items():
            self.plain[i] = chr(b) if b < 128 else ""
        self.high = frozenset(i for i, b in self.byte_of.items() if b >= 128)
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.matcher = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matcher.add_word(p, (len(p), i))
        self.matcher.make_automaton()
        self.first = {i for p, i in self.ids.items() if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.after_space: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.as_is: dict[str, tuple[int, ...]] = {}
        self.newline = tuple(self._unknown("\n")) if "\n" not in self.known else None

    # -- merging, used for compatibility tests and runs of white space

    def merged(self, text: str) -> list[int]:
        """The pieces that repeated best-first merging leaves of ``text`` (known characters only)."""
        n = len(text)
        size = [1] * n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                joined = self.score.get(text[left : right + size[right]])
                if joined is not None:
                    heapq.heappush(heap, (-joined, left, size[left], size[right]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if size[left] != a or right >= n or size[right] != b:
                continue
            size[left], size[right] = a + b, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        out, k = [], 0
        while k < n:
            out.append(self.ids[text[k : k + size[k]]])
            k += size[k]
        return out

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.piece[left] + self.piece[right]) == [left, right]
        return known

    def _stands(self, piece: int) -> bool:
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = self.merged(self.piece[piece]) == [piece]
        return known

    # -- the prefix table

    def by_prefixes(self, text: str) -> list[int]:
        """The ids of ``text``, all of whose characters are pieces."""
        last = [-1] * (len(text) + 1)
        width = [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (n, piece) in self.matcher.iter(text):
            if width[end + 1]:
                continue
            start = end + 1 - n
            if start:
                known = pairs.get(last[start] << 32 | piece)
                if known is None:
                    known = self._fits(last[start], piece)
            else:
                known = self._stands(piece)
            if known:
                last[end + 1], width[end + 1] = piece, n
        out, k = [], len(text)
        while k:
            out.append(last[k])
            k -= width[k]
        out.reverse()
        return out

    def _unknown(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def segment(self, text: str) -> tuple[int, ...]:
        """The ids of a segment: leading space marks, then no further mark."""
        if not self.known.issuperset(text):
            out: list[int] = []
            run = 0
            for k, c in enumerate(text):
                if c not in self.known:
                    if k > run:
                        out.extend(self.segment(text[run:k]))
                    out.extend(self._unknown(c))
                    run = k + 1
            if run < len(text):
                out.extend(self.segment(text[run:]))
            return tuple(out)
        return tuple(self.merged(text) if text.startswith(MARK * 2) else self.by_prefixes(text))

    def _as_is(self, text: str) -> tuple[int, ...]:
        found = self.as_is.get(text)
        if found is None:
            found = self.segment(text)
            if len(self.as_is) < CACHE_SEGMENTS and len(text) <= 64:
                self.as_is[text] = found
        return found

    def _after_space(self, word: str) -> tuple[int, ...]:
        """Two generations of remembered words: what is asked for again moves to the younger one."""
        found = self.older.get(word)
        if found is None:
            found = self.segment(MARK + word)
        if len(word) <= 64:
            if len(self.after_space) >= CACHE_SEGMENTS:
                self.older = self.after_space.copy()
                self.after_space.clear()
            self.after_space[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """All ids of ``text``."""
        if not text:
            return []
        out: list[int] = []
        get, extend = self.after_space.get, out.extend
        lines = [text] if self.newline is None else text.split("\n")
        for k, line in enumerate(lines):
            if k:
                extend(self.newline)
            words = line.split(" ")
            if MARK in line or "" in words:
                marked = (MARK if not k else "") + line.replace(" ", MARK)
                for part in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked):
                    extend(self._as_is(part))
                continue
            if k:
                extend(self._as_is(words[0]))
                del words[0]
            for w in words:
                found = get(w)
                extend(self._after_space(w) if found is None else found)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: one leading space goes, invalid bytes become U+FFFD each."""
        if not ids:
            return ""
        if self.high.isdisjoint(ids):
            out = "".join(map(self.plain.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "rarefield_one_by_one"))
                    run.clear()
                parts.append(self.plain[i])
            parts.append(run.decode("utf-8", "rarefield_one_by_one"))
            out = "".join(parts)
        head = next((i for i in ids if i not in self.silent), None)
        return out[1:] if head is not None and self.piece[head].startswith(MARK) else out


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The worker's codec for a model file, made once."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``, whole texts."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of :func:`encode_documents`."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            texts = [None if i is None else c.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so that ids never leave the worker."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        named = [str(i) for i in range(len(c.piece))].__getitem__
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                n.append(len(ids))
                a.append(sha(",".join(map(named, ids)).encode()).hexdigest())
                b.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): the ids, and whether decoding them gives the text, its space marks read as spaces."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, same = [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    found = c.encode(text)
                    same.append(c.decode(found) == text.replace(MARK, " "))
                    ids.append(np.array(found, np.int32))
                n = [len(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")

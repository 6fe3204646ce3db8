"""Operator 3: token counts with a two-tier lookup of pre-token lengths.

Tier one is a compact table of frequent pre-tokens and their token counts,
taken from a bounded sample of texts (``table_sample_rows``; it decides only
which entries are fast, never a result) and broadcast to the workers.  Tier two
is each worker's own cache; what neither holds is encoded by the library.  No
pre-token is ever shuffled.

White space splits a text into chunks that the tokenizer treats alone: a single
space or line break between two other characters always begins or forms a
pre-token.  Texts with any other white space at such a place, or with a special
string, are encoded whole by the library.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); texts
are never truncated; a tokenizer that normalises or adds tokens is always asked
for whole texts.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.llm.workers import releasing

CACHE_CHUNKS = 200_000
TABLE_SAMPLE_ROWS = 512
TABLE_ENTRIES = 32_768
_WHOLE = 64  # chunks up to this length are remembered


class TokenCounter:
    """Counts the tokens that the library gives, without begin, end or added tokens."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunked = False
        self.library = self.pieces = None
        if tokenizer_file.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file)
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(tokenizer_file)
            self.library.no_truncation()
            self.library.no_padding()
            self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
            import json

            with open(tokenizer_file, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            self.chunked = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.frequent: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.newline = self.whole("\n") if self.chunked else 0

    def whole(self, text: str) -> int:
        """Tokens of a text, by the library alone."""
        if self.pieces is not None:
            return len(self.pieces.encode(text))
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _length(self, pre: str) -> int:
        n = self.frequent.get(pre)
        if n is None:
            n = self.cache.get(pre)
            if n is None:
                n = self.whole(pre)
                if len(self.cache) < CACHE_CHUNKS and len(pre) <= _WHOLE:
                    self.cache[pre] = n
        return n

    def _chunk(self, chunk: str) -> int:
        """Tokens of a chunk: one whole pre-token where the table or cache has it, else the sum over its pre-tokens."""
        n = self.frequent.get(chunk)
        if n is None:
            n = sum(map(self._length, self.pre_tokens(chunk)))
        return n

    def _spaced(self, word: str) -> int:
        """Two generations of remembered words: what is asked for again moves to the younger one."""
        n = self.older.get(word)
        if n is None:
            n = self._chunk(" " + word)
        if len(word) <= _WHOLE:
            if len(self.spaced) >= CACHE_CHUNKS:
                self.older = self.spaced.copy()
                self.spaced.clear()
            self.spaced[word] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of ``text``."""
        if not text:
            return 0
        if not self.chunked or any(s in text for s in self.special):
            return self.whole(text)
        n, get = 0, self.spaced.get
        lines = text.split("\n")
        for k, line in enumerate(lines):
            words = line.split(" ")
            head = words.pop(0)
            if not head or head[0].isspace() or head[-1].isspace():
                return self.whole(text)
            found = self.cache.get(head)
            if found is None:
                found = self._chunk(head)
                if len(self.cache) < CACHE_CHUNKS and len(head) <= _WHOLE:
                    self.cache[head] = found
            n += found + (self.newline if k else 0)
            for w in words:
                found = get(w)
                if found is None:
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self.whole(text)
                    found = self._spaced(w)
                n += found
        return n


_COUNTERS: dict[str, TokenCounter] = {}


def counter(tokenizer_file: str) -> TokenCounter:
    """The worker's counter for a tokenizer file, made once."""
    if tokenizer_file not in _COUNTERS:
        _COUNTERS[tokenizer_file] = TokenCounter(tokenizer_file)
    return _COUNTERS[tokenizer_file]


def frequent_lengths(docs: DataFrame, tokenizer_file: str, text_col: str = "text", rows: int = TABLE_SAMPLE_ROWS, entries: int = TABLE_ENTRIES, id_col: str = "doc_id") -> tuple[str, bytes]:
    """The most frequent pre-tokens of about ``rows`` whole texts, chosen by a hash, joined by NUL, and their token counts, a byte each."""
    c = counter(tokenizer_file)
    if not c.chunked:
        return "", b""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    slot = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000))
    known = texts.agg(F.count("*").alias("n"), F.min(slot).alias("least")).first()
    if not known["n"]:
        return "", b""
    bound = max(int(min(1.0, rows / known["n"]) * 1_000_000), known["least"] + 1)
    words = texts.where(slot < bound).select(F.explode(F.split("text", "[ \n]")).alias("w")).groupBy("w").count()
    common = [(r["w"], r["count"]) for r in words.orderBy(F.desc("count"), "w").limit(entries).collect()]
    seen: Counter[str] = Counter()
    for word, n in common:
        if word:
            for pre in c.pre_tokens(" " + word):
                seen[pre] += n
    kept = [(p, k) for p, _ in seen.most_common(entries) if "\0" not in p and (k := c.whole(p)) < 256]
    return "\0".join(p for p, _ in kept), bytes(k for _, k in kept)


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_file, text_col, id_col=id_col))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_file)
        if not c.frequent and table.value[1]:
            c.frequent = dict(zip(table.value[0].split("\0"), table.value[1], strict=True))
        for batch in batches:
            n, size = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n.append(c.count(text))
                size.append(len(text.encode("utf-8")))
            over = [k > limit for k in n]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

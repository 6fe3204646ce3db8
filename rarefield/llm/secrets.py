"""Operator 8: secrets in text, by rules and by character Markov models.

Three rules give the base spans.  The method adds spans: tokens of ``LEAST``
characters and more that two first-order character models, one of random strings
and one of ordinary identifiers, tell apart by their log-likelihood ratio.  Both
are trained from labelled strings: what the rules find in the corpus and digests
(random), other tokens of the corpus and made identifiers (ordinary).  All
different tokens of all texts count, each once and whole.  Half of them, by hash,
train the models and the others set the threshold, an exact quantile: all but one in a
thousand ordinary ones stay below it.
The models' tables have one entry for each pair of characters of a fixed
alphabet, so what reaches the driver is bounded.

Only DataFrame and SQL functions are used.  Spark's regular expressions report
no positions, so a span's place is the summed length of the gaps (``split``) and
matches (``regexp_extract_all``) before it, both of which walk the text alike.
The sums go over blocks of about the square root of the number of matches, so
that no array grows with every match.

Defined cases: a null text is the empty text, without spans; positions are in
code points; rows that repeat are each reported; an empty table gives an empty
table; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefield.operators.ranking import exact_quantiles
from rarefield.scratch import Scratch

KINDS = ("assign", "access", "hex", "random")
# The rules of the base spans.  Runs that are too short are dropped
# by the length test of ``assign``; for the others a minimum length in the
# pattern finds the same runs, as a run's first character decides its length.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST = 12  # characters of a token; fewer tell too little
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST
TOKEN = r"[A-Za-z0-9+/_=-]{6,}"  # of a text, to learn from

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MADE = 1000  # strings of each kind, besides the corpus
PIECE = 256  # characters of a token that are counted at a time
LEAST_RATIO = math.log(1000)  # nats; the threshold is never lower


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label): different random strings (1) and ordinary tokens (0), all of the corpus and made ones."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), 1), F.regexp_extract_all("text", F.lit(ACCESS), 0), F.regexp_extract_all("text", F.lit(HEX), 0))
    shown = rows.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(F.explode(values).alias("text"))
    tokens = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), 0))).alias("text"))
    both = shown.where(F.length("text") >= LEAST).select("text", F.lit(1).alias("label")).union(tokens.select("text", F.lit(0)))
    # a token that a rule finds anywhere is a secret
    known = both.groupBy("text").agg(F.max("label").alias("label"))
    usual = ~F.col("text").rlike(f"{ACCESS}|{HEX}")
    scratch = Scratch(docs.sparkSession, "secrets")
    return scratch.save(made_samples(docs.sparkSession, MADE).union(known.where((F.col("label") == 1) | usual)), "samples")


def made_samples(spark: SparkSession, n: int) -> DataFrame:
    """(text, label): ``n`` random strings (1) and ``n`` identifiers (0), both drawn by hashing a counter."""
    syllables = F.array(*[F.lit(s) for s in "get set user name list item data file read write line count index value config handler test block node tree path time date size type key map table row column page text word".split()])
    pick = lambda k: F.element_at(syllables, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(syllables)) + 1).cast("int"))
    base = spark.range(n, numPartitions=1)
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = F.when(F.col("id") % 2 == 0, F.translate(F.base64(F.unhex(digest)), "=", "")).otherwise(F.substring(digest, 1, 40))
    words = [pick(k) for k in range(5)]
    number = F.pmod(F.xxhash64("id"), F.lit(2030)).cast("string")
    identifier = (
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *words, number))
        .when(F.col("id") % 4 == 1, F.concat(words[0], *[F.initcap(w) for w in words[1:]], number))
        .when(F.col("id") % 4 == 2, F.concat_ws("-", *words, number))
        .otherwise(F.concat_ws("/", *words, number))
    )
    return base.select(random.alias("text"), F.lit(1).alias("label")).union(base.select(identifier.alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, text_col: str = "text", label_col: str = "label") -> dict[str, float]:
    """Log-likelihood ratio (random against identifier) of each pair of characters, with add-one smoothing."""
    char = F.substring(F.col("piece"), F.col("i"), F.lit(2))
    # a long string in pieces that share a character, so that each of its pairs is in one
    begins = F.sequence(F.lit(1), F.length(text_col) - 1, F.lit(PIECE - 1))
    pairs = (
        samples.where(F.length(text_col) > 1)
        .select(F.col(label_col).alias("label"), text_col, F.explode(begins).alias("at"))
        .select("label", F.substring(F.col(text_col), F.col("at"), F.lit(PIECE)).alias("piece"))
        .select("label", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - 1)).alias("i"))
        .select("label", char.alias("pair"))
        .where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
        .groupBy("label", "pair")
        .count()
    )
    counts: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in pairs.collect():  # at most two entries for each pair of the alphabet
        counts[int(bool(r["label"]))][r["pair"]] = r["count"]
    k = len(ALPHABET)
    out = {}
    before = {y: {a: sum(counts[y].get(a + b, 0) for b in ALPHABET) for a in ALPHABET} for y in (0, 1)}
    for a in ALPHABET:
        for b in ALPHABET:
            p = [(counts[y].get(a + b, 0) + 0.5) / (before[y][a] + 0.5 * k) for y in (0, 1)]
            out[a + b] = math.log(p[1] / p[0])
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(token: Column, model: dict[str, float]) -> Column:
    """The log-likelihood ratio of a token over the alphabet: positive where the model of random strings fits better."""
    k = len(ALPHABET)
    table = F.expr("array(" + ",".join(f"{model[a + b]:.6f}D" for a in ALPHABET for b in ALPHABET) + ")")
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        places,
        F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("before"), (acc["sum"] + F.when(acc["before"] >= 0, F.get(table, acc["before"] * k + c)).otherwise(0.0)).alias("sum")),
    )["sum"]


def calibrated(samples: DataFrame) -> tuple[dict[str, float], float]:
    """(model, threshold): the model of one half of the samples and the ratio that one in a thousand ordinary ones of the other reach."""
    half = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)) == 0
    model = train(samples.where(half))
    other = samples.where(~half & (F.col("label") == 0) & (F.length("text") >= LEAST))
    (reached,) = exact_quantiles(other, ratio(F.col("text"), model), [0.999])
    return model, max(LEAST_RATIO, reached or 0.0)


_PLACED = "array<struct<start:int,kind:int,end:int,value:string>>"


def _place_block(block: Column, begin: Column, kind: int) -> Column:
    """The (start, kind, end, value) of one block of (gap, match), the first gap of which begins at ``begin``."""

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["g"]
        end = start + F.coalesce(F.length(r["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), r["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(r["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(_PLACED).alias("out")), step)["out"]


def _place(rows: Column, kind: int) -> Column:
    """The (start, kind, end, value) of every match of ``rows``, pairs of a gap and the match after it."""
    many = F.ceil(F.sqrt(F.size(rows))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(rows) / many).cast("int") - 1), lambda k: F.slice(rows, k * many + 1, many))

    def joined(b: Column) -> Column:
        width = lambda block: F.aggregate(block, F.lit(0), lambda n, r: n + r["g"] + F.coalesce(F.length(r["m"]), F.lit(0)))
        begins = F.aggregate(
            b,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, block: F.struct((acc["at"] + width(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(b, begins, lambda block, begin: _place_block(block, begin, kind)))

    return _let(blocks, joined)


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """An array of (start, kind, end) of the pattern's matches; ``keep`` takes a match with its value."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    kept = F.transform(F.filter(_let(rows, lambda r: _place(r, kind)), keep), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _render(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_secrets(docs: DataFrame, model: dict[str, float], threshold: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row of ``docs``."""
    text = F.col("text")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id",
        _spans(text, ASSIGN, 0, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8).alias("assign"),
        _spans(text, ACCESS, 1, lambda s: F.lit(True)).alias("access"),
        _spans(text, HEX, 2, lambda s: F.lit(True)).alias("hex"),
        _spans(text, CANDIDATE, 3, lambda s: ratio(s["value"], model) >= threshold).alias("random"),
    )
    # by start, then kind, then end
    base = F.sort_array(F.concat("assign", "access", "hex"))
    every = F.sort_array(F.concat("assign", "access", "hex", "random"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_render(base), 256).alias("base_sha256"),
        _render(every).alias("spans"),
    )

"""Operator 9: fuzzy line deduplication across documents.

Lines are normalised (outer white space off, lower case).  Equal lines are
counted first, by two hashes (128 bits), so a line that a third of all documents
share costs one row per task.  Different lines are duplicates where their edit similarity over
words is ``SIMILARITY`` or more: one less the share of words to insert, delete or
replace.  A word is what stands between spaces; in lines of more than one and a
half bytes a character, each character of a script without spaces is one.

A line has two sketches.  One, of lines of more than ``LONG`` words, is the SimHash of its words, ``SKETCH`` bits; those
more than ``FAR`` bits apart are not verified (at a fifth of the words replaced
the mean is 13 and the deviation 3).  The other is for the join: ``BLOCKS``
blocks, each the hash of ``RUN`` neighbouring words (the line's end continues at
its beginning) that begin at one of the ``BLOCKS`` words least by hash.  An edit
breaks the blocks it lies in and no others, so lines within few edits have a
whole block in common (pigeonhole).  Blocks of the SimHash's own bits would be too
short to join on at these distances: the README has the figures.

Lines meet at equal blocks.  The two lines of a bucket of two are a pair.  In a larger
bucket every member is first compared with four members, the ends of two orders that
all buckets have in common.  Where a bucket is not one group by then, all pairs of
different groups follow, in buckets of more than ``CROWD`` members those that share one
of their rarest words of the bucket, which leaves out no pair that could be linked.
Both are told apart by narrow sketches before any words are fetched:
the parities of 512 classes of words, of which an edit changes two at most, so that
they leave out nothing, and between lines of more than ``LONG`` words the SimHash.  All of it is aggregations and equi-joins, so hot blocks can be split.
Candidates are verified by the built-in edit distance over lines that are spelt
with one character a word, a hash of 2**19 values, and what passes once more by
another such hash.  Each connected group keeps its first occurrence (the least
document id, then text hash and position); all others are removed.  The graph names
lines by the first hash; lines that share it and differ in the second are only
compared for equality.

Lines too short to allow an edit, or to be one edit from a line that does (under
four words at 0.8), can only be equal.  Only DataFrame functions are used.

Defined cases: a null text has no lines and stays null; lines shorter than
``min_chars``, outer white space off, are always kept; rows with a null id keep all
their lines and are compared with nothing; rows that repeat an id are different
documents where their texts differ, and equal rows are one; an empty table gives
an empty table; texts and lines are read whole; other columns pass through.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.operators.components import connected_components, extend_components
from rarefield.scratch import Scratch

MIN_CHARS = 10
SIMILARITY = 0.8
BLOCKS, RUN = 8, 4
SKETCH, FAR = 63, 24  # bits of a SimHash, and the most that verified lines differ in
PARITIES = 8  # longs of a line's parities of classes of words
LONG = 512  # words of a line up to which the parities tell lines apart; only longer ones have a SimHash
CROWD = 4096  # members of a bucket of which all pairs of sketches are compared
SLOTS = 1 << 17  # of 64 bits, to leave out lines before they are shuffled
#: Thai, Lao, Myanmar, Khmer, kana and Han, whose words have no spaces between them.
UNSPACED = r"([฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\x{20000}-\x{3FFFF}])"
_PLACE = (1 << 24) - 1  # low bits that hold a word's place


def trimmed(line: Column) -> Column:
    # btrim walks through the whole line, even where nothing is to go
    ends = [f(c) for c in " \t\r" for f in (line.startswith, line.endswith)]
    return F.when(reduce(or_, ends), F.btrim(line, F.lit(" \t\r"))).otherwise(line)


def normalised(line: Column) -> Column:
    return F.lower(trimmed(line))


def line_hashes(norm: Column) -> list[Column]:
    """h and h2, which are a line's identity together."""
    return [F.xxhash64(norm).alias("h"), F.xxhash64(F.lit(1), norm).alias("h2")]


def words(norm: Column) -> Column:
    """The words of a line; empty ones between two spaces do not count."""
    spaced = F.when(F.octet_length(norm) * 2 > F.length(norm) * 3, F.regexp_replace(norm, UNSPACED, " $1 ")).otherwise(norm)
    return F.array_remove(F.split(spaced, " "), "")


def most_edits(n: Column, similarity: float) -> Column:
    """How many edits two lines may be apart, the longer of ``n`` words."""
    return F.floor(n * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")


def least_words(similarity: float) -> int:
    """The fewest words of a line that can be one edit from another."""
    return math.ceil(1 / (1 - similarity) - 1e-9) - 1 if similarity < 1 else 1 << 31


def _norms(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t, pos, h, h2, norm) of every line of ``min_chars`` and more; t is the text's hash."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
    lines = texts.select("doc_id", "t", F.posexplode("lines").alias("pos", "line"))
    norms = lines.where(F.length(trimmed(F.col("line"))) >= min_chars).select("doc_id", "t", "pos", normalised(F.col("line")).alias("norm"))
    return norms.select("doc_id", "t", "pos", *line_hashes(F.col("norm")), "norm")


def line_table(docs: DataFrame, min_chars: int, similarity: float) -> DataFrame:
    """(doc_id, h, h2, n, k0, k1, ...) of every line: its words' number and, where it may be edited, its blocks."""
    kept = _norms(docs, min_chars).select("doc_id", "h", "h2", words(F.col("norm")).alias("w"))
    first = F.sort_array(F.transform("w", lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i)))
    # the first words again at the end, so that every block has its length
    around = F.concat("w", F.slice("w", 1, RUN - 1)).alias("around")
    n = F.size("w")
    begun = kept.select("doc_id", "h", "h2", n.alias("n"), F.when(n >= least_words(similarity), first).alias("at"), around)
    begins = [F.get("at", F.lit(k)).bitwiseAND(F.lit(_PLACE)).cast("int") for k in range(BLOCKS)]
    # one slice a key: with its words one by one the generated method was too large to be compiled
    keys = [F.when(p.isNotNull(), F.xxhash64(F.slice("around", p + 1, F.lit(RUN)))).alias(f"k{k}") for k, p in enumerate(begins)]
    return begun.select("doc_id", "h", "h2", "n", *keys)


def distinct_lines(table: DataFrame) -> DataFrame:
    """(h, h2, first, copies, n, k0, k1, ...) of every different line: its least document and its number."""
    return table.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), *[F.min(f"k{k}").alias(f"k{k}") for k in range(BLOCKS)])


def spelt(w: Column, turn: int = 0) -> Column:
    """The line with one character of four bytes for each word, from the hash's bits from ``turn`` on."""
    code = lambda x: F.hex(F.shiftrightunsigned(F.xxhash64(x), turn).bitwiseAND(F.lit(0x023F3F3F)).bitwiseOR(F.lit(0xF1808080)))
    return F.unhex(F.array_join(F.transform(w, code), "")).cast("string")


def with_simhash(lines: DataFrame, least: int = 0) -> DataFrame:
    """``lines`` with s, the bits that more than half of the hashes of the words ``w`` have; null up to ``least`` words and beyond a million.

    Counters lie side by side in longs, 7 of 9 bits or, for lines of more than 255
    words, 3 of 21 bits, so that one addition counts several bits.
    """
    n = F.size("w")
    counted = lines.select("*", F.when((n > least) & (n <= 255), _bit_counts(F.col("w"), 9)).alias("c9"), F.when((n > max(least, 255)) & (n < 1 << 20), _bit_counts(F.col("w"), 21)).alias("c21"))
    return counted.select(*lines.columns, F.coalesce(_majority("c9", n, 9), _majority("c21", n, 21)).alias("s"))


def _lanes(width: int) -> list[int]:
    return list(range(0, SKETCH, width))


def _bit_counts(w: Column, width: int) -> Column:
    one = F.lit(sum(1 << k for k in _lanes(width)))
    return F.aggregate(
        F.transform(w, lambda x: F.xxhash64(x)),
        F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(width)]),
        lambda acc, x: F.struct(*[(acc[f"c{k}"] + F.shiftrightunsigned(x, k).bitwiseAND(one)).alias(f"c{k}") for k in range(width)]),
    )


def _majority(counts: str, n: Column, width: int) -> Column:
    # a counter above half of n reaches its highest bit once the rest up to that bit is added
    rest = (F.lit((1 << (width - 1)) - 1) - F.floor(n / 2)).cast("long")
    every = rest * F.lit(sum(1 << k for k in _lanes(width)))
    one = F.lit(sum(1 << k for k in _lanes(width)))
    high = [F.shiftleft(F.shiftrightunsigned(F.col(counts)[f"c{k}"] + every, width - 1).bitwiseAND(one), k) for k in range(width)]
    out = high[0]
    for x in high[1:]:
        out = out.bitwiseOR(x)
    return F.when(F.col(counts).isNotNull(), out)


def _hubs(members: DataFrame) -> DataFrame:
    """(key, hub, hn): four members of each bucket, the ends of two orders, with their numbers of words."""
    orders = [F.xxhash64("h", F.lit(k)) for k in (0, 1)]
    ends = [f(c, o).alias(f"{e}{k}{c}") for k, o in enumerate(orders) for e, f in (("lo", F.min_by), ("hi", F.max_by)) for c in ("h", "n")]
    found = members.groupBy("key").agg(*ends)
    each = [F.struct(F.col(f"{e}{k}h").alias("hub"), F.col(f"{e}{k}n").alias("hn")) for k in (0, 1) for e in ("lo", "hi")]
    return found.select("key", F.explode(F.array_distinct(F.array(*each))).alias("e")).select("key", "e.hub", "e.hn")


def _pairs(members: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b), a < b, of members and hubs of one bucket that their numbers of words allow."""
    fits = F.abs(F.col("n") - F.col("hn")) <= most_edits(F.greatest("n", "hn"), similarity)
    met = members.join(hubs, "key").where((F.col("h") != F.col("hub")) & fits)
    return met.select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct()


def _likely(rows: DataFrame, wanted: DataFrame, col: str = "h") -> DataFrame:
    """The ``rows`` whose ``col`` may be among ``wanted``: a table of ``SLOTS`` longs at most, whatever the input, tells most others before they are shuffled."""
    slot, bit = F.shiftright(col, 20).bitwiseAND(F.lit(SLOTS - 1)), F.shiftright(col, 50).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = wanted.groupBy(slot.alias("slot")).agg(F.bit_or(one).alias("bits"))
    return rows.join(F.broadcast(bits), slot == F.col("slot")).where(F.col("bits").bitwiseAND(one) != 0).select(*rows.columns)


def _candidates(distinct: DataFrame, scratch: Scratch, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of lines that meet at a block, and (key, h, n) of the buckets of which not all pairs are among these."""
    # a line that repeats its words has equal blocks, and is one member of their bucket
    blocks = F.array_distinct(F.array(*[f"k{k}" for k in range(BLOCKS)]))
    keyed = distinct.select("h", "n", F.explode(blocks).alias("key")).where("key is not null")
    ends = [F.min("h").alias("a"), F.max("h").alias("b"), F.min("n").alias("low"), F.max("n").alias("high")]
    buckets = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("members"), *ends).where("a < b"), "buckets")
    two = buckets.where("members = 2").where(F.col("high") - F.col("low") <= most_edits(F.col("high"), similarity)).select("a", "b")
    crowded = buckets.where("members > 2").select("key")
    members = scratch.save(_likely(keyed, crowded, "key").join(crowded, "key", "left_semi"), "members")
    pairs = scratch.save(two.union(_pairs(members, _hubs(members), similarity)).distinct(), "pairs")
    scratch.drop(buckets)
    return pairs, members


def _texts(docs: DataFrame, wanted: DataFrame, scratch: Scratch, min_chars: int) -> DataFrame:
    """(h, s, line0, line32) of the lines ``wanted`` (h); lines that share h with others have none, and so no link."""
    found = _likely(_norms(docs, min_chars).select("h", "h2", "norm"), wanted).join(wanted, "h")
    one = found.groupBy("h").agg(F.min("h2").alias("low"), F.max("h2").alias("high"), F.first("norm").alias("norm")).where("low = high")
    spellings = [spelt(F.col("w"), turn).alias(f"line{turn}") for turn in (0, 32)]
    return scratch.save(with_simhash(one.select("h", words(F.col("norm")).alias("w")), LONG).select("h", "s", *spellings), "texts")


def _sketches(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, m, s, p0, p1, ...) of ``texts``: their words' number, SimHash and parities.

    A class of words has a bit, set where the line holds an odd number of its words.
    """
    chars = texts.select("h", F.length("line0").alias("m"), "s", F.explode(F.split("line0", "")).alias("c"))
    coded = chars.select("h", "m", "s", F.xxhash64("c").alias("x"))
    lane, bit = F.pmod("x", F.lit(PARITIES)), F.shiftright("x", 32).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    odd = [F.bit_xor(F.when(lane == k, one).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITIES)]
    return scratch.save(coded.groupBy("h").agg(F.first("m").alias("m"), F.first("s").alias("s"), *odd), "sketches")


def _renamed(sketches: DataFrame, start: str) -> list[Column]:
    """The sketches' columns but h, their names begun with ``start``."""
    return [F.col(c).alias(f"{start}{c}") for c in sketches.columns if c != "h"]


def _near(one: str, other: str, similarity: float) -> Column:
    """Whether two sketches, in columns whose names begin with ``one`` and ``other``, are close enough to verify their lines.

    An edit that changes the length changes one parity, any other two at most.
    """
    m, n = F.col(f"{one}m"), F.col(f"{other}m")
    bits = lambda c: F.bit_count(F.col(f"{one}{c}").bitwiseXOR(F.col(f"{other}{c}")))
    most = most_edits(F.greatest(m, n), similarity)
    odd = sum((bits(f"p{k}") for k in range(1, PARITIES)), bits("p0"))
    return (F.abs(m - n) <= most) & (odd <= 2 * most - F.abs(m - n)) & F.coalesce(bits("s") <= FAR, F.lit(True))


def _links(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """The ``pairs`` of lines that are duplicates."""
    # first the sketches, then the edit distances
    sa, sb = (sketches.select(F.col("h").alias(x), *_renamed(sketches, x)) for x in "ab")
    close = pairs.join(sa, "a").join(sb, "b").where(_near("a", "b", similarity)).select("a", "b")
    ta, tb = (texts.select(F.col("h").alias(x), F.col("line0").alias(f"t{x}"), F.col("line32").alias(f"u{x}")) for x in "ab")
    # in a lambda, as its many thresholds would make a generated method too large to be compiled
    most = lambda p: most_edits(F.greatest(F.length(p["ta"]), F.length(p["tb"])), similarity)
    within = F.exists(F.array(F.struct("ta", "tb", "ua", "ub")), lambda p: _within([(p["ta"], p["tb"]), (p["ua"], p["ub"])], most(p)))
    return scratch.save(close.join(ta, "a").join(tb, "b").where(within).select("a", "b"), "links")


def _rest(members: DataFrame, texts: DataFrame, sketches: DataFrame, comps: DataFrame, tried: DataFrame, scratch: Scratch, similarity: float) -> DataFrame | None:
    """Distinct (a, b), a < b, of all members of one bucket that may be linked, are not in one component and were not ``tried``; None where every bucket is one component."""
    own = comps.select(F.col("node").alias("h"), "component")
    known = scratch.save(members.join(own, "h", "left").select("key", "h", F.coalesce("component", "h").alias("comp")), "known")
    groups = known.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("held"))
    open_ = groups.where("c0 < c1").select("key", (F.col("held") > CROWD).alias("crowded"))
    held = known.join(open_, "key").groupBy("h").agg(F.min("comp").alias("comp"), F.collect_list(F.struct("crowded", "key")).alias("at"))
    each = held.join(sketches, "h").select("*", F.explode("at").alias("e"))
    under = F.filter("at", lambda x: (x["crowded"] == F.col("e.crowded")) & (x["key"] < F.col("e.key")))["key"].alias("under_key")
    apart = scratch.save(each.select("e.crowded", "e.key", under, "comp", *sketches.columns), "apart")
    scratch.drop(known)
    if apart.isEmpty():
        return None
    found = _met(apart.where("not crowded").drop("crowded"), ["key"], similarity)
    many = apart.where("crowded").drop("crowded")
    if not many.isEmpty():
        found = found.union(_met(_rarest(many, texts, scratch, similarity), ["key", "c"], similarity)).distinct()
    pairs = scratch.save(found.join(tried, ["a", "b"], "left_anti"), "rest")
    scratch.drop(apart)
    return pairs


def _met(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Distinct (a, b), a < b, of rows of equal ``keys`` and different components that may be linked.

    Each key k has a column ``under_k``, the lesser keys that the line has beside it.  Lines
    that share several meet at the least only, so a pair is made once however many
    buckets near copies have in common.
    Lines that may be linked lie in one band of lengths or in neighbouring ones, so the
    shorter is met with the longer in its own band and the next.
    """
    width = max(1.001 * -math.log(max(similarity, 1e-9)), 1e-9)  # a little more than the lengths' ratio allows, for rounding
    band = F.floor(F.log(F.greatest("m", F.lit(1)).cast("double")) / width)
    names = [c for c in rows.columns if c not in keys]
    one = rows.select(*keys, band.alias("band"), *[F.col(c).alias(f"a_{c}") for c in names])
    other = rows.select(*keys, F.explode(F.array(band, band - 1)).alias("band"), *[F.col(c).alias(f"b_{c}") for c in names])
    longer = (F.col("a_m") < F.col("b_m")) | ((F.col("a_m") == F.col("b_m")) & (F.col("a_h") < F.col("b_h")))
    once = reduce(and_, [~F.arrays_overlap(f"a_under_{k}", f"b_under_{k}") for k in keys])
    # sorted, a bucket's rows lie together
    met = one.join(other.hint("merge"), [*keys, "band"]).where((F.col("a_comp") != F.col("b_comp")) & longer & _near("a_", "b_", similarity) & once)
    return met.select(F.least("a_h", "b_h").alias("a"), F.greatest("a_h", "b_h").alias("b")).distinct()


def _rarest(rows: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """``rows`` (key, h, m, comp and more) once for each of their words ``c`` at which they can meet those of another component.

    Of two lines within the allowed edits, either has no more words than its own
    length allows that the other lacks.  So whatever order the words of a bucket are
    put in, the first word that both lines hold is among the first of each, one more
    than these.  Lines meet at such words, the rarest of the bucket first; words that
    all its lines share come last and bring nobody together.
    """
    chars = texts.select("h", F.array_distinct(F.split("line0", "")).alias("c"))
    spread = rows.select("key", "h", "m", "comp").join(chars, "h").select("key", "h", "m", "comp", F.explode("c").alias("c"))
    spread = scratch.save(spread.withColumn("c", F.xxhash64("c")), "spread")
    counts = spread.groupBy("key", "c").agg(F.count("*").alias("held"), (F.min("comp") < F.max("comp")).alias("joins"))
    ordered = F.sort_array(F.collect_list(F.struct("held", "c", "joins")))
    first = spread.join(counts, ["key", "c"]).groupBy("key", "h", "m").agg(ordered.alias("w"))
    heads = F.filter(F.slice("w", F.lit(1), most_edits(F.col("m"), similarity) + 1), lambda x: x["joins"])["c"]
    each = first.select("key", "h", heads.alias("cs")).select("key", "h", "cs", F.explode("cs").alias("c"))
    under = F.filter("cs", lambda x: x < F.col("c")).alias("under_c")
    found = scratch.save(each.select("key", "h", "c", under).join(rows, ["key", "h"]), "heads")
    scratch.drop(spread)
    return found


def _components(docs: DataFrame, distinct: DataFrame, scratch: Scratch, min_chars: int, similarity: float) -> DataFrame:
    """(node, component) of the lines that a duplicate is linked to: links with a bucket's hubs first, then all others that could join components."""
    pairs, members = _candidates(distinct, scratch, similarity)
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("h")).union(members.select("h")).distinct(), "wanted")
    texts = _texts(docs, wanted, scratch, min_chars)
    sketches = _sketches(texts, scratch)
    comps = scratch.save(connected_components(_links(pairs, texts, sketches, scratch, similarity), scratch), "components")
    rest = _rest(members, texts, sketches, comps, pairs, scratch, similarity)
    if rest is not None:
        comps = extend_components(comps, _links(rest, texts, sketches, scratch, similarity), scratch)
    scratch.drop(pairs, members, wanted, texts, sketches)
    return comps


def duplicate_lines(docs: DataFrame, scratch: Scratch, min_chars: int, similarity: float) -> DataFrame:
    """(doc_id, dropped): for each document that loses lines, (t, pos) of these; ``docs`` has doc_id and text."""
    distinct = scratch.save(distinct_lines(line_table(docs, min_chars, similarity)), "distinct")
    comps = _components(docs, distinct, scratch, min_chars, similarity)

    # a line is in a group, or alone and then repeated only where it has copies
    nodes = scratch.save(comps.select(F.col("node").alias("h"), F.col("component").alias("g")), "nodes")
    grouped = _likely(distinct.select("h", "h2", "first"), nodes).join(nodes, "h")
    heads = grouped.groupBy("g").agg(F.min("first").alias("keep"))
    alone = distinct.where("copies > 1").join(nodes, "h", "left_anti")
    lone = alone.select("h", "h2", F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("first").alias("keep"))
    repeated = scratch.save(grouped.join(heads, "g").select("h", "h2", "g", F.lit(0).cast("long").alias("g2"), "keep").union(lone), "repeated")
    at = _likely(_norms(docs, min_chars).select("doc_id", "t", "pos", "h", "h2"), repeated).join(repeated, ["h", "h2"])
    first = F.col("doc_id") == F.col("keep")
    other = F.collect_set(F.when(~first, F.struct("t", "pos"))).alias("other")
    mine = F.sort_array(F.collect_set(F.when(first, F.struct("g", "g2", "t", "pos")))).alias("mine")
    by_doc = at.groupBy("doc_id").agg(other, mine)
    same = lambda x, y: (x["g"] == y["g"]) & (x["g2"] == y["g2"])
    later = F.filter("mine", lambda x, i: (i > 0) & same(x, F.get("mine", i - 1)))
    dropped = F.concat("other", F.transform(later, lambda x: F.struct(x["t"].alias("t"), x["pos"].alias("pos"))))
    return by_doc.select("doc_id", dropped.alias("dropped")).where(F.size("dropped") > 0)


def _within(spellings: list[tuple[Column, Column]], most: Column) -> Column:
    """Whether the edit distance of two lines is at most ``most`` in each of their spellings.

    ``levenshtein`` takes a literal threshold, which bounds its work, and gives -1
    beyond it; a row of bounds, each twice the one before, makes classes of lengths.
    """
    out = reduce(and_, [F.levenshtein(a, b) <= most for a, b in spellings])
    for k in range(16, -1, -1):
        distances = [F.pmod(F.levenshtein(a, b, 1 << k), F.lit(1 << 30)) for a, b in spellings]
        out = F.when(most <= 1 << k, reduce(and_, [d <= most for d in distances])).otherwise(out)
    return out


def _places(dropped: Column, t: Column) -> Column:
    """The sorted places among ``dropped`` of the row whose text has the hash ``t``."""
    return F.sort_array(F.transform(F.filter(dropped, lambda x: x["t"] == t), lambda x: x["pos"]))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its duplicate lines removed from ``text_col``, and the positions of these as ``dropped_lines`` (null where none)."""
    scratch = Scratch(docs.sparkSession, "lines")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = scratch.save(duplicate_lines(own, scratch, min_chars, similarity), "lost").select(F.col("doc_id").alias("__lost_id"), F.col("dropped").alias("__dropped"))
    names = [c for c in docs.columns if c != "dropped_lines"]
    joined = docs.select(*names).join(lost, F.col(id_col).cast("long") == F.col("__lost_id"), "left")
    places = _places(F.col("__dropped"), F.xxhash64(text_col))
    placed = joined.withColumn("__places", F.when(F.size(places) > 0, places))
    lines = F.split(text_col, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__places")
    text = F.when(F.col("__places").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n"))
    return placed.withColumn(text_col, text).select(*names, F.col("__places").alias("dropped_lines"))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped_lines) of every row of ``docs``; the texts stay where they are."""
    scratch = Scratch(docs.sparkSession, "lines")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = scratch.save(duplicate_lines(own, scratch, min_chars, similarity), "lost")
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    joined = own.select("doc_id", F.xxhash64("text").alias("t"), lines.alias("n_lines")).join(lost, "doc_id", "left")
    places = F.coalesce(_places(F.col("dropped"), F.col("t")), F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", places.alias("places")).select("doc_id", "n_lines", F.size("places").cast("long").alias("n_dropped"), F.array_join(F.col("places").cast("array<string>"), ",").alias("dropped_lines"))

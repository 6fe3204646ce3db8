"""Operator 11: repair of conversation structure by A* on the edit lattice.

A conversation is its rows in order (turn, nulls first, then role and text).  Each
row has at most one fault, the first that holds: blank (nothing but white space),
duplicate (role and text seen in an earlier row), truncated (its last character
that is no white space does not end a sentence).  The repair is the cheapest list
of edits that makes the initials of the roles an optional ``s`` and then ``ua`` any
number of times, at least once if there is an ``s``, or nothing:

    K keep 0, R give the role user or assistant 1, D delete 2, I insert an empty turn 5

Blank and duplicate rows must be deleted; a truncated row that is not deleted
costs 5 more.  Of equally cheap repairs the one whose edits read least in ASCII is
taken.

A node of the lattice is (rows used, state), the state being what the pattern
expects.  The search pops nodes by (cost + heuristic, edits so far).  The heuristic
sums over the rows left what each must cost at least: 2 for a mandatory deletion,
and 2 for a truncated row (deleting is cheaper than the charge).  It never falls by
more than an edge costs, and two equally dear edit lists to one node are never
prefixes of one another, so the first visit of a node is its cheapest and least.

A conversation of up to ``LONG_ROWS`` rows and ``LONG_CHARS`` characters is searched
in one piece.  A longer one is never gathered: its equal rows are counted, the rest
is dealt out by ranges of its order and cut into segments, each segment is searched
from every state it can be entered in, and the segments' small tables of (cost,
edits) are joined in order, which gives the same answer.  Only the digest of a
long conversation reads its text in one task, a segment at a time, since SHA-256 is
sequential.

Defined cases: nulls in role or text are one space; rows of a null conversation id
are one conversation; equal rows are rows; rows that tie in turn follow role and
text; a conversation none of whose rows are left reports zeros, no edits and the
digest of the empty string; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.scratch import Scratch

LONG_ROWS, LONG_CHARS = 1024, 8 << 20
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3  # faults; 0 is none
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last role was
GOALS = (START, ASSISTANT)
DELETE, RENAME, INSERT, CUT_OFF = 2, 1, 5, 5

_NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_LEGAL = ("su", "ua", "au")


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with faults that a checksum of ``conv_id:turn`` chooses: of 20 slots 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slot = F.crc32(F.concat(part(id_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    role, text = part(role_col), part(text_col)
    shown = rows.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(slot == 4, "user").otherwise(role).alias("role"),
        F.when(slot == 1, "").when(slot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(slot == 0, 0).when(slot == 3, 2).otherwise(1).alias("times"),
    )
    return shown.where("times > 0").withColumn("k", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("conv_id", "turn", "role", "text")


def fault_of(text: str, seen: bool) -> int:
    told = text.rstrip(WHITE)
    if not told:
        return BLANK
    return DUPLICATE if seen else 0 if told[-1] in ".!?" else TRUNCATED


def faults(rows: Iterable[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text) row."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        out.append(fault_of(row[1], row in seen))
        seen.add(row)
    return out


def cheapest(initials: list[str], found: list[int], start: int = START, exits: tuple[int, ...] = GOALS, every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, edits) by exit state: of the best exit, or of ``every`` one that can be reached."""
    n = len(found)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if found[i] else 0)
    queue: list[tuple[int, str, int, int]] = [(least[0], "", 0, start)]
    done: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str]] = {}
    while queue:
        f, edits, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = f - least[i]
        if i == n and state in exits:
            out[state] = (cost, edits)
            if not every or len(out) == len(exits):
                break
        wanted = ASSISTANT if state == USER else USER
        if (i, wanted) not in done:
            heapq.heappush(queue, (f + INSERT, edits + "I", i, wanted))
        if i < n:
            rest = cost + least[i + 1]
            heapq.heappush(queue, (rest + DELETE, edits + "D", i + 1, state))
            if found[i] in (0, TRUNCATED):
                rest += CUT_OFF if found[i] else 0
                kept = _NEXT.get((initials[i], state))
                if kept is not None:
                    heapq.heappush(queue, (rest, edits + "K", i + 1, kept))
                heapq.heappush(queue, (rest + RENAME, edits + "R", i + 1, wanted))
    return out


def edited(rows: list[tuple[str, str]], edits: str, state: int = START) -> list[tuple[str, str, str]]:
    """(role, text, edit) of the turns that the edits leave or make."""
    out, i = [], 0
    for e in edits:
        role = "assistant" if state == USER else "user"
        if e == "I":
            out.append((role, "", e))
        elif e == "R":
            out.append((role, rows[i][1], e))
        elif e == "K":
            role = rows[i][0]
            out.append((role, rows[i][1], e))
        if e != "D":
            state = _NEXT[role[:1], state]
        i += e != "I"
    return out


@dataclass
class Tally:
    """What is counted of a conversation's rows, in order."""

    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def join(self, other: Tally) -> None:
        """Adds what follows."""
        if other.last is None:
            return
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        self.illegal += other.illegal + (self.last is not None and self.last + other.first not in _LEGAL)
        self.first, self.last = other.first if self.last is None else self.first, other.last
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def report(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal]


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LONGS = ", ".join(f"{c} long" for c in _REPORT)
_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _told(turns: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text, _ in turns)


def _short(rows: DataFrame) -> DataFrame:
    """The report and the repaired turns of conversations that fit a task."""
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longs, audits, digests, repaired = [], [], [], []
            for told in batch.column(1):
                own = [(r["turn"], r["role"], r["text"]) for r in told.as_py()]
                said = [(role, text) for _, role, text in own]
                found = faults(said)
                tally = Tally()
                for (turn, role, _), fault in zip(own, found, strict=True):
                    tally.add(turn, role[:1], fault)
                ((cost, edits),) = cheapest([role[:1] for role, _ in said], found).values()
                turns = edited(said, edits)
                longs.append([*tally.report(), cost])
                audits.append(edits)
                digests.append(hashlib.sha256(_told(turns).encode()).hexdigest())
                repaired.append([{"role": a, "text": b, "edit": e} for a, b, e in turns])
            columns = [pa.array([x[k] for x in longs], pa.int64()) for k in range(len(_REPORT))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(audits, pa.string()), pa.array(digests, pa.string()), pa.array(repaired, pa.list_(_TURN))], ["conv_id", *_REPORT, "audit", "repaired_sha256", "repaired"])

    return grouped.mapInArrow(run, f"conv_id long, {_LONGS}, audit string, repaired_sha256 string, repaired array<struct<role:string,text:string,edit:string>>")


_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())])
_WAY = pa.struct([("start", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_TALLY = pa.struct([("counts", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])
_SEGMENT = "conv_id long, seg long, rows array<struct<role:string,text:string,fault:int>>, ways array<struct<start:int,exit:int,cost:long,edits:string>>, tally struct<counts:array<long>,illegal:long,first:string,last:string,low:long,high:long,turns:long>"


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _segments(rows: DataFrame, scratch: Scratch, long_rows: int, long_chars: int) -> DataFrame:
    """The segments of long conversations, each searched from every state."""
    counted = scratch.save(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("digest", F.sha2("text", 256)), "counted")
    began = counted.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))).alias("m"))
    flagged = counted.join(began, _same(F.col("conv_id"), F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    order = ["conv_id", "turn", "role", "text"]
    dealt = flagged.select(*order, "times", _same(F.col("turn"), F.col("m.turn")).alias("new")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        conv: int | None = None
        held: list[tuple[int | None, str, str | None, int]] = []
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, chars, made
            if held:
                initials, found = [h[1][:1] for h in held], [h[3] for h in held]
                tally = Tally()
                for (turn, _, _, fault), initial in zip(held, initials, strict=True):
                    tally.add(turn, initial, fault)
                ways = [{"start": s, "exit": t, "cost": c, "edits": e} for s in range(4) for t, (c, e) in cheapest(initials, found, s, (0, 1, 2, 3), True).items()]
                told = [{"role": role, "text": text, "fault": fault} for _, role, text, fault in held]
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part + made], pa.int64()), pa.array([told], pa.list_(_ROW)), pa.array([ways], pa.list_(_WAY)), pa.array([vars(tally)], _TALLY)], ["conv_id", "seg", "rows", "ways", "tally"])
                made += 1
                held, chars = [], 0

        for batch in batches:
            for c, turn, role, text, times, new in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != conv:
                    yield from flush()
                    conv = c
                for k in range(times):
                    fault = fault_of(text, k > 0 or not new)
                    gone = fault in (BLANK, DUPLICATE)
                    held.append((turn, role, None if gone else text, fault))
                    chars += 0 if gone else len(text)
                    if len(held) >= long_rows or chars >= long_chars:
                        yield from flush()
        yield from flush()

    return scratch.save(dealt.mapInArrow(run, _SEGMENT), "segments")


class _Path:
    """A list of edits up to a segment's end that shares its beginning with others."""

    __slots__ = ("before", "cost", "edits", "state")

    def __init__(self, before: _Path | None, state: int, cost: int, edits: str):
        self.before, self.state, self.cost, self.edits = before, state, cost, edits

    def pieces(self, until: _Path | None = None) -> list[str]:
        out, p = [], self
        while p is not until:
            out.append(p.edits)
            p = p.before
        return out[::-1]

    def __lt__(self, other: _Path) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self, other
        while a is not b:  # both are as many segments long
            a, b = a.before, b.before
        return "".join(self.pieces(a)) < "".join(other.pieces(a))


def _joined(segments: DataFrame) -> DataFrame:
    """The report of long conversations, and for each segment its state on entry and its edits."""
    grouped = segments.select("conv_id", F.struct("seg", "ways", "tally").alias("s")).groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("segments"))
    plan = pa.struct([("seg", pa.int64()), ("state", pa.int32()), ("edits", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segs = batch.column(1)[k].as_py()
                tally = Tally()
                paths = {START: _Path(None, START, 0, "")}
                for s in segs:
                    tally.join(Tally(**s["tally"]))
                    reached: dict[int, _Path] = {}
                    for w in s["ways"]:
                        if w["start"] in paths:
                            p = _Path(paths[w["start"]], w["exit"], paths[w["start"]].cost + w["cost"], w["edits"])
                            if w["exit"] not in reached or p < reached[w["exit"]]:
                                reached[w["exit"]] = p
                    paths = reached
                best = min(paths[g] for g in GOALS if g in paths)
                steps, p = [], best
                while p.before is not None:
                    steps.append((p.before.state, p.edits))
                    p = p.before
                plans = [{"seg": s["seg"], "state": state, "edits": edits} for s, (state, edits) in zip(segs, reversed(steps), strict=True)]
                longs = [pa.array([v], pa.int64()) for v in (*tally.report(), best.cost)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *longs, pa.array(["".join(e for _, e in reversed(steps))]), pa.array([plans], pa.list_(plan))], ["conv_id", *_REPORT, "audit", "plans"])

    return grouped.mapInArrow(run, f"conv_id long, {_LONGS}, audit string, plans array<struct<seg:long,state:int,edits:string>>")


def _planned(segments: DataFrame, joined: DataFrame) -> DataFrame:
    """(conv_id, seg, repaired): the repaired turns of each segment."""
    plans = joined.select(F.explode("plans").alias("p")).select(F.col("p.seg").alias("s"), "p.state", "p.edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, state, edits in zip(*(batch.column(k) for k in (2, 3, 4)), strict=True):
                turns = edited([(r["role"], r["text"]) for r in rows.as_py()], edits.as_py(), state.as_py())
                out.append([{"role": a, "text": b, "edit": e} for a, b, e in turns])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(_TURN))], ["conv_id", "seg", "repaired"])

    wanted = segments.join(plans, segments["seg"] == plans["s"]).select("conv_id", "seg", "rows", "state", "edits")
    return wanted.mapInArrow(run, "conv_id long, seg long, repaired array<struct<role:string,text:string,edit:string>>")


def _digests(planned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256), a segment of a conversation at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, begun, any_row = None, hashlib.sha256(), False, False
        names = ["conv_id", "repaired_sha256"]
        for batch in batches:
            for c, turns in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if any_row and c != conv:
                    yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names)
                    sha, begun = hashlib.sha256(), False
                conv, any_row = c, True
                for t in turns.as_py():
                    sha.update((("\n" if begun else "") + f"{t['role']}:{t['text']}").encode())
                    begun = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names)

    return planned.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(run, "conv_id long, repaired_sha256 string")


@dataclass
class Repaired:
    """``report``: a row for each conversation; ``turns``: (conv_id, seg, place, role, text, edit), ordered by seg and place."""

    report: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> Repaired:
    """Finds and mends the faults of conversations; ``rows`` has conv_id, turn, role and text."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "repair")
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    sizes = own.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = scratch.save(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select("c"), "large")
    columns = ["conv_id", *_REPORT, "audit", "repaired_sha256"]
    turn = lambda frame, seg: frame.select("conv_id", seg, F.posexplode("repaired").alias("place", "t")).select("conv_id", "seg", "place", "t.*")
    if large.isEmpty():
        short = _short(own)
        return Repaired(short.select(*columns), turn(short, F.lit(0).cast("long").alias("seg")))
    split = _same(F.col("conv_id"), F.col("c"))
    short = _short(own.join(large, split, "left_anti"))
    segments = _segments(own.join(large, split, "left_semi"), scratch, long_rows, long_chars)
    joined = scratch.save(_joined(segments), "joined")
    planned = _planned(segments, joined)
    digests = _digests(planned).withColumnRenamed("conv_id", "c")
    # a conversation whose edits leave nothing still has its segments, so every one has a digest
    report = joined.join(digests, split).select(*columns)
    return Repaired(short.select(*columns).unionByName(report), turn(short, F.lit(0).cast("long").alias("seg")).unionByName(turn(planned, "seg")))


def with_empty(report: DataFrame, ids: DataFrame) -> DataFrame:
    """``report`` with a row of zeros for each of ``ids`` (one column) that has no rows left."""
    every = ids.select(F.col(ids.columns[0]).cast("long").alias("c")).distinct()
    joined = every.join(report, _same(F.col("c"), F.col("conv_id")), "left")
    longs = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in _REPORT]
    return joined.select(F.col("c").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))

"""Conversation repair against a plain dynamic programme over whole strings, whole and in segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("rarefield.llm")
from rarefield.llm import repair  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, audit string, seg int"


def best_repair(rows):
    """(cost, edits) by trying every edit at every row, shortest lists of states first."""
    best = {(0, 0): (0, "")}

    def settle(i):
        for _ in range(3):
            for s in range(4):
                if (i, s) in best:
                    to = 3 if s == 2 else 2
                    c = (best[i, s][0] + 5, best[i, s][1] + "I")
                    best[i, to] = min(best.get((i, to), c), c)

    settle(0)
    for i, (initial, fault) in enumerate(rows):
        for s in range(4):
            if (i, s) not in best:
                continue
            cost, edits = best[i, s]
            steps = [(s, 2, "D")]
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                to = 3 if s == 2 else 2
                steps.append((to, 1 + more, "R"))
                if (initial, s) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    steps.append(({"s": 1, "u": 2, "a": 3}[initial], more, "K"))
            for to, c, e in steps:
                new = (cost + c, edits + e)
                best[i + 1, to] = min(best.get((i + 1, to), new), new)
        settle(i + 1)
    return min(best[k] for k in ((len(rows), 0), (len(rows), 3)) if k in best)


def by_hand(table):
    """What the contract asks of damaged rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        own = sorted(((t is not None, t or 0), r or " " if r is None else r, x if x is not None else " ") for c, t, r, x in table if c == conv)
        seen, rows = set(), []
        for _, role, text in own:
            told = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not told else 2 if (role, text) in seen else 3 if told[-1] not in ".!?" else 0
            seen.add((role, text))
            rows.append((role[:1], fault))
        turns = [t for (known, t), _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = best_repair(rows)
        lines, i, last = [], 0, ""
        for e in audit:
            role = "assistant" if last[:1] == "u" else "user"
            if e in "KR":
                lines.append((own[i][1] if e == "K" else role, own[i][2]))
            elif e == "I":
                lines.append((role, ""))
            i += e != "I"
            last = lines[-1][0] if lines else ""
        told = "\n".join(f"{a}:{b}" for a, b in lines)
        n = lambda k: sum(f == k for _, f in rows)  # noqa: E731, B023
        out[conv] = (gaps, n(1), n(2), n(3), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest()), lines
    return out


def answers(report):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in report.collect()}


def conversations(seed, n, most):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for t in range(rnd.randint(1, most)):
            turn = rnd.choice([t, t, t, t + rnd.randint(0, 3), None])
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "Why?  ", "open", "cut off ", "", " \t", "\xa0", None, f"turn {t}."])
            rows += [(conv, turn, role, text)] * rnd.choice([1, 1, 1, 1, 2, 3])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("long_rows", [1024, 3])
def test_repair_against_plain_python(spark, long_rows):
    rows = conversations(4, 60, 9)
    want = by_hand(rows)
    done = repair.repair(frame(spark, rows), long_rows=long_rows)
    assert answers(done.report) == {c: w for c, (w, _) in want.items()}
    turns = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r["seg"], r["place"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: lines for c, (_, lines) in want.items() if lines}


def test_one_conversation_of_a_third_of_all_rows(spark):
    """Several segments, a row that repeats 900 times, a tie of many rows in one turn."""
    rnd = random.Random(8)
    rows = [(7, k, rnd.choice(["user", "assistant", "user", "tool"]), rnd.choice([f"said {k}.", f"said {k % 50}", "Yes."])) for k in range(1500)]
    rows += [(7, 40, "user", "Same.")] * 900 + [(7, 41, "assistant", f"tie {k}.") for k in range(300)]
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", "Yes.") for k in range(100, 400) for t in range(4)]
    got = answers(repair.repair(frame(spark, rows), long_rows=200).report)
    assert got == {c: w for c, (w, _) in by_hand(rows).items()}


def test_search_is_exact_for_every_short_list_of_rows():
    kinds = [("u", 0), ("a", 0), ("s", 0), ("x", 3), ("a", 3), ("u", 1)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            ((got, edits),) = repair.cheapest([r[0] for r in rows], [r[1] for r in rows]).values()
            assert (got, edits) == best_repair(rows), rows


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in [None, *range(12)] for t in [None, *range(8)]] + [(1, 3, None, None)]
    want = []
    for c, t, role, text in rows:
        slot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if slot:
            text = "" if slot == 1 else re.sub("[.!?]", "", text) if slot == 2 else text
            want += [(c, t, "user" if slot == 4 else role, text)] * (2 if slot == 3 else 1)
    got = [tuple(r) for r in repair.damage(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) != len(rows)


def test_conversations_without_rows_and_empty_tables(spark):
    rows = frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, None, None)])
    ids = spark.createDataFrame([(1,), (2,), (None,)], "conv_id long")
    got = answers(repair.with_empty(repair.repair(rows).report, ids))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[2] == got[None] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[1][:7] == (0, 1, 0, 0, 1, 2, "KKD")
    assert repair.repair(frame(spark, [])).report.count() == 0


def test_a_very_long_text_makes_a_segment_of_its_own(spark):
    rows = [(1, 0, "user", "x " * 200_000 + "."), (1, 1, "assistant", "y " * 200_000), (1, 2, "user", "z.")]
    got = answers(repair.repair(frame(spark, rows), long_chars=100_000).report)
    assert got == {c: w for c, (w, _) in by_hand(rows).items()}

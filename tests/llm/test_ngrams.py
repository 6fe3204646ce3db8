"""Trigram scores against plain Python, for any size of batch and shard, and the trie's levels by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rarefield.llm")
from pyspark.sql import functions as F  # noqa: E402

from rarefield.llm import ngrams, trie  # noqa: E402

SCHEMA = "doc_id long, text string, train boolean, score string, data string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def rounded(p):
    return 10 ** -(min(254, round(-24 * math.log10(p))) / 24)


def by_hand(rows):
    """(n_tokens, n_known, base, score) of each row; n-grams are counted in dictionaries."""
    one, two, three = Counter(), Counter(), Counter()
    for _, text, train in rows:
        if train:
            t = tokens(text)
            seq = ["<", "<", *t]
            one.update(t)
            one["<"] += 1
            for k in range(2, len(seq)):
                two[seq[k - 1], seq[k]] += 1
                three[tuple(seq[k - 2 : k + 1])] += 1
    n, v = sum(c for w, c in one.items() if w != "<"), len([w for w in one if w != "<"])
    context = Counter()
    for (a, b, _), c in three.items():
        context[a, b] += c
    out = []
    for i, text, train in rows:
        t = tokens(text)
        seq, base, score = ["<", "<", *t], 0.0, 0.0
        for k in range(2, len(seq)):
            a, b, w = seq[k - 2 : k + 1]
            p1 = (one[w] + 0.1) / (n + 0.1 * (v + 1))
            p2 = ngrams.PAIR / (one[b] + ngrams.PAIR) * p1
            if two[b, w]:
                p2 += rounded(two[b, w] / (one[b] + ngrams.PAIR))
            p3 = p2 * (rounded(ngrams.TRIPLE / (context[a, b] + ngrams.TRIPLE)) if context[a, b] else 1)
            if three[a, b, w]:
                p3 += rounded(three[a, b, w] / (context[a, b] + ngrams.TRIPLE))
            base += math.log10(p1)
            score += math.log10(p3)
        out.append((i, bool(train), len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def corpus(seed=5, n=70):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "x", "y", "\xa0", "é", "</s>", "<s>", *[f"w{k}" for k in range(40)]]
    weights = [30, 10, 10, *[1] * (len(words) - 3)]
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(rnd.choices(words, weights, k=rnd.randint(0, 60))), i % 4 != 0) for i in range(n)]
    rows += [(n, None, True), (n + 1, "", False), (n + 2, " \n", True), (3, rows[3][1], True), (3, "other text of 3", False), (None, "the of a", False)]
    return rows + [(n + 3, "long " * 700 + "the of " * 200, True)]


def answers(spark, rows, **how):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = ngrams.score_corpus(table, F.col("train"), **how)
    return sorted(((r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"batch_tokens": 150, "shard_bytes": 1000, "hot": 60}])
def test_scores_against_plain_python(spark, how):
    rows = corpus()
    want = by_hand(rows)
    got = answers(spark, rows, **how)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-5)


def test_no_training_rows_and_empty_tables(spark):
    got = answers(spark, [(1, "a b", False), (2, None, None)])
    assert got == [(1, False, 3, 0, 0, 0.0, 0.0), (2, False, 1, 0, 0, 0.0, 0.0)]
    assert answers(spark, []) == []


def test_the_model_prefers_texts_like_its_own(spark):
    """Over held-out text from a chain of words the trigrams give more than the words' shares, and shuffled text less."""
    rnd = random.Random(2)
    follow = {w: rnd.sample(range(200), 3) for w in range(200)}

    def chain(n):
        w, out = rnd.randrange(200), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rnd.choice(follow[w])
        return out

    rows = [(i, " ".join(chain(80)), i >= 20) for i in range(300)]
    for i in range(20):
        mixed = rows[i][1].split()
        rnd.shuffle(mixed)
        rows.append((1000 + i, " ".join(mixed), False))
    got = {g[0]: g for g in answers(spark, rows)}
    assert all(got[i][6] > 0.6 * got[i][5] and got[i][6] > got[1000 + i][6] for i in range(20))


def test_pieces_of_long_texts():
    data = b"Ab  cd\tEF\ngh " * 50
    assert [w for part in ngrams.word_lists(data, 16) for w in part] == data.lower().split()
    assert list(ngrams.word_lists(b"")) == [[]]


def test_packed_numbers():
    arrays = [np.array(a, np.int64) for a in ([], [0, 0], [1, 255, 256, 2**62])]
    assert all((a == b).all() for a, b in zip(ngrams.unpack(ngrams.pack(*arrays)), arrays, strict=True))


def test_successor_search():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (50, 60), (1000, 10**6), (1000, 1001), (5000, 10**15)):
        values = np.unique(rng.integers(0, top, n))
        data = trie.Sequence.encode(values)
        s, end = trie.Sequence.read(memoryview(data), 0)
        assert end == len(data) and (s.values() == values).all()
        asked = np.concatenate([values, rng.integers(0, top + 5, 3000)])
        place = {int(v): k for k, v in enumerate(values)}
        assert s.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def test_trie_against_a_dictionary():
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 12, (400, 3)), axis=0)
    v, u, w = rows.T
    n = rng.integers(1, 50, len(rows))
    total = np.bincount(v, n)[v]
    known = trie.Trie(trie.build(v, u, w, n, total, 8.0, 4.0))
    asked = rng.integers(-1, 14, (2000, 3))
    triple, mass, pair = known.look_up(*asked.T)
    for k, (a, b, c) in enumerate(asked):
        of_pair = n[(v == a) & (w == c)].sum()
        of_context = n[(v == a) & (u == b)].sum()
        own = n[(v == a) & (u == b) & (w == c)].sum()
        code = lambda p: trie.quantised(np.array([p]))[0]
        assert pair[k] == (code(of_pair / (n[v == a].sum() + 8)) if of_pair else trie.NONE)
        assert mass[k] == (code(4 / (of_context + 4)) if of_context else trie.NONE)
        assert triple[k] == (code(own / (of_context + 4)) if own else trie.NONE)
    # a few bytes for each n-gram
    big = np.unique(rng.integers(0, 3000, (60_000, 3)), axis=0)
    assert len(trie.build(*big.T, np.ones(len(big), np.int64), np.full(len(big), 20), 8.0, 4.0)) < 9 * len(big)


@pytest.mark.parametrize("x", [[], [5], [3, 3, 4, 9], [-1, 4, 2, -1, 4], [7, 1 << 50, 7, 0], [9, 3, 3, 9, 1]])
def test_distinct_numbers(x):
    """As ``np.unique``, by whichever way."""
    x = np.array(x, np.int64)
    for mine, want in zip(trie.distinct(x), np.unique(x, return_inverse=True), strict=True):
        assert mine.tolist() == want.tolist()


def test_few_and_many_numbers_of_a_sequence():
    """A sequence that is searched and one that is decoded give the same places."""
    values = np.cumsum(np.random.default_rng(8).integers(1, 1 << 20, 5000))
    s, _ = trie.Sequence.read(memoryview(trie.Sequence.encode(values)), 0)
    asked = np.sort(np.concatenate([values[::7], values[::5] + 1, [0, 1 << 60]]))
    few = np.concatenate([s.find(asked[k : k + 100]) for k in range(0, len(asked), 100)])
    place = {int(v): k for k, v in enumerate(values)}
    assert s.find(asked).tolist() == few.tolist() == [place.get(int(x), -1) for x in asked]

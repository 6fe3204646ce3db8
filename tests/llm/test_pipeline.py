"""The pipeline as a whole and each stage against plain Python, with nulls, ties, equal rows, repeated ids and clashing columns."""

import random
import re

import pytest

pytest.importorskip("rarefield.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from rarefield.llm.queries import PIECES, tokenizer  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sentences(seed, n, k=3):
    rnd = random.Random(seed)
    return "\n".join(" ".join(f"{rnd.choice('abcdefgh')}{rnd.choice('rstuvw')}{rnd.randrange(9999)}" for _ in range(n)) for _ in range(k))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, "clash") for i, t, lang in rows], SCHEMA)


def texts(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


X, Y, Z = sentences(1, 30), sentences(2, 30), sentences(3, 30)
ITEM = " ".join(f"q{i}" for i in range(30))
#: Rows that repeat an id with other texts, equal rows, a near copy, nulls and empty texts.
ROWS = [
    (3, X, "aa"),
    (5, X, "aa"),
    (5, Y, "aa"),
    (7, Y + " more", "aa"),
    (9, Z, "aa"),
    (9, Z, "aa"),
    (None, sentences(4, 30), "aa"),
    (11, None, "aa"),
    (12, "", None),
    (13, "12 34 !", "aa"),
    (14, sentences(5, 20) + "\n" + ITEM, "aa"),
    (14, sentences(6, 20), "aa"),
    (15, "Zwei und drei " * 20000, "bb"),
    (16, "alone", None),
]


def near_groups(rows):
    """The group of each row: five-word shingles, similarity 0.8 or more, links joined."""
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def one_of_each(rows):
    groups = near_groups(rows)
    first = {}
    for k, (i, _, _) in enumerate(rows):
        first[groups[k]] = min(first.get(groups[k], ((True, 0), k)), ((i is None, i or 0), k))
    return [rows[k] for _, k in first.values()]


def holds_item(text, item):
    """Whether the best local alignment of words scores half of the item's length."""
    w, q = words(text), words(item)
    row, best = [0.0] * (len(w) + 1), 0.0
    for x in q:
        last = 0.0
        for j, y in enumerate(w, 1):
            score = max(0.0, last + (1.0 if x == y else -0.5), row[j] - 0.5, row[j - 1] - 0.5)
            last, row[j] = row[j], score
            best = max(best, score)
    return best >= 0.5 * len(q)


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def without_repeated_lines(rows):
    """Of lines of ten characters and more that are within a fifth of their words, the first stays; rows of a null id keep theirs."""
    heads, group = [], {}
    norm = lambda line: line.strip(" \t\r").lower()
    for i, t, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for line in map(norm, t.split("\n")):
            if len(line) >= 10 and line not in group:
                w = line.split(" ")
                near = [h for h, v, _ in heads if 5 * abs(len(v) - len(w)) <= max(len(v), len(w)) and 5 * word_distance(v, w) <= max(len(v), len(w))]
                group[line] = near[0] if near else line
                if not near:
                    heads.append((line, w, (i, t)))
    owner = {h: at for h, _, at in heads}
    out = []
    for i, t, lang in rows:
        if i is None or t is None:
            out.append((i, t, lang))
            continue
        kept, mine = [], set()
        for line in t.split("\n"):
            g = group.get(norm(line))
            if g is None or owner[g] == (i, t) and g not in mine:
                kept.append(line)
            mine.add(g)
        if len(kept) == len(t.split("\n")):
            out.append((i, t, lang))
        elif re.search(r"\S", "\n".join(kept)):
            out.append((i, "\n".join(kept), lang))
    return out


def test_language_stage(spark):
    got = corpus_pipeline.language_id(spark, table(spark, ROWS), "")
    assert got.columns == table(spark, []).columns
    assert texts(got) == sorted(((i, t) for i, t, _ in ROWS if t and any(c.isalpha() for c in t)), key=str)
    assert corpus_pipeline.language_id(spark, table(spark, []), "").count() == 0


def test_near_duplicate_stage_loses_no_text_of_a_repeated_id(spark):
    got = corpus_pipeline.minhash_dedup(spark, table(spark, ROWS), "")
    assert got.columns == table(spark, []).columns
    assert texts(got) == sorted(((i, t) for i, t, _ in one_of_each(ROWS)), key=str)
    six = [(3, X, "a"), (5, X, "a"), (5, Y, "a"), (7, Y + " more", "a"), (9, Z, "a"), (9, Z, "a")]
    assert texts(corpus_pipeline.minhash_dedup(spark, table(spark, six), "")) == [(3, X), (5, Y), (9, Z)]
    assert corpus_pipeline.minhash_dedup(spark, table(spark, []), "").count() == 0


def written(spark, tmp_path, rows, items):
    table(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_decontamination_stage(spark, tmp_path):
    folder = written(spark, tmp_path, ROWS, [(1, ITEM), (2, None)])
    got = corpus_pipeline.decontamination(spark, table(spark, ROWS), folder)
    assert texts(got) == sorted(((i, t) for i, t, _ in ROWS if i == 15 or not holds_item(t, ITEM)), key=str)
    assert corpus_pipeline.decontamination(spark, table(spark, []), folder).count() == 0


def test_decontamination_stage_without_items(spark, tmp_path):
    folder = written(spark, tmp_path, ROWS, [])
    assert corpus_pipeline.decontamination(spark, table(spark, ROWS), folder).count() == len(ROWS)


def test_line_stage(spark):
    got = corpus_pipeline.line_dedup(spark, table(spark, ROWS), "")
    assert texts(got) == sorted(((i, t) for i, t, _ in without_repeated_lines(ROWS)), key=str)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got.collect())
    assert corpus_pipeline.line_dedup(spark, table(spark, []), "").count() == 0


def test_all_stages_against_plain_python(spark, tmp_path):
    import sentencepiece

    folder = written(spark, tmp_path, ROWS, [(1, ITEM)])
    rows = [r for r in ROWS if r[1] and any(c.isalpha() for c in r[1])]
    rows = [r for r in one_of_each(without_repeated_lines(rows)) if r[0] == 15 or not holds_item(r[1], ITEM)]
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    want = sorted(((i, model.encode(t)) for i, t, _ in rows), key=str)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=str) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] is not None for r in got)

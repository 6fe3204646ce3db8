import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("rarefield.llm")
from rarefield.llm import chat, decontaminate, embeddings, language, lines, minhash, pieces, quality, secrets, token_counts  # noqa: E402
from rarefield.llm.queries import BYTES, PIECES, tokenizer  # noqa: E402
from rarefield.llm.templates import Template, TemplateError  # noqa: E402

DOCS = "doc_id long, text string, kept string, component_id long"
ODD = ["", " ", "\n", "a", " a  b\n\nc▁d ﬁ é é  x <s> \x00 😀", "▁▁ a", "foo  bar\n\n  x\r\ny", "a" * 400, " " * 90 + "a", "x <|endoftext|> y", None, "Hello\tworld"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)


def odd_texts(n=400):
    rnd = random.Random(5)
    alphabet = list("abcdeth  inoe ▁\n\t.,'s1é😀ß\xa0\x00<>|")
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    c = pieces.PieceCodec(tokenizer(PIECES))
    for t in odd_texts():
        ids = c.encode(t)
        assert ids == model.encode(t or "")
        assert c.decode(ids) == model.decode(ids)


def test_piece_digests_of_nulls_and_empty_tables(spark):
    rows = pieces.round_trip_digests(docs(spark, [None, "a"]), tokenizer(PIECES)).collect()
    assert rows[0]["n_tokens"] == 0 and rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pieces.round_trip_digests(docs(spark, []), tokenizer(PIECES)).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(BYTES))
    texts = odd_texts()
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, texts), tokenizer(BYTES)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((t or "").encode())


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    texts = [None, "", "  ", "one", "ONE", "one two"]
    for _ in range(80):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            k = rnd.randrange(len(w))
            if rnd.random() < 0.7:
                w[k] = f"x{rnd.randrange(50)}"
            else:
                del w[k]
        texts.append(" ".join(w))
    sets = [shingles(t, 3) for t in texts]
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in minhash.near_duplicates(docs(spark, texts), 3, 85).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i)


def embedding_answers(rows):
    """(n_links, component_id, kept) of each row (vec_id, vector, label) by comparing all pairs."""
    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])

    root, links = list(range(len(rows))), [0] * len(rows)

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    own = [least.get(find(i)) for i in range(len(rows))]
    return [(r[0], links[i], own[i], r[0] is None or own[i] == r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("d", [1, 16, 256])
def test_embeddings_against_brute_force(spark, d):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, d))
    x[1:12] = x[0] + rng.normal(size=(11, d)) * 0.15
    x[20:24] = x[20]
    x[40:52] = x[40] * rng.uniform(1, 3, (12, 1)) + rng.normal(size=(12, d)) * 0.1
    rows = [(i, v.tolist(), int(i % 2 == 0 and i < 30)) for i, v in enumerate(x)] + [(80, None, 1), (81, [0.0] * d, 1), (82, [float("nan")] * d, 1), (83, x[0].tolist(), None), (84, [], 1), (85, [None] * d, 1)]
    # ids that repeat with other vectors, a null id, and vectors of another length
    rows += [(5, x[60].tolist(), 0), (5, x[61].tolist(), 0), (86, x[61].tolist(), 0), (None, x[0].tolist(), 1), (87, [*x[0].tolist(), 1e-9], 1), (88, [*x[0].tolist(), 2e-9], 1)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id long, embedding array<double>, label int, kept string, component_id int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()), key=repr)
    assert got == sorted(embedding_answers(rows), key=repr)


@pytest.mark.parametrize("d", [64, 768])
def test_embedding_plans_reach_their_recall(d):
    """Pairs exactly at the threshold share a cell, on either side of the number of hashes."""
    rng = np.random.default_rng(d)
    x, w = rng.normal(size=(2, 300, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w -= (w * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    label = np.zeros(300, np.int64)
    step = embeddings.CELL * 2 * d
    assert [embeddings.plan(n, d, 0.93)[0] for n in (step, step + 1)] == [1, 2]
    for n in (step, step + 1) if d == 64 else (step,):
        shape = embeddings.plan(n, d, 0.93)
        shared = (embeddings.cell_keys(x, label, *shape) == embeddings.cell_keys(y, label, *shape)).any(axis=1)
        assert shared.mean() >= 0.99


def test_contamination(spark):
    item = " ".join(f"q{i}" for i in range(30))
    edited = " ".join(f"q{i}" if i % 6 else "zz" for i in range(30))
    clean = " ".join(f"c{i}" for i in range(200))
    table = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "two words", "x")], "item_id long, text string, score string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs(spark, [clean, f"{clean} {item} tail", f"a b {edited} c", None, ""]), table).collect()}
    assert sorted(got) == [1, 2] and got[1]["score"] == 1.0
    assert (got[1]["start_word"], got[1]["end_word"]) == (200, 230)


def test_seeds_across_documents_alone(spark):
    """The fault: where the only seed of a run of texts began in one document and ended in the next, the search raised."""
    table = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")
    apart = docs(spark, ["x y a b", "c z z", "a", "b", "c d"]).coalesce(1)
    assert decontaminate.contaminated(apart, table).count() == 0
    assert [r["doc_id"] for r in decontaminate.contaminated(apart.union(docs(spark, ["z", "a b c d e"])).coalesce(1), table).collect()] == [1]


def peak(work):
    """What ``work`` returns, and the most MB it held."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_long_passage_among_short_ones():
    """A passage as long as a document was aligned in one table with a thousand short ones."""
    rnd = np.random.default_rng(3)
    item = rnd.integers(1, 1 << 60, 40).astype(np.uint64)
    windows = [np.concatenate([x, item[: 10 + k % 30], x]) for k in range(1000) if len(x := rnd.integers(1, 1 << 60, 12).astype(np.uint64))] + [np.tile(item, 250)]
    (best, end), mb = peak(lambda: decontaminate.align(windows, [item] * len(windows)))
    alone = [decontaminate.align([w], [item]) for w in windows]
    assert best.tolist() == [float(a[0][0]) for a in alone] and end.tolist() == [int(a[1][0]) for a in alone]
    assert best[:30].tolist() == list(range(10, 40)) and best[-1] == 40 and mb < 40


def test_seeds_that_many_items_share(monkeypatch):
    """A phrase that all items hold is met a few items at a time: the same passages, and memory that doesn't grow with hits times items."""
    texts = [" ".join(f"w{k}_{i}" for i in range(20)) + " one phrase that all items hold" for k in range(1500)]
    items = decontaminate.items_block(list(range(1500)), texts)
    body = " ".join(f"t{i}" + (" one phrase that all items hold" if i % 100 == 0 else "") for i in range(2000))
    batch = pa.record_batch([pa.array([1, 2, None, 4, 5]), pa.array([body, "one phrase that", body, "", body + " " + texts[3]])], ["doc_id", "text"])
    rows = lambda: sorted((r["doc_id"], r["item"], r["start"], tuple(r["window"]), tuple(r["seeds"])) for b in decontaminate.search_batch(batch, items) for r in b.to_pylist())
    want = rows()
    assert {r[0] for r in want} == {1, 2, 5} and len(want) == 1500 * 42
    monkeypatch.setattr(decontaminate, "_PAIRS", 5000)
    monkeypatch.setattr(decontaminate, "_WORDS_OUT", 3000)
    assert rows() == want
    most, mb = peak(lambda: max(len(b.column(3).flatten()) for b in decontaminate.search_batch(batch, items)))
    assert most < 3100 and mb < 12


def test_chat_round_trip(spark):
    both = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", both), (1, 1, "assistant", "\\" + both), (1, 2, "tool", "<<SYS>>"), (2, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert chat.read_back(r["formatted"]) == want
    assert chat.digests(chat.format_conversations(df)).count() == 2


def test_template_sandbox():
    assert Template("{% if 1 == 2 %}a{% else %}b{{ 'c' ~ 1 }}{% endif %}").render()[0] == "bc1"
    with pytest.raises(TemplateError):
        Template("{{ x.__class__() }}")
    assert Template("{{ x.y }}").render(x="text")[0] == ""


RULES = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def base_spans(text):
    """(start, kind, end) of the three rules, by Python's own matcher."""
    least = (8, 16, 32)
    return sorted((m.start(), k, m.end()) for k, rule in enumerate(RULES) for m in rule.finditer(text or "") if len(m[2] if k == 0 else m[0]) >= least[k])


def said(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


RANDOM = ["q8Zx1Lp0VbT7rK2mN9s", "xK9vQ2mZ7pL4", "qZxWvKjHgFdSaPoIuYtReWq", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg=="]


def test_secrets_against_python(spark):
    texts = [None, "", 'password = "hunter2hunter2"', "token: secret: abcdefghijk", "AKIA" + "A" * 16 + " " + "f" * 40, "é API_KEY='short' apikey=0123456789", "😀 " + " and ".join(RANDOM), "get_user_name_from_config set-default-handler internationalisation", "x" * 40 + " " + "token = abcdefgh1 " * 30, "TOKEN=a" * 9]
    model, threshold = secrets.calibrated(secrets.labelled_samples(docs(spark, texts[:6] + texts[7:])))
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark, texts), model, threshold).collect()}
    score = lambda t: sum(round(model[t[k : k + 2]], 6) for k in range(len(t) - 1))
    for i, t in enumerate(texts):
        base = base_spans(t)
        extra = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t or "") if len(m[0]) >= secrets.LEAST and score(m[0]) >= threshold]
        assert got[i]["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in secrets.KINDS] == [sum(1 for s in base + extra if s[1] == k) for k in range(4)]
        assert got[i]["spans"] == said(sorted(base + extra))
    assert got[6]["n_random"] == len(RANDOM) and got[7]["n_random"] == 0
    assert secrets.find_secrets(docs(spark, []), model, threshold).count() == 0


def test_character_models_of_counted_pairs(spark):
    """The tables against counts in plain Python."""
    rows = [("aXb9", 1), ("aX", 1), ("abab", 0), ("a b", 0)]
    model = secrets.train(spark.createDataFrame(rows, "text string, label int"))
    k = len(secrets.ALPHABET)
    for pair in ("aX", "ab", "ba", "zz"):
        p = []
        for y in (1, 0):
            pairs = [t[i : i + 2] for t, label in rows if label == y for i in range(len(t) - 1) if " " not in t[i : i + 2]]
            p.append((pairs.count(pair) + 0.5) / (sum(x[0] == pair[0] for x in pairs) + 0.5 * k))
        assert model[pair] == pytest.approx(np.log(p[0] / p[1]))


def test_secret_models_learn_from_all_tokens(spark):
    """All different tokens of each kind, not some thousands, and long ones to their end."""
    words = [f"plainword{k:05d}" for k in range(5000)]
    values = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(4500)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 5000, 50)] + [" ".join(values[k : k + 50]) for k in range(0, 4500, 50)]
    samples = secrets.labelled_samples(docs(spark, texts + texts[:3]))
    got = [(r["text"], r["label"]) for r in samples.collect()]
    assert len(got) == 5000 + 4500 + 2000 and {(w, 0) for w in words} | {(v, 1) for v in values} <= set(got)
    long = "".join("abAB09"[k * k % 6] for k in range(1000)) + "zzz"
    counted, plain = (secrets.train(spark.createDataFrame([(t, 1) for t in rows], "text string, label int")) for rows in ([long], [long[k : k + 2] for k in range(len(long) - 1)]))
    assert counted == plain


def test_many_secrets_in_one_text(spark):
    """Eighty thousand spans of one text in bounded time."""
    text = "".join(f"token={k:08d}x {'ab' * (k % 3)}" for k in range(80_000))
    began = time.time()
    r = secrets.find_secrets(docs(spark, [text]), secrets.train(secrets.made_samples(spark, 100)), 1e9).first()
    assert r["n_assign"] == 80_000 and r["spans"] == said(base_spans(text))
    assert time.time() - began < 15


def test_equal_lines_go_but_for_the_first(spark):
    line = "This line is the same in many documents."
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, [f"own one\n{line}", f"{line.upper()} \nown two\n{line}", None, "tiny\ntiny", ""])).collect()}
    assert got[0]["text"] == f"own one\n{line}" and got[1]["text"] == "own two"
    assert got[2]["text"] is None and got[3]["text"] == "tiny\ntiny" and got[4]["text"] == ""
    assert got[1]["kept"] == "clash"


def test_language_profiles():
    p = language.Profiles({"aa": language.ranked(language.gram_codes("aba abab baba"), 50).view(np.int64).tolist(), "xx": language.ranked(language.gram_codes("xyx yxy xyxy"), 50).view(np.int64).tolist()})
    assert p.identify("abba")[0] == "aa" and p.identify("yxyx")[0] == "xx"
    assert p.identify(None) == ("und", 0.0) and p.identify("12 34")[0] == "und"


def test_quality_prefers_good_texts():
    rnd = random.Random(6)
    good = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rnd.choice("### $$$ %%% @@@ !!!".split()) for _ in range(80)) for _ in range(60)]
    s = quality.Scorer(quality.fit(good + bad, [1] * 60 + [0] * 60))
    assert s.score(good[0]) > 0.5 > s.score(bad[0]) and 0 <= s.score("") <= 1
    assert 0 <= quality.Scorer(quality.fit([], [])).score("x") <= 1


def test_quality_sample_of_rows_that_repeat(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    assert quality.sample(rows, labels, "quality") == (["c", "a"], [0, 1])
    assert quality.sample(rows, labels.where("false"), "quality") == ([], [])
    scored = quality.score(docs(spark, [None, "", "word " * 300_000]), quality.fit([], [])).collect()
    assert len(scored) == 3 and all(0 <= r["score"] <= 1 for r in scored)


def test_contaminated_share_of_edited_copies(spark):
    """At a fifth of the words replaced nine of ten copies are found, and no clean document."""
    rnd = random.Random(17)
    word = lambda: f"b{rnd.randrange(4000)}"
    items = [[word() for _ in range(30)] for _ in range(60)]
    texts = []
    for item in items:
        copy = list(item)
        for k in rnd.sample(range(30), 6):
            copy[k] = word()
        texts.append(" ".join([word() for _ in range(100)] + copy + [word() for _ in range(100)]))
    texts += [" ".join(word() for _ in range(230)) for _ in range(60)]
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {r["doc_id"] for r in decontaminate.contaminated(docs(spark, texts), table).collect()}
    assert len([i for i in found if i < 60]) >= 54 and max(found) < 60


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dropped_by_brute_force(texts):
    """Positions of the lines to drop in each text: all but the first line of each group of lines within a fifth of their words."""
    lines_of, first = {}, {}
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            norm = line.strip(" \t\r").lower()
            if len(norm) >= 10:
                lines_of[i, p] = norm
                first.setdefault(norm, norm)
    norms = list(first)
    split = {n: re.sub(r"([぀-ヿ一-鿿])", r" \1 ", n).split(" ") for n in norms}
    split = {n: [w for w in ws if w] for n, ws in split.items()}

    def find(v):
        while first[v] != v:
            v = first[v]
        return v

    for k, a in enumerate(norms):
        for b in norms[:k]:
            if word_distance(split[a], split[b]) * 5 <= max(len(split[a]), len(split[b])):
                first[find(a)] = find(b)
    seen, lost = set(), {}
    for at in sorted(lines_of):
        g = find(lines_of[at])
        if g in seen:
            lost.setdefault(at[0], []).append(at[1])
        seen.add(g)
    return lost


def edited_lines(seed=8):
    rnd = random.Random(seed)
    vocabulary = [f"{c}{k}" for c in ("w", "of", "longer") for k in range(70)]
    made = []
    for n in [3, 4, 5, 6, 9, 10, 12, 20, 40, 80] * 3:
        base = [rnd.choice(vocabulary) for _ in range(n)]
        for _ in range(5):
            w = list(base)
            for _ in range(rnd.randint(0, n // 4 + 1)):
                k = rnd.randrange(len(w)) if w else 0
                w[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1)
            made.append(" ".join(w))
    kana = [chr(0x3042 + k) for k in range(70)]
    for _ in range(4):
        base = [rnd.choice(kana) for _ in range(20)]
        for edits in (0, 2, 4, 6):
            made.append("".join(rnd.choice(kana) if k < edits else c for k, c in enumerate(base)))
    hub = [f"h{k}" for k in range(25)]
    made += [" ".join(f"x{rnd.randrange(900)}" if rnd.random() < 0.15 else w for w in hub) for _ in range(60)]
    rnd.shuffle(made)
    return ["\n".join(made[k : k + 4]) for k in range(0, len(made), 4)]


def recall(got, want):
    """The share of the wanted (document, line) pairs that were found; nothing else may be."""
    found = {(i, p) for i, ps in got.items() for p in ps or []}
    every = {(i, p) for i, ps in want.items() for p in ps}
    assert found <= every
    return len(found) / len(every)


def test_fuzzy_lines_against_brute_force(spark):
    texts = [*edited_lines(), None, ""]
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup_lines(docs(spark, texts)).collect()}
    want = dropped_by_brute_force(texts)
    assert sum(map(len, want.values())) > 100
    assert recall(got, want) >= 0.95


@pytest.mark.parametrize("n", [12, 40])
def test_fuzzy_pairs_of_one_length(spark, n):
    """Pairs of lines at every number of edits that is allowed, two thousand lines in all."""
    rnd = random.Random(n)
    word = lambda: f"v{rnd.randrange(5000)}"
    made = []
    for k in range(250):
        base = [word() for _ in range(n)]
        w = [[x] for x in base]
        for at in rnd.sample(range(n), 1 + k % max(1, n // 5)):
            w[at] = rnd.choice([[word()], [], [*w[at], word()]])
        made += [" ".join(base), " ".join(x for y in w for x in y)]
    want = dropped_by_brute_force(made)
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup_lines(docs(spark, made)).collect()}
    assert sum(map(len, want.values())) > 200
    assert recall(got, want) >= 0.97


def test_lines_that_share_common_blocks_alone(spark, monkeypatch):
    """Pairs that meet at no block but those of eight words which all lines begin with; hubs alone lost most of them."""
    met, rest = [], lines._rest
    monkeypatch.setattr(lines, "_rest", lambda *args: met.append(rest(*args)) or met[-1])
    common = [f"common{k}" for k in range(8)]
    made = [" ".join([*common, f"a{k}{side}", f"b{k}", f"c{k}", f"d{k}{side}"]) for k in range(60) for side in "xy"]
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup_lines(docs(spark, made)).collect()}
    assert got == {i: [0] if i % 2 else None for i in range(120)}
    assert {i: x for i, x in got.items() if x} == {i: x for i, x in dropped_by_brute_force(made).items() if x}
    assert len(met) == 1 and met[0] is not None  # the hubs had not linked them all


@pytest.mark.parametrize("crowd", [4096, 8])
def test_crowded_buckets_are_told_apart_by_sketches(spark, monkeypatch, crowd):
    """The fault: each word of each member of a bucket became a row on disk.  Beyond ``CROWD`` members that still is so, with the same result."""
    rows, save = {}, lines.Scratch.save

    def saved(self, df, name="t"):
        out = save(self, df, name)
        rows[name] = rows.get(name, 0) + (out.count() if name in ("spread", "apart", "rest") else 0)
        return out

    monkeypatch.setattr(lines.Scratch, "save", saved)
    monkeypatch.setattr(lines, "CROWD", crowd, raising=False)
    rnd = random.Random(3)
    common = [f"common{k}" for k in range(8)]
    made = [[*common, *[f"v{rnd.randrange(3000)}" for _ in range(20)]] for _ in range(60)]
    made += [[x if rnd.random() < 0.9 else f"u{rnd.randrange(3000)}" for x in w] for w in made]
    made = [" ".join(w) for w in made]
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup_lines(docs(spark, made)).collect()}
    want = dropped_by_brute_force(made)
    assert len(want) > 40 and recall(got, want) == 1
    assert rows["apart"] > 100 and rows["rest"] < 60 and ("spread" in rows) == (crowd < 100)


def test_a_line_of_repeated_words_is_in_a_bucket_once(spark):
    """The fault: it was there once for each of its equal blocks, and two such lines met up to 64 times."""
    made = [" ".join(["same"] * 14 + [f"v{k}"] * 6) for k in range(5)]
    distinct = lines.distinct_lines(lines.line_table(docs(spark, made), lines.MIN_CHARS, lines.SIMILARITY))
    _, members = lines._candidates(distinct, lines.Scratch(spark, "members"), lines.SIMILARITY)
    assert members.count() == members.select("key", "h").distinct().count() > 0


def test_sketches_leave_out_no_line_within_the_edits(spark):
    rnd = random.Random(5)
    made = []
    for n in [4, 5, 9, 10, 30, 60, 200] * 20:
        w = [[f"w{rnd.randrange(300)}"] for _ in range(n)]
        base = [x for y in w for x in y]
        for at in rnd.sample(range(n), n // 5):
            w[at] = rnd.choice([[f"x{rnd.randrange(300)}"], [], [*w[at], "y"]])
        made.append((base, [x for y in w for x in y]))
    pairs = [(k, a, b) for k, (a, b) in enumerate(made) if word_distance(a, b) * 5 <= max(len(a), len(b))]
    words = spark.createDataFrame([(2 * k + side, w) for k, *two in pairs for side, w in enumerate(two)], "h long, w array<string>")
    sketches = lines._sketches(words.select("h", F.lit(None).cast("long").alias("s"), lines.spelt(F.col("w")).alias("line0")), lines.Scratch(spark, "sketches"))
    one, other = (sketches.where(F.col("h") % 2 == side).select(F.floor(F.col("h") / 2).alias("k"), *lines._renamed(sketches, x)) for side, x in enumerate("ab"))
    assert len(pairs) > 100 and one.join(other, "k").where(lines._near("a", "b", 0.8)).count() == len(pairs)
    assert one.join(other.withColumn("k", F.col("k") + 7), "k").where(lines._near("a", "b", 0.8)).count() < len(pairs) / 10


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    same, own = "a line that two texts have in common", "nobody else has these words at all"
    rows = [(1, same, "x", 1), (5, f"{same}\n{own}", "x", 1), (5, f"{own} but one\n{same}", "x", 1), (5, f"{same}\n{own}", "x", 1), (None, same, "x", 1)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([(0, same), (1, same), (5, own), (5, own), (5, f"{own} but one")])


def test_simhash_bits(spark):
    rnd = random.Random(2)
    table = spark.createDataFrame([(n, [f"v{rnd.randrange(200)}" for _ in range(n)]) for n in (1, 2, 5, 255, 256, 3000)], "h long, w array<string>")
    for r in lines.with_simhash(table).selectExpr("s", "transform(w, x -> xxhash64(x)) AS x").collect():
        assert r["s"] == sum(1 << b for b in range(lines.SKETCH) if 2 * sum(x >> b & 1 for x in r["x"]) > len(r["x"]))


def test_lines_that_share_their_first_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "line_hashes", lambda norm: [F.xxhash64(F.left(norm, F.lit(1))).alias("h"), F.xxhash64(norm).alias("h2")])
    one, two, three = "a first line of eight words in all", "a second line that has other words entirely", "b third line, which no other line resembles"
    texts = [f"{one}\n{two}\n{three}", f"{two}\n{one}\n{two}", three, f"{one} too"]
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: None, 1: [0, 1, 2], 2: [0], 3: None}


def test_short_and_unspaced_lines(spark):
    pairs = [("a bc de fg", "a bc de xy fg"), ("i am at an inn", "i am at an elm"), (" ".join(["of", "to", "in", "on", "at", "by"] * 6), " ".join(["of", "to", "in", "on", "at", "by"] * 5 + ["of", "to", "in", "on", "at", "up"])), ("山川草木花鳥風月春夏秋冬", "山川草木花鳥風月春夏秋雪")]
    apart = ["one two three", "one two four", "ab cd ef gh ij", "ab cd xx gh yy"]
    got = {r["doc_id"]: r["dropped_lines"] for r in lines.dedup_lines(docs(spark, [x for p in pairs for x in p] + apart)).collect()}
    assert got == {i: [0] if i % 2 and i < 2 * len(pairs) else None for i in range(2 * len(pairs) + len(apart))}


def test_profiles_of_copied_texts(spark):
    rows = [(i, text, lang) for k, (text, lang) in enumerate([("aba abab baba", "aa"), ("xyx yxy xyxy", "xx")]) for i in range(k * 1000, k * 1000 + 400)]
    profiles = language.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=4)
    assert sorted(profiles) == ["aa", "xx"]
    same = spark.createDataFrame([(1, "aba", "aa")] * 50 + [(2 + k, "bcb", "aa") for k in range(3)], "doc_id long, text string, lang string")
    assert language.gram_codes("bcb").view(np.int64)[0] in language.learn_profiles(same)["aa"][:2]


def test_frequent_pre_tokens_of_a_sorted_table(spark):
    texts = ["first words only " * 3] * 200 + [f"{'a ' * 11_000}later"] * 200
    table, lengths = token_counts.frequent_lengths(docs(spark, texts), tokenizer(BYTES), rows=100)
    assert {" first", " later"} <= set(table.split("\0")) and len(lengths) == len(table.split("\0"))


def test_line_stage_of_the_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = edited_lines(9)
    lost = dropped_by_brute_force(texts)
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.line_dedup(spark, docs(spark, texts), "").collect()}
    for i, t in enumerate(texts):
        must = [line for p, line in enumerate(t.split("\n")) if p not in lost.get(i, [])]
        assert set(must) <= set(got.get(i, [])) <= set(t.split("\n"))
    assert sum(map(len, got.values())) - sum(t.count("\n") + 1 for t in texts) <= -0.95 * sum(map(len, lost.values()))


def test_rows_that_repeat_an_id_are_linked(spark):
    w = [f"u{k}" for k in range(60)]
    rows = [(5, "nothing like the other one at all here", "x", 1), (5, " ".join(w), "x", 1), (7, " ".join([*w[:-1], "zz"]), "x", 1), (5, " ".join(w), "x", 1), (9, " ".join(f"v{k}" for k in range(200_000)), "x", 1)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect())
    assert got == [(5, 6, 5), (5, 58, 5), (5, 58, 5), (7, 58, 5), (9, 199_998, 9)]
    assert minhash.near_duplicates(docs(spark, []), 3, 85).count() == 0


def test_training_share_of_a_large_language():
    assert language.slot_bound(1500, 10**11, -(1 << 63)) + (1 << 63) == pytest.approx(1500 / 10**11 * 2**64, rel=1e-6)
    assert language.slot_bound(1500, 10, 5) == (1 << 63) - 1 and language.slot_bound(1, 10**30, 5) == 5


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = " ".join(random.Random(1).choice(["abc", "déf", "x1y", "ß", "..."]) for _ in range(400))
    whole = np.unique(language.gram_codes(text), return_counts=True)
    monkeypatch.setattr(language, "PIECE", 7)
    for a, b in zip(language.gram_counts(text), whole, strict=True):
        assert a.tolist() == b.tolist()


def profile_by_hand(texts, size):
    """Cavnar and Trenkle's profile in plain Python: n-grams of 1 to 3 letters by frequency, then by code."""
    from collections import Counter

    counts = Counter()
    for t in texts:
        spaced = "".join(c.lower() if c.isalpha() else " " for c in t)
        for word in spaced.split():
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[k : k + 2] for k in range(len(padded) - 1))
            counts.update(padded[k : k + 3] for k in range(len(padded) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    ranked = sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]
    return [code(g) for g in ranked]


def test_languages_against_brute_force(spark):
    rnd = random.Random(12)
    spoken = {"aa": "the of and to in is".split(), "bb": "der und die das ist von".split(), "cc": "le la et les des une".split()}
    rows = []
    for i in range(90):
        lang = sorted(spoken)[i % 3]
        rows.append((i, " ".join(rnd.choice(spoken[lang]) for _ in range(40)), lang))
    rows += [(100, None, "aa"), (101, "12 34", "aa"), (102, "", None), (7, "the of", "bb")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = table.where("doc_id % 4 != 0")
    profiles = language.learn_profiles(learned, size=60)
    own = {lang: profile_by_hand([t for i, t, x in rows if x == lang and t and i % 4], 60) for lang in spoken}
    assert profiles == {k: [int(np.array([c], np.uint64).view(np.int64)[0]) for c in v] for k, v in own.items()}
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(table, profiles).collect())
    want = []
    for i, t, _ in rows:
        mine = profile_by_hand([t or ""], 60)
        if not mine:
            want.append((i, "und", 0.0))
            continue
        away = {k: sum(abs(p.index(g) - r) if g in p else 60 for r, g in enumerate(mine)) for k, p in own.items()}
        best = min(sorted(away), key=lambda k: away[k])
        want.append((i, best, round(1 - away[best] / (60 * len(mine)), 9)))
    assert got == sorted(want)

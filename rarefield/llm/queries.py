"""The ``opN_<name>`` queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefield.llm import chat, decontaminate, embeddings, language, lines, minhash, ngrams, pieces, quality, repair, secrets, token_counts
from rarefield.shipping import ensure_shipped

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(_read(spark, sf_dir, "documents"), tokenizer(PIECES))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), tokenizer(BYTES))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(*quality.sample(docs, labels.where(~language.held_out(labels, folds=3, fold=1)), "quality"))
    scored = quality.score(docs, model)
    held = F.coalesce(language.held_out(scored, folds=3, fold=1), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, *secrets.calibrated(secrets.labelled_samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn_profiles(docs.where(~language.held_out(docs))))
    return found.select("doc_id", F.coalesce(language.held_out(found), F.lit(True)).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.with_empty(repair.repair(repair.damage(rows)).report, rows.select("conv_id"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = ngrams.score_corpus(docs, ~F.coalesce(language.held_out(docs, folds=10), F.lit(True)))
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_token_counts": op3_token_counts,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_quality": op5_quality,
        "op6_decontamination": op6_decontamination,
        "op7_chat_format": op7_chat_format,
        "op8_secrets": op8_secrets,
        "op9_line_dedup": op9_line_dedup,
        "op10_language": op10_language,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_lm_scores": op12_lm_scores,
    }


# What the escape of a text looks like in SQL: no control string overlaps another.
_ESCAPED = "replace(coalesce(text, ''), '\\', '\\\\')"
for _c in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

_OP7 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + sum(CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 17 ELSE 17 + length(role) END + length({_ESCAPED})))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


# CRC-32 of a text of ASCII characters, bit by bit; 3988292384 is the polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"


def _add(x: str, cost: str, edit: str) -> str:
    """A path, its cost in nine digits and then its edits, with one more edit: least() finds the cheapest and least."""
    return f"lpad((substr({x}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{edit}'"


_ANY = "least(x0, x1, x3)"  # states from which a user's turn follows
_OP11 = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
), slots AS (SELECT *, {_CRC.format(s="s")} % 20 AS slot FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE slot WHEN 4 THEN 'user' ELSE role END AS role,
    CASE slot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM slots, unnest(CASE slot WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(k)
), placed AS (
  SELECT *, row_number() OVER w AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told,
    lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), found AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN told = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(told, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM found GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS x0, NULL::VARCHAR AS x1, {_add("'000000000'", "5", "I")} AS x2, {_add("'000000000'", "10", "II")} AS x3 FROM counted
  UNION ALL
  SELECT conv_id, i, x0, x1, y2, least(x3, {_add("y2", "5", "I")}) FROM (
    SELECT *, least(x2, {_add(_ANY, "5", "I")}) AS y2 FROM (
      SELECT d.conv_id, f.i, {_add("x0", "2", "D")} AS x0,
        least({_add("x1", "2", "D")}, CASE WHEN may AND initial = 's' THEN {_add("x0", "e", "K")} END) AS x1,
        least({_add("x2", "2", "D")}, CASE WHEN may AND initial = 'u' THEN {_add(_ANY, "e", "K")} END, CASE WHEN may THEN {_add(_ANY, "(1 + e)", "R")} END) AS x2,
        least({_add("x3", "2", "D")}, CASE WHEN may AND initial = 'a' THEN {_add("x2", "e", "K")} END, CASE WHEN may THEN {_add("x2", "(1 + e)", "R")} END) AS x3
      FROM dp AS d JOIN (SELECT *, fault IN (0, 3) AS may, CASE fault WHEN 3 THEN 5 ELSE 0 END AS e FROM found) AS f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1
    ) AS a
  ) AS b
), best AS (
  SELECT c.*, substr(least(x0, x3), 1, 9)::BIGINT AS cost, substr(least(x0, x3), 10) AS audit FROM counted AS c JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n
), edits AS (
  SELECT conv_id, p, substr(audit, p, 1) AS e, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS k
  FROM best, unnest(range(1, length(audit) + 1)) AS t(p)
), kept AS (
  SELECT e.conv_id, p, e, k, role, text, max(CASE WHEN e = 'K' AND k = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM edits AS e LEFT JOIN found AS f ON e.e <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e <> 'D'
), mended AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS told FROM kept GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN mended AS m ON m.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": _OP7, "op11_conversation_repair": _OP11}

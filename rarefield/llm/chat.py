"""Operator 7: chat formatting with a compiled template, and reading the result back.

The template wraps each turn in control strings and marks the assistant's text
as generation.  Control strings inside roles and texts are escaped: a backslash
goes after the first character of each, and every backslash is doubled, so the
formatted text holds a control string only where the template wrote it and the
original can be read back exactly.

Defined cases: a null text or role is empty; turns are ordered by turn, then
role, then text, nulls first; rows without a conversation id belong to no
conversation; a conversation is one row of output whatever its length; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.llm.templates import Template

# The control strings of the format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
SOURCE = (
    "{{ '<s>' }}"
    "{% for m in messages %}"
    "{% if m.role == 'user' %}{{ '[INST]' ~ ' ' }}{{ m.text | escape }}{{ ' ' ~ '[/INST]' }}"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>\n{{ m.text | escape }}\n<</SYS>>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>"
    "{% endif %}"
    "{% endfor %}"
)

_ESCAPE = re.compile("|".join(["\\\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_UNESCAPE = re.compile(r"\\(\\?)")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


def escape(text: str | None) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text) if text else ""


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns: list[tuple[str, str]] = []
    at = len("<s>")
    find = formatted.index
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = find(" [/INST]", at + 7)
            turns.append(("user", unescape(formatted[at + 7 : end])))
            at = end + len(" [/INST]")
        elif formatted.startswith("<<SYS>>\n", at):
            end = find("\n<</SYS>>", at + 8)
            turns.append(("system", unescape(formatted[at + 8 : end])))
            at = end + len("\n<</SYS>>")
        elif formatted.startswith("[ROLE]", at):
            mid = find("[/ROLE]", at)
            end = find("</s>", mid)
            turns.append((unescape(formatted[at + 6 : mid]), unescape(formatted[mid + 7 : end])))
            at = end + 4
        else:
            end = find("</s>", at)
            turns.append(("assistant", unescape(formatted[at + 1 : end])))
            at = end + 4
    return turns


def format_conversations(rows: DataFrame, source: str = SOURCE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, spans): each conversation's text and the code point spans under the loss mask."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    grouped = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, {"escape": escape})
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column(1).to_pylist():
                text, marked = template.render(messages=[{"role": t["role"] or "", "text": t["text"] or ""} for t in turns])
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in marked])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "spans"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

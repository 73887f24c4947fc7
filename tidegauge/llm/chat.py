"""Preference formatting: one prompt and two masked completions per pair of conversations.

The longest common prefix of turns (role and text) of the chosen and the
rejected conversation is rendered once as the prompt.  What follows in each is
its completion, with the spans that count in training: the text of assistant
turns and the mark that ends them, as code point offsets into the completion.

Conversations arrive as arrays of turns, one row per pair, so a pair is as
large as its own text and no group of pairs ever meets in a task.

Defined cases: null roles and texts are empty strings; a null or empty
conversation has no turns; equal conversations have empty completions; every
pair is formatted for itself, repeated or not; other columns are carried along
but for those whose names the result takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The marks around a turn.
BEGIN, MIDDLE, END, AFTER = "<|im_start|>", "\n", "<|im_end|>", "\n"
TRAINED = ("assistant",)
TURN = "struct<role:string,text:string>"

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MADE = [("prefix_turns", pa.int64()), ("prompt", pa.string()), ("chosen_text", pa.string()), ("chosen_mask", _SPANS), ("rejected_text", pa.string()), ("rejected_mask", _SPANS)]
_DDL = "prefix_turns bigint, prompt string, chosen_text string, chosen_mask array<struct<start:int,end:int>>, rejected_text string, rejected_mask array<struct<start:int,end:int>>"


def conversations(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns) with each conversation's turns in order; ties in ``turn`` go by role and text."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))))
    gathered = turns.groupBy(id).agg(ordered.alias("turns"))
    return gathered.select(id, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _pairs(turns) -> list[tuple[str, str]]:
    return [((t or {}).get("role") or "", (t or {}).get("text") or "") for t in turns or []]


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The turns as text, and the spans that are trained."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = BEGIN + role + MIDDLE
        parts += [head, text, END, AFTER]
        if role in TRAINED:
            spans.append({"start": at + len(head), "end": at + len(head) + len(text) + len(END)})
        at += len(head) + len(text) + len(END) + len(AFTER)
    return "".join(parts), spans


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The pairs' other columns with prompt, completions and masks; ``chosen`` and ``rejected`` are arrays of (role, text)."""
    made = {name for name, _ in _MADE}
    rest = [c for c in pairs.columns if c not in made | {chosen, rejected}]
    source = pairs.select(*rest, F.col(chosen).cast(f"array<{TURN}>").alias("_chosen"), F.col(rejected).cast(f"array<{TURN}>").alias("_rejected"))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column("_chosen").to_pylist(), batch.column("_rejected").to_pylist()):
                good, bad = _pairs(a), _pairs(b)
                n = next((i for i, (x, y) in enumerate(zip(good, bad)) if x != y), min(len(good), len(bad)))
                rows.append((n, rendered(good[:n])[0], *rendered(good[n:]), *rendered(bad[n:])))
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_MADE)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *columns], [*rest, *[n for n, _ in _MADE]])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in rest]
    return source.mapInArrow(form, ", ".join([*kept, _DDL]))

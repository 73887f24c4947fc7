"""Secret scans: fixed patterns, and formats learnt from what those patterns find.

The values of the base patterns are the labelled credentials.  For each kind a
sample of at most ``SAMPLE`` distinct values (the first ``VALUE`` characters of
each) is turned into a probabilistic automaton by grammar inference.  All other
runs ``[A-Za-z0-9+/_.=-]`` of ``CANDIDATE`` or more characters, as many as a
labelled value has, are candidates; base spans are cut out of a run, and what is
left on either side is a run.  Marks at the ends of runs and values do not count.  How long the candidates of all documents are and
which class of characters follows which in them is counted, and that is the
background.  A candidate is a span of kind ``format`` if some kind's automaton
finds it likelier than the background by at least ``ODDS`` (natural logarithm).

The texts are read twice, to learn and to scan.  Learning hands out labelled
values and, per task, the counts of the background: a few hundred numbers.
Candidates are scored as arrays of character classes, all of a slice at once.

The sample is the documented bound of training; it is chosen by hash from the
distinct values of all documents.  Candidates are counted and scored without any
bound, and automata are bounded by levels and states whatever the values.

Defined cases: null and empty texts have no spans; a kind of fewer than
``TAUGHT`` distinct values has no automaton; repeated rows are each scanned;
spans are code points, end exclusive; other columns are left alone.  A text of
any length is a slice of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.automata import ALPHANUMERIC, CLASSES, DEEPEST, OF_BYTE, Automaton, Background, background_counts, infer
from tidegauge.llm.textbatch import replaced, sliced, text_bytes
from tidegauge.plans import scratch

KINDS = ("assign", "access", "hex", "format")
SAMPLE = 1000
VALUE = 1024
#: A kind of fewer distinct values shows no format.
TAUGHT = 30
CANDIDATE = 6
ODDS = 8.0
#: Bytes of text scanned at a time; a worker holds some fifty bytes of arrays for each.
SLICE = 1 << 20
MARKS = "".join(CLASSES[ALPHANUMERIC:])

#: The base patterns, with the characters that a match must have.
_ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_ASSIGN_LEAST = 6

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_COUNTS = (DEEPEST + 1, (len(CLASSES) + 1) * len(CLASSES))

Span = tuple[int, int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end, value) of the base patterns, sorted."""
    spans = [(m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _ASSIGN_LEAST]
    spans += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(spans)


class _Slice:
    """Texts of a slice with their base spans, and the runs of candidates between these, as bytes."""

    def __init__(self, column: pa.Array):
        self.texts = column.to_pylist()
        self.base = [base_spans(t) if t else [] for t in self.texts]
        data, self._offsets = text_bytes(column)
        self.symbols = OF_BYTE[data]
        self._data = data
        for row in (i for i, spans in enumerate(self.base) if spans):
            text, at = self.texts[row], self._offsets[row]
            for start, _, end, _ in self.base[row]:
                first = at + len(text[:start].encode())
                self.symbols[first : first + len(text[start:end].encode())] = -1
        inside = self.symbols >= 0
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        # A run never crosses into another row.
        edges = self._offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        starts[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
        first, after = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        # Without the marks at either end, which may belong to the sentence.
        plain = np.flatnonzero(inside & (self.symbols < ALPHANUMERIC))
        low, high = np.searchsorted(plain, first), np.searchsorted(plain, after)
        filled = high > low
        first, after = plain[low[filled]], plain[high[filled] - 1] + 1
        long = after - first >= CANDIDATE
        self.starts, self.ends = first[long], after[long]

    def candidates(self) -> list[str]:
        return [self._data[a:b].tobytes().decode() for a, b in zip(self.starts, self.ends)]

    def formats(self, kinds: list[Automaton], background: Background, least: float) -> list[list[Span]]:
        """Per row the candidates that a kind finds likelier than the background."""
        out: list[list[Span]] = [[] for _ in self.texts]
        if not kinds or not len(self.starts):
            return out
        likely = np.max([k.log_likelihoods(self.symbols, self.starts, self.ends) for k in kinds], axis=0)
        odds = likely - background.log_likelihoods(self.symbols, self.starts, self.ends)
        for i in np.flatnonzero(odds >= least):
            row = int(np.searchsorted(self._offsets, self.starts[i], side="right")) - 1
            raw = self._data[self._offsets[row] : self.ends[i]].tobytes()
            size = int(self.ends[i] - self.starts[i])
            start = len(raw[:-size].decode())
            out[row].append((start, 3, start + size, raw[-size:].decode()))
        return out

    def spans(self, kinds: list[Automaton], background: Background, least: float) -> list[list[Span]]:
        return [sorted(a + b) for a, b in zip(self.base, self.formats(kinds, background, least))]


def learnt(documents: DataFrame, text: str = "text") -> tuple[list[Automaton], Background]:
    """An automaton for each kind with labelled values, and the background of all candidates."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(sum(_COUNTS), np.int64)
        for batch in sliced(batches, "text", SLICE):
            part = _Slice(batch.column("text"))
            lengths, follows = background_counts(part.symbols, part.starts, part.ends)
            counts += np.concatenate((lengths, follows.ravel()))
            labelled = [(kind, value.strip(MARKS)[:VALUE]) for spans in part.base for _, kind, _, value in spans if value.strip(MARKS)]
            columns = [pa.array([k for k, _ in labelled], pa.int32()), pa.array([v for _, v in labelled], pa.string()), pa.nulls(len(labelled), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "value", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.string()), pa.array([counts], pa.list_(pa.int64()))], ["kind", "value", "counts"])

    rows = scratch.cut(documents.select(F.col(text).alias("text")).mapInArrow(gather, "kind int, value string, counts array<bigint>"))
    numbers = np.zeros(sum(_COUNTS), np.int64)
    summed = rows.where("counts IS NOT NULL").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        numbers[row["at"]] = row["n"]
    samples = [_sample(rows.where(F.col("kind") == kind).select("value")) for kind in range(3)]
    kinds = [infer(values) for values in samples if len(values) >= TAUGHT]
    return kinds, Background(numbers[: _COUNTS[0]], numbers[_COUNTS[0] :].reshape(-1, len(CLASSES)))


def _sample(values: DataFrame) -> list[str]:
    chosen = values.distinct().orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
    return [r["value"] for r in chosen.collect()]


def scanned(documents: DataFrame, id: str = "doc_id", text: str = "text", least: float = ODDS) -> DataFrame:
    """Per document row: its id, ``base`` spans and all ``spans`` (start, kind, end), sorted by start and kind."""
    rows = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(learnt(rows))

    def plain(spans: list[Span]) -> list[dict]:
        return [{"start": start, "kind": kind, "end": end} for start, kind, end, _ in spans]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            part = _Slice(batch.column("text"))
            base, every = map(plain, part.base), map(plain, part.spans(*shared.value, least))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(list(base), pa.list_(_SPAN)), pa.array(list(every), pa.list_(_SPAN))], ["doc", "base", "spans"])

    kind = rows.schema["doc"].dataType.simpleString()
    spans = "array<struct<start:int,kind:int,end:int>>"
    return rows.mapInArrow(score, f"doc {kind}, base {spans}, spans {spans}").withColumnRenamed("doc", id)


def redacted(documents: DataFrame, text: str = "text", length: str | None = None, least: float = ODDS) -> DataFrame:
    """The documents, all columns, with each secret replaced by ``[SECRET]``.

    Overlapping spans become one mark.  ``length`` names a whole-numbered column
    that gets the number of code points of a changed text.
    """
    if length is not None and documents.schema[length].dataType.simpleString() not in ("int", "bigint"):
        raise ValueError(f"{length} must be a column of whole numbers")
    shared = documents.sparkSession.sparkContext.broadcast(learnt(documents, text))

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            part = _Slice(batch.column(text))
            spans = part.spans(*shared.value, least)
            if any(spans):
                clean = [_masked(t, s) if s else t for t, s in zip(part.texts, spans)]
                if length is not None:
                    lengths = batch.column(length).to_pylist()
                    new = [len(c) if s else n for s, c, n in zip(spans, clean, lengths)]
                    batch = replaced(batch, length, pa.array(new, batch.column(length).type))
                batch = replaced(batch, text, pa.array(clean, pa.string()))
            yield batch

    return documents.mapInArrow(redact, documents.schema)


def _masked(value: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, _, end, _ in spans:
        if end > at:
            if start >= at:
                out += [value[at:start], "[SECRET]"]
            at = end
    return "".join([*out, value[at:]])

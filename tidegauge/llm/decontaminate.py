"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows.

A text is normalised to its words (A-Z in lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``)
with single spaces; every window of ``width`` consecutive words of an item is a
pattern between spaces, an item with fewer words is one window.  The automaton
reads each document once; hits come back as word positions and as code point
offsets of the original text.

The benchmark is the small, stated side: its items go to the workers in blocks
of at most ``BLOCK_BYTES`` of text, one automaton per block, so a larger
benchmark means more passes and never a larger broadcast.

Defined cases: null or empty texts have no words and no hits; an item without
words has no window; a null item id counts as an item named by the empty
string; items that share an id are one item; repeated document rows are each
returned.  Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.textbatch import replaced, sliced
from tidegauge.plans import scratch

BLOCK_BYTES = 2 << 20
WIDTH = 10

#: Bytes of a word; all others separate words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPANS = "array<struct<first:int,last:int,start:int,end:int>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(parts: list, width: int) -> Iterator[tuple]:
    """Every window of an item: ``width`` words, or all of them if there are fewer."""
    for i in range(max(1, len(parts) - width + 1) if parts else 0):
        yield tuple(parts[i : i + width])


class Matcher:
    """The automaton of one block of (item id, text); its symbols are numbers of the block's words, 0 for any other word."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self._numbers: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            parts = [self._numbers.setdefault(p, len(self._numbers) + 1) for p in normal_words(text)]
            for window in windows(parts, width):
                owners[window].add(item)
        self._machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in owners.items():
            self._machine.add_word(window, (len(window), tuple(ids)))
        self._empty = not owners
        if owners:
            self._machine.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, disjoint hit ranges of words (end inclusive), items found."""
        parts = raw.translate(_TABLE).split()
        if self._empty or not parts:
            return len(parts), [], set()
        number = self._numbers.get
        found = list(self._machine.iter(tuple([number(p, 0) for p in parts])))
        ranges = sorted((end - n + 1, end) for end, (n, _) in found)
        return len(parts), merged(ranges), set().union(*(ids for _, (_, ids) in found))


_MATCHERS: dict[str, Matcher] = {}


def _matcher(block: str, shared, width: int) -> Matcher:
    """Built once in each Python worker, which serves many tasks of a block."""
    if block not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[block] = Matcher(shared.value, width)
    return _MATCHERS[block]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or adjacent ranges (sorted, end inclusive) as disjoint ones."""
    out: list[tuple[int, int]] = []
    for first, last in ranges:
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def original_spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with their code point offsets (end exclusive) in the original text."""
    if not ranges:
        return []
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"first": a, "last": b, "start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in ranges]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in lists of bounded size."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for i in range(count):
        yield [(r["item"], r["text"]) for r in items.where(block == i).collect()]


def _scanned(documents: DataFrame, items: list[tuple[str, str]], id: str, text: str, width: int) -> DataFrame:
    shared, block = documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            matcher = _matcher(block, shared, width)
            n_words, spans, found = [], [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                n, ranges, items_hit = matcher.scan(value or b"")
                n_words.append(n)
                spans.append(original_spans(value or b"", ranges))
                found.append(sorted(items_hit))
            span = pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(pa.string()))],
                ["doc", "n_words", "spans", "items"],
            )

    source = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc {kind}, n_words bigint, spans {_SPANS}, items array<string>")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document row: its id, ``n_words``, hit ``spans`` (words and code points) and the ``items`` found, sorted.

    With one block there is no shuffle.  With more, each block is a pass whose
    hits are kept for the few documents that have any, then united per row.
    """
    blocks = _blocks(benchmark, item, item_text, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _scanned(documents, first, id, text, width).select(F.col("doc").alias(id), "n_words", "spans", "items")
    return _united(documents, itertools.chain([first, second], blocks), id, text, width)


def _united(documents: DataFrame, blocks: Iterator[list[tuple[str, str]]], id: str, text: str, width: int) -> DataFrame:
    """Hits of several blocks, one row per document row; rows are told apart by id and text."""
    keyed = documents.select(F.struct(F.col(id).alias("id"), F.md5(text).alias("md5")).alias("doc"), F.col(text).alias("text"))
    hits = None
    for items in blocks:
        part = _scanned(keyed, items, "doc", "text", width).where("size(items) > 0").select("doc", "spans", "items").distinct()
        hits = scratch.cut(part if hits is None else hits.unionByName(part))
    gathered = hits.groupBy("doc").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for row in batch.column("spans").to_pylist():
                starts, ends = {s["first"]: s["start"] for s in row}, {s["last"]: s["end"] for s in row}
                ranges = merged([(s["first"], s["last"]) for s in row])
                spans.append([{"first": a, "last": b, "start": starts[a], "end": ends[b]} for a, b in ranges])
            yield replaced(batch, "spans", pa.array(spans, batch.column("spans").type))

    united = gathered.mapInArrow(unite, gathered.schema)
    counted = _scanned(keyed, [], "doc", "text", width).select("doc", "n_words")
    return counted.join(united, counted["doc"].eqNullSafe(united["doc"]), "left").select(
        counted["doc"]["id"].alias(id),
        "n_words",
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents, all columns, in which no window of any item occurs; one pass per block, no shuffle."""
    kept = documents
    for i, items in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        kept = _clean(scratch.cut(kept) if i else kept, items, text, width)
    return kept


def _clean(documents: DataFrame, items: list[tuple[str, str]], text: str, width: int) -> DataFrame:
    shared, block = documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            matcher = _matcher(block, shared, width)
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not matcher.scan(t or b"")[1] for t in texts], pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)

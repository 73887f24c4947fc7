"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pretoken's leaves hold the rank of each adjacent pair of symbols (with its
place, so that equal ranks order from the left); the root is the leftmost pair
of the lowest rank.  A merge changes three leaves, each in logarithmic time,
until the root holds no mergeable pair.  Here the trees of many pretokens are
rows of one array, and every step performs one merge in each row that is not
finished.

Texts are split by the byte-level pattern (contractions, letters, numbers,
others, white space) over arrays of code point classes; added tokens of the
vocabulary are cut out first.  Each distinct pretoken of a slice is encoded
once, and a worker remembers up to ``REMEMBERED`` of them.

The vocabulary file is read where the query is written and sent to the workers
(at most ``VOCABULARY_BYTES``), so executors need no such file.

Defined cases: null and empty texts have no tokens and decode to the empty
text; every row is encoded for itself, repeated or not.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.textbatch import sliced, strings, text_bytes

VOCABULARY_BYTES = 64 << 20
#: Bytes of text encoded at a time.
SLICE = 1 << 20
REMEMBERED = 300_000
#: Cells of the trees that are worked on at a time.
CELLS = 1 << 20

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_NONE = np.iinfo(np.int64).max


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, text):
            points = [ord(text[found.start()]), ord(text[found.end() - 1])]
            table[points[0] : points[1] + 1] = kind
    table[0xD800:0xE000] = _OTHER
    return table


class Vocabulary:
    """Symbols, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, file: str):
        parts = json.loads(file)
        model, names = parts["model"], _byte_names()
        if parts["normalizer"] or model["type"] != "BPE" or parts["pre_tokenizer"].get("type") != "ByteLevel" or parts["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError("added tokens must stand for themselves")
        numbers = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in parts["added_tokens"]}
        size = max([*numbers.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for name, number in numbers.items():
            self.pieces[number] = bytes(names[c] for c in name)
        for content, number in self.special.items():
            self.pieces[number] = content
        self.of_byte = np.zeros(256, np.int64)
        for name, byte in names.items():
            self.of_byte[byte] = numbers[name]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(numbers[a] << 32) | numbers[b] for a, b in merges], np.int64)
        made = np.array([numbers[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self._pairs, self._ranks, self._made = pairs[order], order, made
        self._classes = _classes()
        self._splits = re.compile(b"|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._known: dict[bytes, bytes] = {}
        self._piece_data = np.frombuffer(b"".join(self.pieces), np.uint8)
        self._piece_ends = np.cumsum([0, *map(len, self.pieces)])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of symbol pairs, ``_NONE`` where they don't merge."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where(self._pairs[at] == keys, self._ranks[at], _NONE)

    def merge(self, tokens: list[bytes]) -> list[np.ndarray]:
        """The ids of every pretoken."""
        out: list[np.ndarray] = [self.of_byte[np.frombuffer(t, np.uint8)] if len(t) < 2 else None for t in tokens]
        lengths = np.array([len(t) for t in tokens])
        width = 2
        while (lengths >= width).any():
            todo = np.flatnonzero((lengths >= width) & (lengths < 2 * width))
            leaves = 2 * width
            step = max(1, CELLS // leaves)
            for i in range(0, len(todo), step):
                some = todo[i : i + step]
                for j, ids in zip(some, self._trees([tokens[k] for k in some], leaves)):
                    out[j] = ids
            width *= 2
        return out

    def _trees(self, tokens: list[bytes], leaves: int) -> list[np.ndarray]:
        """Merge to the end, one tree of ``leaves`` leaves per token; every token is shorter than that."""
        count = len(tokens)
        lengths = np.array([len(t) for t in tokens])
        raw = np.frombuffer(b"".join(t.ljust(leaves, b"\0") for t in tokens), np.uint8).reshape(count, leaves)
        symbols = self.of_byte[raw]
        place = np.arange(leaves)
        inside = place[None, :] < (lengths - 1)[:, None]
        after = np.where(inside, place + 1, -1)
        before = np.broadcast_to(place - 1, (count, leaves)).copy()
        tree = np.full((count, 2 * leaves), _NONE)
        rank = self._rank(symbols[:, :-1], symbols[:, 1:])
        mergeable = inside[:, :-1] & (rank != _NONE)
        tree[:, leaves:-1][mergeable] = (rank * leaves + place[:-1])[mergeable]
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(count, -1, 2).min(axis=2)
            level //= 2
        alive = place[None, :] < lengths[:, None]
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            at = tree[rows, 1] & (leaves - 1)
            right = after[rows, at]
            made = self._made[tree[rows, 1] // leaves]
            beyond, prior = after[rows, right], before[rows, at]
            symbols[rows, at] = made
            alive[rows, right] = False
            after[rows, at] = beyond
            joined = beyond >= 0
            before[rows[joined], beyond[joined]] = at[joined]
            tree[rows, leaves + right] = _NONE
            self._set(tree, rows, at, symbols[rows, at], symbols[rows, beyond], beyond >= 0, leaves)
            has = prior >= 0
            self._set(tree, rows[has], prior[has], symbols[rows[has], prior[has]], made[has], np.ones(has.sum(), bool), leaves)
            paths = np.stack([leaves + right, leaves + at, leaves + np.maximum(prior, 0)])
            while paths[0, 0] > 1:
                paths >>= 1
                tree[rows, paths] = np.minimum(tree[rows, 2 * paths], tree[rows, 2 * paths + 1])
            rows = rows[tree[rows, 1] != _NONE]
        return [symbols[i, alive[i]] for i in range(count)]

    def _set(self, tree, rows, at, left, right, there, leaves: int) -> None:
        rank = np.where(there, self._rank(left, right), _NONE)
        tree[rows, leaves + at] = np.where(rank == _NONE, _NONE, np.where(rank == _NONE, 0, rank) * leaves + at)

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where pretokens begin, and the first pretoken of each row (with the end)."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        kinds = self._classes[points]
        at = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
        breaks = np.zeros(n + 1, bool)
        rows = np.searchsorted(at, offsets)
        breaks[rows] = True
        breaks[n] = True
        whole = np.zeros(n, bool)
        for found in self._splits.finditer(raw) if self._splits else ():
            row = np.searchsorted(offsets, found.start(), side="right")
            if row < len(offsets) and found.end() <= offsets[row]:
                first, end = np.searchsorted(at, [found.start(), found.end()])
                breaks[[first, end]] = True
                whole[first:end] = True
        starts = breaks[:-1].copy()
        starts[1:] |= kinds[1:] != kinds[:-1]
        runs = starts.copy()
        space = (kinds == _SPACE) & ~whole
        # A white space run gives its last character to what follows it in the same part; a blank joins it.
        follows = np.flatnonzero(runs[1:] & ~breaks[1:-1] & space[:-1]) + 1
        starts[follows - 1] = True
        starts[follows[points[follows - 1] == 32]] = False
        ends = np.append(runs[1:], True) | breaks[1:]
        for first, after in ((b"s", b""), (b"t", b""), (b"m", b""), (b"d", b""), (b"r", b"e"), (b"v", b"e"), (b"l", b"l")):
            self._contract(points, kinds, starts, ends, breaks, first + after)
        for first in np.flatnonzero(whole & breaks[:-1]):
            end = first + int(np.argmax(breaks[first + 1 :])) + 1
            starts[first + 1 : end] = False
        begun = np.flatnonzero(starts)
        return at[begun], np.searchsorted(begun, rows)

    @staticmethod
    def _contract(points, kinds, starts, ends, breaks, letters: bytes) -> None:
        """An apostrophe that begins a pretoken takes these letters along."""
        n, k = len(points), len(letters)
        if n <= k:
            return
        found = (points[: n - k] == 39) & starts[: n - k] & ends[: n - k]
        for i, letter in enumerate(letters, 1):
            found &= (points[i : n - k + i] == letter) & ~breaks[i : n - k + i]
        at = np.flatnonzero(found)
        starts[at + 1] = False
        rest = at + 1 + k
        rest = rest[rest < n]
        starts[rest[kinds[rest] == _LETTER]] = True

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and the first id of each row (with the end)."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins, rows = self.pretokens(data, offsets)
        encoded = strings(data, np.append(begins, len(data))).dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        new = [t for t in distinct if t not in known]
        known.update((t, ids.astype(np.uint32).tobytes()) for t, ids in zip(new, self.merge(new)))
        for content, number in self.special.items():
            known[content] = np.array([number], np.uint32).tobytes()
        pieces = [known[t] for t in distinct]
        flat, ends = np.frombuffer(b"".join(pieces), np.uint32), np.cumsum([0, *map(len, pieces)]) // 4
        ids, positions = gathered(flat, ends, encoded.indices.to_numpy())
        return ids, positions[rows]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each row of ids; bytes that are no text become U+FFFD."""
        data, positions = gathered(self._piece_data, self._piece_ends, ids.astype(np.int64))
        raw, at = data.tobytes(), positions[bounds]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def gathered(flat: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces ``flat[ends[c]:ends[c + 1]]`` for every code one after another, and where each begins (with the end)."""
    lengths = (ends[1:] - ends[:-1])[codes]
    positions = np.concatenate(([0], np.cumsum(lengths)))
    shift = np.repeat(ends[codes] - positions[:-1], lengths)
    return flat[np.arange(positions[-1]) + shift], positions


_LOADED: dict[str, Vocabulary] = {}


def loaded(name: str, shared) -> Vocabulary:
    """Parsed once in each Python worker."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Vocabulary(shared.value)
    return _LOADED[name]


def vocabulary_text(path: str) -> str:
    file = Path(path)
    if file.stat().st_size > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a broadcast vocabulary may be")
    return file.read_text(encoding="utf-8")


def encoded(documents: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Per document row: its id, ``n_tokens``, digests of ids and decoded text, and (if asked) the ids themselves."""
    content = vocabulary_text(vocabulary)
    name = hashlib.sha256(content.encode()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(content)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            model = loaded(name, shared)
            all_ids, bounds = model.encode(batch.column("text"))
            texts = model.decode(all_ids, bounds)
            raw = all_ids.astype("<u4").tobytes()
            columns = [
                batch.column("doc"),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            names = ["doc", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(all_ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    made = f"doc {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return source.mapInArrow(encode, made).withColumnRenamed("doc", id)


def decoded(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows with an array of ids, with the text those ids stand for instead of the array."""
    content = vocabulary_text(vocabulary)
    name = hashlib.sha256(content.encode()).hexdigest()
    shared = tokens.sparkSession.sparkContext.broadcast(content)
    rest = [c for c in tokens.columns if c != ids]
    source = tokens.select(*rest, F.coalesce(F.col(ids), F.array().cast("array<int>")).cast("array<int>").alias(text))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = loaded(name, shared)
            lists = batch.column(text)
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            texts = model.decode(lists.flatten().to_numpy(), bounds)
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, pa.field(text, pa.string()), pa.array(texts, pa.string()))

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != text]
    return source.mapInArrow(decode, ", ".join([*schema, f"`{text}` string"]))

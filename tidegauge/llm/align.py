"""Cross-tokenizer alignment: how the tokens of two vocabularies overlap, text by text and over the corpus.

Every text, with a blank before it, is encoded by a byte-level BPE file (A) and
a SentencePiece model (B), special tokens being plain text.  Byte offsets where
tokens of both end cut them into groups; two tokens are linked if their bytes
overlap.  A link lies between two neighbouring ends of either side, so links are
counted along the merged ends, never as pairs.  A pair of ids counts as often as
links hold it in the corpus; the best pairs of a B id are those counted most.

Identity fast path: for each A id the B id with the same bytes is known
beforehand.  A group of one A and one B token with that B id needs no pair: it is
one more in a vector as long as the vocabulary, of which each task hands out one.
Only links of other groups become pairs, counted once per slice of text before
they are shuffled.

Texts are encoded once.  A slice (a megabyte) is stored as one row: what its
documents hold, A ids of identity links, and places of the other links in the
slice's list of distinct pairs.  When all counts are known, the vector is
broadcast (its length is that of the vocabulary) and the counts of a slice's
pairs return to it by two shuffles, one row for each slice and pair whatever the
number of documents; a pair that is everywhere is one row a slice.

Defined cases: null and empty texts, and texts whose tokens do not spell them
(the B side writes U+2581 as a blank), have no tokens: zeros and no groups; rows
are taken for themselves, repeated or not, null ids included; other columns are
left alone.  A text of any length is a slice of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.bpe import VOCABULARY_BYTES, _byte_names, gathered, vocabulary_text
from tidegauge.llm.textbatch import sliced, strings, text_bytes
from tidegauge.plans import scratch

#: Bytes of text aligned at a time: a task holds some hundred bytes of arrays for each.
SLICE = 1 << 20
REMEMBERED = 200_000
REMEMBERED_BYTES = 64
_BLANK = "▁"

# Fixed value: how byte-level vocabularies of this family part a text.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """A byte-level BPE file whose tokens are numbered in the order of their merges; no token is special."""

    def __init__(self, file: str):
        import tiktoken

        parts = json.loads(file)
        model, names = parts["model"], _byte_names()
        if parts["normalizer"] or model["type"] != "BPE" or parts["pre_tokenizer"].get("type") != "ByteLevel" or parts["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("tokens must be numbered in the order of their merges")
        self.pieces = [b""] * (max(model["vocab"].values()) + 1)
        for name, number in model["vocab"].items():
            self.pieces[number] = bytes(names[c] for c in name)
        # Tokens that no merge makes and that are no byte, such as special ones, never come out of a text.
        usable = {*made, *(model["vocab"][c] for c in names)}
        ranks = {self.pieces[number]: number for number in usable}
        self._encoding = tiktoken.Encoding("bytes", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, and the first id of each (with the end)."""
        found = [np.array(self._encoding.encode_ordinary(t) if t else (), np.int64) for t in texts]
        return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate(([0], np.cumsum([len(ids) for ids in found], dtype=np.int64)))


class Pieces:
    """A SentencePiece model that puts a blank before a text and writes unknown characters as bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces, splits = [], True
        for number in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(number)
            usual = not (self._model.is_byte(number) or self._model.is_control(number) or self._model.is_unknown(number))
            splits &= not usual or _BLANK not in piece.lstrip(_BLANK)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(number) else piece.replace(_BLANK, " ").encode())
        if not splits or self._model.encode("a  b") != [*self._model.encode("a"), *self._model.encode(" b")]:
            raise ValueError("a model is needed whose pieces hold blanks only at their beginning, and that keeps all blanks")
        self._one_blank = [self._model.piece_to_id(_BLANK)]
        self._known: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a blank, and the first id of each row (with the end).

        No piece reaches across a blank that follows something else, so texts are cut there and each distinct part is encoded once.
        """
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begins)
        parts = strings(data, np.append(at, len(data))).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = [p for p in distinct if p not in self._known]
        # The model adds the first blank itself, but to an empty text it adds nothing.
        made = self._model.encode([p[1:].decode() for p in new], num_threads=1)
        found = {p: np.array(ids if len(p) > 1 else self._one_blank, np.uint32).tobytes() for p, ids in zip(new, made)}
        raw = [found[p] if p in found else self._known[p] for p in distinct]
        self._known.update((p, ids) for p, ids in found.items() if len(p) <= REMEMBERED_BYTES)
        flat, ends = np.frombuffer(b"".join(raw), np.uint32), np.cumsum([0, *map(len, raw)]) // 4
        ids, positions = gathered(flat, ends, parts.indices.to_numpy())
        return ids, positions[np.searchsorted(at, offsets)]


class _Table:
    """Bytes of every id of a vocabulary, and its number as text with each separator."""

    def __init__(self, pieces: list[bytes], separators: tuple[str, str]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.ends = np.cumsum([0, *map(len, pieces)])
        self.sizes = np.diff(self.ends)
        self.shown = [f"{number}{s}".encode() for number in range(len(pieces)) for s in separators]


class Aligner:
    """Both tokenizers and the map of identical tokens."""

    def __init__(self, bpe: str, model: bytes):
        self._a, self._b = ByteTokens(bpe), Pieces(model)
        self.a, self.b = _Table(self._a.pieces, (",", "|")), _Table(self._b.pieces, (",", ";"))
        of_bytes = {piece: number for number, piece in reversed(list(enumerate(self._b.pieces)))}
        self.same = np.array([of_bytes.get(p, -1) for p in self._a.pieces], np.int64)
        shown = self.a.shown + self.b.shown
        self._shown, self._shown_ends = np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)])

    def align(self, column: pa.Array) -> "Alignment":
        filled = pc.fill_null(column.cast(pa.string()), "")
        padded = pc.if_else(pc.equal(filled, ""), "", pc.binary_join_element_wise(" ", filled, ""))
        data, offsets = text_bytes(padded)
        a, a_rows = self._a.encode(padded.to_pylist())
        b, b_rows = self._b.encode(data, offsets)
        b = b.astype(np.int64)
        good = self._spelt(self.a, a, a_rows, data, offsets) & self._spelt(self.b, b, b_rows, data, offsets)
        if not good.all():
            a, a_rows = _kept(a, a_rows, good)
            b, b_rows = _kept(b, b_rows, good)
        return Alignment(self, a, a_rows, b, b_rows)

    @staticmethod
    def _spelt(table: _Table, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the tokens of each row spell its text."""
        made, positions = gathered(table.data, table.ends, ids)
        if np.array_equal(positions[rows], offsets) and np.array_equal(made, data):
            return np.ones(len(offsets) - 1, bool)
        at = positions[rows]
        return np.array([np.array_equal(made[at[i] : at[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)], bool)


def _kept(ids: np.ndarray, rows: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of good rows; other rows become empty."""
    counts = np.diff(rows)
    return ids[np.repeat(good, counts)], np.concatenate(([0], np.cumsum(np.where(good, counts, 0))))


class Alignment:
    """Tokens of a slice, their groups and links."""

    def __init__(self, aligner: Aligner, a: np.ndarray, a_rows: np.ndarray, b: np.ndarray, b_rows: np.ndarray):
        self._aligner, self.a, self.a_rows, self.b, self.b_rows = aligner, a, a_rows, b, b_rows
        a_ends, b_ends = np.cumsum(aligner.a.sizes[a]), np.cumsum(aligner.b.sizes[b])
        row_ends = np.concatenate(([0], a_ends))[a_rows]
        ends = np.concatenate((a_ends, b_ends))
        ends.sort(kind="stable")
        twice = ends[1:] == ends[:-1]
        common = ends[1:][twice]
        ends = ends[np.append(True, ~twice)] if len(ends) else ends
        #: Groups and links of row i are ``[rows[i]:rows[i + 1]]``.
        self.group_rows, self.link_rows = np.searchsorted(common, row_ends, side="right"), np.searchsorted(ends, row_ends, side="right")
        self._a_group, self._b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        self.link_a, self.link_b = a[np.searchsorted(a_ends, ends)], b[np.searchsorted(b_ends, ends)]
        links = np.diff(np.concatenate(([-1], np.searchsorted(ends, common))))
        alone = np.repeat(links == 1, links)
        self.identity = alone & (aligner.same[self.link_a] == self.link_b)

    def groups_text(self) -> list[bytes]:
        """Per row its groups as ``a1,a2|b1;a3|b2,b3``."""
        n_a = np.bincount(self._a_group, minlength=self.group_rows[-1])
        n_b = np.bincount(self._b_group, minlength=self.group_rows[-1])
        a_before, b_before = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        a_place = np.arange(len(self.a)) + b_before[self._a_group]
        b_place = np.arange(len(self.b)) + (a_before + n_a)[self._b_group]
        a_last = np.arange(len(self.a)) == (a_before + n_a - 1)[self._a_group]
        b_last = np.arange(len(self.b)) == (b_before + n_b - 1)[self._b_group]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[a_place] = 2 * self.a + a_last
        codes[b_place] = len(self._aligner.a.shown) + 2 * self.b + b_last
        shown, positions = gathered(self._aligner._shown, self._aligner._shown_ends, codes)
        raw, at = shown.tobytes(), positions[self.a_rows + self.b_rows]
        # Without the separator behind the last group.
        return [raw[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:])]


_LOADED: dict[str, Aligner] = {}


def _loaded(name: str, shared) -> Aligner:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Aligner(*shared.value)
    return _LOADED[name]


def _model_bytes(path: str) -> bytes:
    file = Path(path)
    if file.stat().st_size > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a broadcast model may be")
    return file.read_bytes()


_SLICE = "slice bigint, docs array<{kind}>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups array<binary>, n_same array<int>, same binary, other binary, pairs array<bigint>, times array<bigint>"


def aligned(documents: DataFrame, bpe: str, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document row."""
    spark = documents.sparkSession
    files = vocabulary_text(bpe), _model_bytes(model)
    name = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    shared = spark.sparkContext.broadcast(files)
    rows = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    stored = scratch.cut(rows.mapInArrow(lambda batches: _slices(batches, _loaded(name, shared)), _SLICE.format(kind=kind)))

    counted = stored.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counted = scratch.cut(counted)
    # One row per B id.
    most = counted.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("most"))
    marked = counted.join(F.broadcast(most), F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    marked = scratch.cut(marked)

    # Vectors over the A vocabulary: counts of identity pairs, and whether they are best.
    aligner = Aligner(*files)
    same = [(a << 32) | int(b) for a, b in enumerate(aligner.same) if b >= 0]
    identity = marked.join(F.broadcast(spark.createDataFrame([(p,) for p in same], "pair bigint")), "pair")
    number, best = np.zeros(len(aligner.same), np.int64), np.zeros(len(aligner.same), bool)
    for row in identity.collect():
        number[row["pair"] >> 32], best[row["pair"] >> 32] = row["n"], row["best"]
    vectors = spark.sparkContext.broadcast((number, best))

    slices = stored.where("slice IS NOT NULL")
    asked = slices.select("slice", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(marked, "pair").groupBy("slice").agg(F.collect_list(F.struct("at", "n", "best")).alias("answers"))
    summed = slices.mapInArrow(lambda batches: _identity_sums(batches, vectors), _SUMMED.format(kind=kind))
    return _finished(summed.join(answers, "slice", "left"), kind).withColumnRenamed("doc", id)


def _slices(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[pa.RecordBatch]:
    """A row per slice, and one at the end with the identity counts of the task as pairs."""
    number = TaskContext.get().partitionId() << 32
    vector = np.zeros(len(aligner.same), np.int64)
    kind = None
    for batch in sliced(batches, "text", SLICE):
        kind = batch.column("doc").type
        found = aligner.align(batch.column("text"))
        a, b, same = found.link_a, found.link_b, found.identity
        vector += np.bincount(a[same], minlength=len(vector))
        pairs, at, times = np.unique((a[~same] << 32) | b[~same], return_inverse=True, return_counts=True)
        groups = [hashlib.sha256(t).digest() if t else b"" for t in found.groups_text()]
        same_before = np.concatenate(([0], np.cumsum(same)))[found.link_rows]
        counts = [np.diff(x).astype(np.int32) for x in (found.a_rows, found.b_rows, found.group_rows, found.link_rows)]
        columns = [
            pa.array([number], pa.int64()),
            pa.array([batch.column("doc").to_pylist()], pa.list_(kind)),
            *(pa.array([c], pa.list_(pa.int32())) for c in counts),
            pa.array([groups], pa.list_(pa.binary())),
            pa.array([np.diff(same_before).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([_packed(a[same])], pa.binary()),
            pa.array([_packed(at)], pa.binary()),
            pa.array([pairs], pa.list_(pa.int64())),
            pa.array([times], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)
        number += 1
    if kind is not None and vector.any():
        there = np.flatnonzero(vector)
        nothing = [None] * (len(_NAMES) - 2)
        kinds = [pa.int64(), pa.list_(kind), *[pa.list_(pa.int32())] * 4, pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        columns = [pa.array([n], t) for n, t in zip(nothing, kinds)]
        columns += [pa.array([(there << 32) | aligner.same[there]], pa.list_(pa.int64())), pa.array([vector[there]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)


_NAMES = ["slice", "docs", "n_a", "n_b", "n_groups", "n_links", "groups", "n_same", "same", "other", "pairs", "times"]
_KEPT = ["slice", "docs", "n_a", "n_b", "n_groups", "n_links", "groups", "n_same", "other"]
_SUMMED = "slice bigint, docs array<{kind}>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups array<binary>, n_same array<int>, other binary, best_same array<bigint>, sum_same array<bigint>"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in two bytes each if all fit, otherwise four; the first byte says which."""
    kind = "<u2" if not len(numbers) or numbers.max() < 1 << 16 else "<u4"
    return bytes([int(kind[2])]) + numbers.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive pieces."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[np.concatenate(([0], np.cumsum(counts)))])


def _identity_sums(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    number, best = vectors.value
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            counts = row.column("n_same")[0].values.to_numpy()
            ids = _unpacked(row.column("same")[0].as_py())
            made = [pa.array([_sums(v[ids], counts)], pa.list_(pa.int64())) for v in (best, number)]
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in _KEPT), *made], [*_KEPT, "best_same", "sum_same"])


def _finished(rows: DataFrame, kind: str) -> DataFrame:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i] for c in batch.schema.names}
                links = value["n_links"].values.to_numpy()
                places = _unpacked(value["other"].as_py())
                number, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if value["answers"].is_valid:
                    at, n, is_best = (value["answers"].values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    number, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                    number[at], best[at] = n, is_best
                other = links - value["n_same"].values.to_numpy()
                columns = [
                    value["docs"].values,
                    *(pa.array(value[c].values.to_numpy(), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(value["best_same"].values.to_numpy() + _sums(best[places], other)),
                    pa.array(value["sum_same"].values.to_numpy() + _sums(number[places], other)),
                    pa.array([g.hex() for g in value["groups"].as_py()], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    made = f"doc {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return rows.mapInArrow(finish, made)

"""Language-model scores from a log-frequency Bloom filter.

Every unigram and bigram of the training texts is counted over all of them.  A
count c is quantised to the level q = 1 + floor(log_B c), and the filter gets
the entries (n-gram, 1) to (n-gram, q); a reader probes level after level until
one is missing, so the filter never underestimates a level.  With ``BITS`` bits
an entry and ``PROBES`` hashes an absent entry is found with probability 0.022.
Probabilities are smoothed with the unigram as prior:

    P1(w) = (c(w) + 1) / (N + V + 1)
    P(w | v) = (min(c(v w), c(v)) + PRIOR * P1(w)) / (c(v) + PRIOR)

Counting: each task counts its texts, and hands out (fingerprint, count) arrays
by leading hash bits to as many parts as there are tasks, twice; a part adds up
what it gets and builds its own piece of the filter and of the exact unigram
table.  Only finished pieces are broadcast, and those in groups of at most
``MODEL_BYTES``: while the model fits it is one pass over the texts, a larger
one takes a pass per group, whose levels are joined per document.  Every step
in Python is stored at once, with Arrow batches of a few megabytes, and a group
is taken from driver and executors when its pass is stored.

Defined cases: null and empty texts have only the end token; a null id counts
as the empty text when training texts are chosen; repeated rows each count and
each get a score; without any training text every probability is 1 / 1.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.textbatch import mix, sliced, words
from tidegauge.plans import scratch

BASE = 1.5
BITS = 8
PROBES = 5
PRIOR = 100.0
MODEL_BYTES = 192 << 20
#: Bytes of text worked on at a time; a worker keeps the memory of its largest slice.
SLICE = 1 << 20
#: Pairs that a task gathers before it hands them on, and the bits of the hash by which it then adds them up range by range.
GATHERED = 1_500_000
RANGE_BITS = 4
MAX_LEVEL = 100
#: Bytes of the model that are fetched at a time.
FETCHED_BYTES = 24 << 20

_BEGIN, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LEVEL_STARTS = BASE ** np.arange(MAX_LEVEL)


def _typical() -> np.ndarray:
    """The mean of the counts of each level; level 0 is no count."""
    out = [0.0]
    for q in range(1, MAX_LEVEL):
        low, high = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


TYPICAL = _typical()


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LEVEL_STARTS, counts + 1e-9, side="right")


class Tokens:
    """Token hashes of a slice: words, then one end token per row; ``rows`` has the first token of each row (with the end)."""

    def __init__(self, column: pa.Array):
        found = words(column)
        self.distinct = np.append(mix(found.distinct_hashes()), [_END])
        self.codes = np.insert(found.codes, found.docs[1:], len(found.distinct))
        self.rows = found.docs + np.arange(len(found.docs))
        hashes = self.distinct[self.codes]
        self.before = np.empty_like(hashes)
        self.before[1:] = hashes[:-1]
        self.before[self.rows[:-1]] = _BEGIN
        self.pairs = mix(self.before * np.uint64(3) + hashes)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _ranges(pieces: list[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums over pieces of sorted keys, for one range of the leading ``bits`` at a time; ranges without keys are left out."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    cuts = [[0, *np.searchsorted(keys, edges).tolist(), len(keys)] for keys, _ in pieces]
    for i in range(1 << bits):
        some = [(keys[c[i] : c[i + 1]], counts[c[i] : c[i + 1]]) for (keys, counts), c in zip(pieces, cuts) if c[i] < c[i + 1]]
        if some:
            yield summed(np.concatenate([k for k, _ in some]), np.concatenate([n for _, n in some]))


def _counted(texts: DataFrame, shift: int) -> DataFrame:
    """(part, kind, keys, counts): what each task counts, by leading bits of the hash."""

    def hand_out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts = (keys >> np.uint64(shift)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True])))
        if kind == 2:
            # 48 bits besides those of the part: the filter's own errors are far more frequent than equal ones.
            keys = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6] if shift >= 48 else keys.view(np.uint8).reshape(-1, 8))
        pieces = list(zip(cuts[:-1], cuts[1:]))
        columns = [
            pa.array([int(parts[a]) for a, _ in pieces], pa.int32()),
            pa.array([kind] * len(pieces), pa.int32()),
            pa.array([keys[a:b].tobytes() for a, b in pieces], pa.binary()),
            pa.array([counts[a:b].astype("<u4").tobytes() for a, b in pieces], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["part", "kind", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _MODELS.clear()  # of an earlier query in this worker
        held: dict[int, list] = {1: [], 2: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, pieces in held.items():
                # Whole parts are in a range, so this hands out no more rows.
                for keys, counts in _ranges(pieces, min(RANGE_BITS, 64 - shift)):
                    yield hand_out(kind, keys, counts)
                pieces.clear()

        for batch in sliced(batches, "text", SLICE):
            tokens = Tokens(batch.column("text"))
            ones = np.bincount(tokens.codes, minlength=len(tokens.distinct)).astype(np.int64)
            n = len(tokens.rows) - 1
            held[1].append(summed(np.append(tokens.distinct, [_BEGIN]), np.append(ones, n)))
            held[2].append(summed(tokens.pairs, np.ones(len(tokens.pairs), np.int64)))
            size += len(held[2][-1][0])
            if size >= GATHERED:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return texts.mapInArrow(count, "part int, kind int, keys binary, counts binary")


def _salt(kind: int, level: int) -> np.uint64:
    return mix(np.array([kind * 1000 + level], np.uint64))[0]


def _positions(keys: np.ndarray, kind: int, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions of the entries (key, level), one array per hash."""
    spread = mix(keys ^ _salt(kind, level))
    first, step = spread >> np.uint64(32), (spread & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield ((first + np.uint64(i) * step) % np.asarray(size, np.uint64)).astype(np.int64)


def _built(by_kind: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The filter of one part, as bytes."""
    levels = {kind: levels_of(counts) for kind, (_, counts) in by_kind.items()}
    size = max(64, -(-int(sum(q.sum() for q in levels.values())) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    for kind, (keys, _) in by_kind.items():
        for level in range(1, int(levels[kind].max(initial=0)) + 1):
            for at in _positions(keys[levels[kind] >= level], kind, level, size):
                bits[at] = True
    return np.packbits(bits, bitorder="little")


def train(texts: DataFrame, text: str = "text") -> DataFrame:
    """(part, vocabulary, counts, filter, n_tokens, n_words): the model in pieces of a table in the shared folder."""
    source = texts.select(F.col(text).alias("text"))
    # Twice the number of tasks, as a power of two.
    bits = max(1, 2 * source.rdd.getNumPartitions() - 1).bit_length()
    shift = 64 - bits

    def add_up(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        by_kind = {}
        for kind in (1, 2):
            mine = table.filter(pc.equal(table.column("kind"), kind))
            raw = b"".join(mine.column("keys").to_pylist())
            counts = np.frombuffer(b"".join(mine.column("counts").to_pylist()), "<u4").astype(np.int64)
            keys = _short(raw) if kind == 2 and shift >= 48 else np.frombuffer(raw, np.uint64)
            by_kind[kind] = summed(keys & np.uint64(2**48 - 1) if kind == 2 else keys, counts)
        keys, counts = by_kind[1]
        real = keys != _BEGIN
        made = [
            pa.array([part], pa.int32()),
            pa.array([keys.tobytes()], pa.binary()),
            pa.array([np.where(real, counts, -counts).astype("<i8").tobytes()], pa.binary()),
            pa.array([_built(by_kind).tobytes()], pa.binary()),
            pa.array([int(counts[real].sum())], pa.int64()),
            pa.array([int(real.sum())], pa.int64()),
        ]
        return pa.table(made, ["part", "vocabulary", "counts", "filter", "n_tokens", "n_words"])

    schema = "part int, vocabulary binary, counts binary, filter binary, n_tokens bigint, n_words bigint"
    pieces = _counted(source, shift).groupBy("part").applyInArrow(add_up, schema)
    return scratch.cut(pieces.withColumn("shift", F.lit(shift)), scratch.BATCH_BYTES)


def _short(raw: bytes) -> np.ndarray:
    """Six-byte little-endian numbers."""
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


class Model:
    """Some parts of the model: exact counts of their words, and their filters; the arrays are views of the broadcast."""

    def __init__(self, shift: int, sizes: list[tuple[int, int]], vocabulary: bytes, counts: bytes, filter: bytes):
        self.shift = np.uint64(shift)
        self._words = np.frombuffer(vocabulary, np.uint64)
        self._counts = np.frombuffer(counts, "<i8")
        self._bits = np.frombuffer(filter, np.uint8)
        parts = 1 << (64 - int(self.shift))
        self._size, self._start = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        for (part, size), start in zip(sizes, np.cumsum([0, *(size for _, size in sizes)])):
            self._size[part], self._start[part] = 8 * size, 8 * start

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Training counts of words; 0 for words of other parts or of none."""
        if not len(self._words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self._words, hashes), len(self._words) - 1)
        return np.where(self._words[at] == hashes, np.maximum(self._counts[at], 0), 0)

    def level(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        """Quantised counts: levels are probed upwards until one is missing."""
        out = np.zeros(len(hashes), np.uint8)
        part = (hashes >> self.shift).astype(np.int64)
        todo = np.flatnonzero(self._size[part] > 0)
        keys = hashes & np.uint64(2**48 - 1) if kind == 2 else hashes
        for level in range(1, MAX_LEVEL):
            size, start = self._size[part[todo]], self._start[part[todo]]
            spread = mix(keys[todo] ^ _salt(kind, level))
            first, step = spread >> np.uint64(32), (spread & np.uint64(0xFFFFFFFF)) | np.uint64(1)
            alive = np.arange(len(todo))
            for i in range(PROBES):
                at = ((first[alive] + np.uint64(i) * step[alive]) % size[alive].astype(np.uint64)).astype(np.int64) + start[alive]
                alive = alive[(self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            todo = todo[alive]
            if not len(todo):
                break
            out[todo] = level
        return out


_MODELS: dict[str, Model] = {}
_COLUMNS = ("vocabulary", "counts", "filter")


def _model(name: str, shared: dict) -> Model:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(shared["shift"], shared["sizes"], *(shared[c].value for c in _COLUMNS))
    return _MODELS[name]


def _groups(model: DataFrame, limit: int) -> list[list[int]]:
    """Parts in groups whose pieces together stay within ``limit`` bytes."""
    sizes = model.select("part", (F.octet_length("vocabulary") + F.octet_length("counts") + F.octet_length("filter")).alias("n")).orderBy("part").collect()
    groups: list[list[int]] = [[]]
    held = 0
    for row in sizes:
        if groups[-1] and held + row["n"] > limit:
            groups.append([])
            held = 0
        groups[-1].append(row["part"])
        held += row["n"]
    return groups


def _shared(model: DataFrame, parts: list[int]) -> dict:
    """A group of pieces, bounded by the caller, as one broadcast a column.

    The driver holds one column at a time, and gathers it a few parts at a time.
    """
    shared = {"shift": 63, "sizes": []}
    fetches = [some for some in _groups(model.where(F.col("part").isin(parts)), FETCHED_BYTES) if some]
    for column in _COLUMNS:
        gathered, shared["sizes"] = bytearray(), []
        for some in fetches:
            rows = model.where(F.col("part").isin(some)).select("part", "shift", column).collect()
            for row in sorted(rows, key=lambda r: r["part"]):
                shared["shift"] = row["shift"]
                shared["sizes"].append((row["part"], len(row[column])))
                gathered += row[column]
        shared[column] = model.sparkSession.sparkContext.broadcast(gathered)
    return shared


def _stored(rows: DataFrame, shared: dict) -> DataFrame:
    """The rows as a stored table; the group they were made with is taken back from driver and executors."""
    try:
        return scratch.cut(rows, scratch.BATCH_BYTES)
    finally:
        for column in _COLUMNS:
            shared[column].destroy()


def _lookups(tokens: Tokens, known: Model) -> tuple[np.ndarray, ...]:
    exact, word = known.exact(tokens.distinct), known.level(tokens.distinct, 1)
    words_level = word[tokens.codes]
    contexts = np.zeros(len(words_level), np.uint8)
    contexts[1:] = words_level[:-1]
    contexts[tokens.rows[:-1]] = known.level(np.array([_BEGIN], np.uint64), 1)[0]
    return exact[tokens.codes].astype("<i8"), words_level, contexts, known.level(tokens.pairs, 2)


def _sums(exact, words_level, contexts, pairs, firsts, n_train: int, n_words: int, prior: float):
    """Per row (beginning at ``firsts``): known tokens, base score and model score."""
    whole = n_train + n_words + 1
    count, context = TYPICAL[words_level], TYPICAL[contexts]
    own = (count + 1) / whole
    chance = (np.minimum(TYPICAL[pairs], context) + prior * own) / (context + prior)
    add = lambda x: np.add.reduceat(x, firsts)
    return add((exact > 0).astype(np.int64)), add(np.log10((exact + 1) / whole)), add(np.log10(chance))


_SCORED = "n_tokens bigint, n_known bigint, base_score double, score double"


def _scored(rows: pa.Array, bounds: np.ndarray, sums) -> pa.RecordBatch:
    known, base, score = sums
    return pa.RecordBatch.from_arrays([rows, pa.array(np.diff(bounds)), pa.array(known), pa.array(base), pa.array(score)], ["_key", "n_tokens", "n_known", "base_score", "score"])


def scored(documents: DataFrame, model: DataFrame, id: str = "doc_id", text: str = "text", limit: int = MODEL_BYTES, prior: float = PRIOR) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) per document row under a trained model."""
    totals = model.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("v")).first()
    n_train, n_words = totals["n"], totals["v"]
    groups = _groups(model, limit)
    if len(groups) == 1:
        shared, name = _shared(model, groups[0]), uuid.uuid4().hex

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text", SLICE):
                tokens = Tokens(batch.column("text"))
                found = _lookups(tokens, _model(name, shared))
                yield _scored(batch.column("_key"), tokens.rows, _sums(*found, tokens.rows[:-1], n_train, n_words, prior))

        source = documents.select(F.col(id).alias("_key"), F.col(text).alias("text"))
        made = source.mapInArrow(score, f"_key {source.schema['_key'].dataType.simpleString()}, {_SCORED}")
        return _stored(made, shared).withColumnRenamed("_key", id)

    source = documents.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id")).alias("_row"), F.col(text).alias("text"))
    key = source.schema["_row"].dataType.simpleString()

    def pass_over(parts: list[int]) -> DataFrame:
        shared, name = _shared(model, parts), uuid.uuid4().hex

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text", SLICE):
                tokens = Tokens(batch.column("text"))
                found = _lookups(tokens, _model(name, shared))
                columns = [pa.array([x[a:b].tobytes() for a, b in zip(tokens.rows[:-1], tokens.rows[1:])], pa.binary()) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], ["_row", "exact", "words", "contexts", "pairs"])

        return _stored(source.mapInArrow(look, f"_row {key}, exact binary, words binary, contexts binary, pairs binary"), shared)

    # Each token's n-grams are known to one group, so levels of all passes are united by their maximum.
    passes = None
    for parts in groups:
        looked = pass_over(parts)
        passes = looked if passes is None else passes.unionByName(looked)

    def unite(table: pa.Table) -> pa.Table:
        found = [
            np.max([np.frombuffer(x, kind) for x in table.column(c).to_pylist()], axis=0)
            for c, kind in (("exact", "<i8"), ("words", np.uint8), ("contexts", np.uint8), ("pairs", np.uint8))
        ]
        rows = table.column("_row").combine_chunks().slice(0, 1)
        bounds = np.array([0, len(found[0])])
        return pa.Table.from_batches([_scored(rows, bounds, _sums(*found, bounds[:-1], n_train, n_words, prior))])

    made = passes.groupBy("_row").applyInArrow(unite, f"_key {key}, {_SCORED}")
    return made.select(F.col("_key")["id"].alias(id), "n_tokens", "n_known", "base_score", "score")


def fold(id: str = "doc_id", folds: int = 7) -> Column:
    """The fold of a document: the checksum of its id as text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % folds

"""Array helpers on Arrow batches of texts, shared by the operators that work in Python.

Texts stay UTF-8 bytes; words are found by byte class, so one pass of numpy
serves a whole slice of documents.  A slice holds a few megabytes of text
whatever the batch size of the session, which bounds a worker's memory; a
longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

#: Byte to byte, A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space, [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins and ends; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    filled = pc.fill_null(column.cast(pa.binary()), b"")
    _, bounds, data = filled.buffers()
    if len(filled) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int32, len(filled) + 1, filled.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Adjacent pieces of ``data`` as an Arrow binary array."""
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


@dataclass(frozen=True)
class Words:
    """Words of a slice: ``codes`` into ``distinct``; words ``docs[i]:docs[i + 1]`` belong to row i."""

    codes: np.ndarray
    distinct: list[bytes]
    docs: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits for every word occurrence."""
        return self.distinct_hashes()[self.codes]

    def distinct_hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))


def words(column: pa.Array, inside: np.ndarray = NOT_SPACE, mapped: np.ndarray = LOWER, borders: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Runs of bytes for which ``inside`` holds, as ``mapped`` writes them.

    ``borders`` (a kind for every byte, and whether a byte of one kind is parted
    from the next of another) cuts runs further.
    """
    data, offsets = text_bytes(column)
    keep = inside[data]
    begins = keep.copy()
    if borders is None:
        begins[1:] &= ~keep[:-1]
    elif len(data):
        kinds, parted = borders
        kind = kinds[data]
        begins[1:] &= ~keep[:-1] | parted.ravel()[kind[:-1] * parted.shape[1] + kind[1:]]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = keep[first]
    at = np.flatnonzero(begins)
    packed = mapped[data[keep]]
    bounds = np.append(at - np.searchsorted(np.flatnonzero(~keep), at), len(packed))
    encoded = strings(packed, bounds).dictionary_encode()
    return Words(encoded.indices.to_numpy().astype(np.int64), _pieces(encoded.dictionary), np.searchsorted(at, offsets))


def _pieces(column: pa.Array) -> list[bytes]:
    data, bounds = text_bytes(column)
    raw, ends = data.tobytes(), bounds.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits (one-to-one)."""
    x = x.astype(np.uint64, copy=True)
    # Shifts and odd factors of a published 64-bit finaliser.
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column's values replaced, type kept."""
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, batch.schema.field(i), values.cast(batch.schema.field(i).type))

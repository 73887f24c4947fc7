"""Token ids as directly addressable codes: any id of a file can be read without decoding its neighbours.

An id is split into chunks of eight bits, lowest first.  Level 0 of a file has
the first chunk of every id, level 1 the second chunk of those ids that have
one, and so on.  Each level has a bitmap that says which of its ids continue;
the rank of a set bit, found in constant time from a directory, is the id's
place in the next level.

A file (``FORMAT``) is a little-endian image: a header of ``MAGIC``, the number
of levels and the number of entries of each, then per level the chunk bytes,
the bitmap in 64-bit words, the set bits before every 512 bits (32 bits each)
and those before every word within them (16 bits each).

A file of documents begins with ``FILE_MAGIC``, the ids before it in its
partition, the number of documents and the bytes of what follows: the image of
all ids, and a second image with the length of every document.

Documents are range-partitioned and sorted by id and written as files of about
``FILE_IDS`` ids: rows of a Parquet table, so that they live wherever Spark can
write.  The tokenizers library encodes each distinct part of a text once; parts
end where its pipeline parts in any case, at white space and between ASCII
letters, single digits and other characters (an apostrophe keeps the letters
behind it).  Many parts that are one pretoken each go into one call, and the ids
that end a word tell them apart again.

Defined cases: null and empty texts hold only the end id; null ids sort first;
rows that share an id follow one another by text hash, each with its own place.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegauge.llm.bpe import gathered, vocabulary_text
from tidegauge.llm.textbatch import LOWER, sliced, words

FORMAT = "directly addressable codes, 8-bit chunks"
MAGIC = 0x31434144
FILE_MAGIC = 0x464C4944
END_ID = 2
FILE_IDS = 1 << 19
#: Bytes of text encoded at a time, and ids read at a time.
SLICE = 2 << 20
BLOCK = 1 << 16
#: Parts that a worker remembers, and parts in one call of the library.
REMEMBERED = 400_000
CALL = 512

_KEEP_CASE = np.arange(256, dtype=np.uint8)


def _borders() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes, and between which the library's pipeline always parts."""
    letter, digit, other, apostrophe, beyond = range(5)
    kinds = np.full(256, other, np.uint8)
    kinds[[*range(65, 91), *range(97, 123)]] = letter
    kinds[48:58] = digit
    kinds[ord("'")] = apostrophe
    kinds[128:] = beyond
    parted = np.zeros((5, 5), bool)
    parted[:beyond, :beyond] = True
    parted[letter, letter] = False
    parted[np.ix_((other, apostrophe), (other, apostrophe))] = False
    parted[apostrophe, letter] = False
    return kinds, parted


_BORDERS = _borders()


def pack(ids: np.ndarray) -> bytes:
    """The file image of an array of ids below 2^32."""
    rest = ids.astype(np.uint32)
    counts, bodies = [], []
    while len(rest) or not counts:
        chunks = (rest & np.uint32(255)).astype(np.uint8)
        more = rest >> np.uint32(8)
        goes_on = more > 0
        bits = np.zeros(-(-len(rest) // 512) * 512, bool)
        bits[: len(rest)] = goes_on
        bitmap = np.packbits(bits, bitorder="little").view(np.uint64)
        set_bits = np.bitwise_count(bitmap).astype(np.int64).reshape(-1, 8)
        blocks = np.concatenate(([0], np.cumsum(set_bits.sum(axis=1))))[:-1].astype(np.uint32)
        inside = (np.cumsum(set_bits, axis=1) - set_bits).astype(np.uint16)
        counts.append(len(rest))
        bodies += [chunks.tobytes().ljust(-(-len(rest) // 8) * 8, b"\0"), bitmap.tobytes(), blocks.tobytes(), inside.tobytes()]
        rest = more[goes_on]
        if not len(rest):
            break
    return np.array([MAGIC, len(counts), *counts], np.uint64).tobytes() + b"".join(bodies)


class Reader:
    """Random access to a file image."""

    def __init__(self, image: bytes):
        header = np.frombuffer(image, np.uint64, 2)
        if header[0] != MAGIC:
            raise ValueError("not an id file")
        counts = np.frombuffer(image, np.uint64, int(header[1]), 16).astype(np.int64)
        at = 16 + 8 * len(counts)
        self._levels = []
        for n in counts:
            blocks = -(-int(n) // 512)
            parts = []
            for kind, size in ((np.uint8, int(n)), (np.uint64, 8 * blocks), (np.uint32, blocks), (np.uint16, 8 * blocks)):
                parts.append(np.frombuffer(image, kind, size, at))
                at += -(-size // 8) * 8 if kind is np.uint8 else size * np.dtype(kind).itemsize
            self._levels.append(parts)
        self.length = int(counts[0])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        out = np.zeros(len(places), np.uint32)
        todo, at = np.arange(len(places)), np.asarray(places, np.int64)
        for level, (chunks, bitmap, blocks, inside) in enumerate(self._levels):
            out[todo] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            word, bit = bitmap[at >> 6], (at & 63).astype(np.uint64)
            goes_on = (word >> bit) & np.uint64(1) > 0
            todo, at, word, bit = todo[goes_on], at[goes_on], word[goes_on], bit[goes_on]
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            at = blocks[at >> 9].astype(np.int64) + inside[at >> 6] + below
            if not len(todo):
                break
        return out


def pack_file(before: int, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The image of a file of documents."""
    content = pack(ids)
    return np.array([FILE_MAGIC, before, len(lengths), len(content)], np.uint64).tobytes() + content + pack(lengths)


class IdFile:
    """A file of documents: ids anywhere, and where each document begins."""

    def __init__(self, image: bytes):
        magic, before, count, size = (int(x) for x in np.frombuffer(image, np.uint64, 4))
        if magic != FILE_MAGIC:
            raise ValueError("not a file of documents")
        self.before, self.documents = before, count
        self.ids, self._lengths = Reader(image[32 : 32 + size]), Reader(image[32 + size :])

    def bounds(self) -> np.ndarray:
        """The first id of every document, with the end."""
        return np.concatenate(([0], np.cumsum(self._lengths.get(np.arange(self.documents)).astype(np.int64))))


class WordEncoder:
    """The library's tokenizer, asked once per distinct part."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_str(file)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        vocabulary = json.loads(file)["model"]["vocab"]
        self._ends_word = np.zeros(self._tokenizer.get_vocab_size() + 1, bool)
        self._ends_word[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, each followed by the end id, and the first id of each row (with the end)."""
        # The library writes letters in lower case itself, but only after it has cut out its special tokens.
        special = pc.any(pc.match_substring(column, "<|")).as_py()
        found = words(column, mapped=_KEEP_CASE) if special else words(column, borders=_BORDERS)
        pieces = [*self._ids(found.distinct, cut=not special), array("I", [END_ID]).tobytes()]
        flat, ends = np.frombuffer(b"".join(pieces), np.uint32), np.cumsum([0, *map(len, pieces)]) // 4
        codes = np.insert(found.codes, found.docs[1:], len(pieces) - 1)
        ids, positions = gathered(flat, ends, codes)
        return ids, positions[found.docs + np.arange(len(found.docs))]

    def _ids(self, distinct: list[bytes], cut: bool) -> list[bytes]:
        if len(self._known) > REMEMBERED // 2:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        out = [*map(known.get, distinct)]
        missing = [w for w, ids in zip(distinct, out) if ids is None]
        # Parts still in use outlive the older half.
        made = {w: older[w] for w in missing if w in older}
        single, other = [], []
        for w in missing:
            if w not in older:
                (single if w.isalpha() or (cut and w.isascii() and b"'" not in w) or w.decode().isalpha() else other).append(w)
        groups = [single[i : i + CALL] for i in range(0, len(single), CALL)]
        for group, encoding in zip(groups, self._batch([b" ".join(g).decode() for g in groups])):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self._ends_word[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                # Lower case or composition made something else of a part.
                other += group
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            made.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        if other:
            made.update((w, array("I", e.ids).tobytes()) for w, e in zip(other, self._batch([w.decode() for w in other])))
        known.update(made)
        return [made[w] if ids is None else ids for w, ids in zip(distinct, out)]

    def _batch(self, texts: list[str]):
        return self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(name: str, shared) -> WordEncoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = WordEncoder(shared.value)
    return _ENCODERS[name]


def write(documents: DataFrame, path: str, vocabulary: str, id: str = "doc_id", text: str = "text") -> None:
    """Files of ids in ascending document order, a Parquet row each.

    A row has the partition (``part``, in document order), the documents' ids,
    how many token ids the file holds, and its image.
    """
    content = vocabulary_text(vocabulary)
    name = hashlib.sha256(content.encode()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(content)
    keyed = documents.select(F.col(id).alias("doc"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("text"))
    # The hash and row number let a range boundary fall between rows that share an id.
    ordered = keyed.repartitionByRange("doc", "_h", "_row").sortWithinPartitions("doc", "_h", "_row")
    source = ordered.select(F.spark_partition_id().alias("part"), "doc", "text")
    kind = source.schema["doc"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, docs, lengths, parts, held = 0, [], [], [], 0

        def flush(part: pa.Scalar, kept: pa.DataType) -> pa.RecordBatch:
            image = pack_file(before, np.concatenate(parts), np.concatenate(lengths))
            columns = [
                pa.array([part], pa.int32()), pa.array([pa.concat_arrays(docs).to_pylist()], pa.list_(kept)), pa.array([held], pa.int64()), pa.array([image], pa.binary())
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "docs", "n_ids", "image"])

        part = kept = None
        for batch in sliced(batches, "text", SLICE):
            ids, bounds = _encoder(name, shared).encode(batch.column("text"))
            part, kept = batch.column("part")[0].as_py(), batch.column("doc").type
            docs.append(batch.column("doc"))
            lengths.append(np.diff(bounds))
            parts.append(ids)
            held += len(ids)
            if held >= FILE_IDS:
                yield flush(part, kept)
                before, docs, lengths, parts, held = before + held, [], [], [], 0
        if held:
            yield flush(part, kept)

    made = f"part int, docs array<{kind}>, n_ids bigint, image binary"
    source.mapInArrow(encode, made).write.mode("error").parquet(path)


def _checksums(file: IdFile, bounds: np.ndarray) -> Iterator[int]:
    """CRC-32 of the ids of each document, read for some documents at a time."""
    i = 0
    while i < file.documents:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, side="right")) - 1)
        raw = memoryview(file.ids.get(np.arange(bounds[i], bounds[j])).astype("<u4").tobytes())
        at = 4 * (bounds[i : j + 1] - bounds[i])
        yield from (zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:]))
        i = j


def read(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """Per document of the files: its id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per partition that was written.
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    source = files.join(F.broadcast(starts), "part").select("part_start", "docs", "image")
    kind = source.schema["docs"].dataType.elementType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = IdFile(batch.column("image")[i].as_py())
                bounds = file.bounds()
                crcs = np.fromiter(_checksums(file, bounds), np.int64, file.documents)
                starts = batch.column("part_start")[i].as_py() + file.before + bounds[:-1]
                columns = [batch.column("docs")[i].values, *(pa.array(c, pa.int64()) for c in (starts, np.diff(bounds), crcs))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "n_tokens", "ids_crc32"])

    return source.mapInArrow(digest, f"doc {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("doc", id)

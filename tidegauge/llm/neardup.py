"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidates.

A document's set holds the 64-bit hashes of its distinct five-word shingles
(A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``; with fewer words the whole
sequence is the one shingle).  Two documents are linked if the intersection of
their full sets is at least ``threshold`` per cent of the union.

1. Texts with the same words are one class; only its smallest id goes on.
2. One hash per shingle fills ``BINS`` bins (top bits choose the bin, the
   smallest value stays).  An empty bin takes the value of the first filled bin
   in an order of its own (optimal densification), so that any two sets agree
   in a bin with the probability of their similarity.
3. ``BANDS`` bands of ``ROWS`` bins are bucket keys.  At similarity 0.75 two
   sets share no bucket with probability 5e-6.
4. In each bucket every member is compared with the smallest member only: a
   star, so pairs never outnumber bucket rows.  Pairs are confirmed on full sets.
5. A link between two members that the star's centre does not tie together
   would be lost, so in buckets with members of different components all such
   members are compared by sketch: ``SKETCH`` bins, not densified, four bits of
   each and whether it is filled, as bit planes.
   First each member meets the earlier member most like it, which leaves few
   components; then all remaining pairs whose sketches allow the similarity are
   confirmed.  Of a union of U shingles the E filled bins show E drawn without
   replacement, so equal bins are hypergeometric; what is confirmed begins 5.5
   standard deviations below the threshold (a pair there falls short with
   probability 2e-8) and, with few shingles unseen, at the least possible count.
   The recall of this step is that of the bands.  Large buckets are dealt out in
   tiles of two blocks of ``BLOCK`` members; nobody is left out.

Sets are made from the text when a pair is to be confirmed and travel to the
pair's centre; a centre with many members is dealt out in chunks of
``CHUNK`` members, and a task streams its rows holding one centre at a time.
Every step in Python is stored at once, with Arrow batches of a few megabytes.

Defined cases: null and empty texts have an empty set and are linked with
nothing; rows that share an id are the same document and get one component;
a null id is never linked and its row is kept; repeated rows are each returned;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.components import components
from tidegauge.llm.lookups import free_name, looked_up
from tidegauge.llm.textbatch import mix, sliced, words
from tidegauge.plans import scratch

SHINGLE = 5
THRESHOLD = 75
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
CHUNK = 256
#: Bytes of text worked on at a time; a worker keeps the memory of its largest slice.
SLICE = 1 << 20
#: Members of a mixed bucket in a block, bins of a sketch, and pairs compared at a time.
BLOCK = 4096
SKETCH = 512
SLAB = 1 << 16
#: Ids that may be broadcast (16 bytes each in the hashed relation); more are shuffled.
BROADCAST_IDS = 2_000_000

_EMPTY = np.uint64(2**64 - 1)


def shingles(column: pa.Array) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For each text the digest of its words (none: None) and its sorted distinct shingle hashes."""
    found = words(column)
    hashes = found.hashes()
    windows = mix(hashes)
    for step in range(1, SHINGLE):
        windows = mix(windows[: len(windows) - 1] * np.uint64(3) + hashes[step:]) if len(windows) > 1 else windows[:0]
    for first, last in zip(found.docs[:-1], found.docs[1:]):
        n = int(last - first)
        if not n:
            yield None, np.zeros(0, np.uint64)
            continue
        digest = xxhash.xxh3_128_digest(hashes[first:last].tobytes())
        if n < SHINGLE:
            yield digest, np.array([xxhash.xxh3_64_intdigest(digest)], np.uint64)
        else:
            yield digest, np.unique(windows[first : last - SHINGLE + 1])


def _orders() -> np.ndarray:
    """For each bin, the other bins in a pseudo-random order of its own."""
    grid = np.arange(BINS, dtype=np.uint64)
    keys = mix(grid[:, None] * np.uint64(BINS) + grid[None, :] + np.uint64(1))
    np.fill_diagonal(keys, 0)
    return np.argsort(keys, axis=1, kind="stable")[:, 1:]


_ORDERS = _orders()


def signature(hashes: np.ndarray) -> np.ndarray:
    """One value per bin of a sorted, non-empty set."""
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    values = np.full(BINS, _EMPTY)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values[bins[first]] = hashes[first]
    empty = np.flatnonzero(values == _EMPTY)
    if len(empty):
        filled = values != _EMPTY
        donors = _ORDERS[empty]
        values[empty] = values[donors[np.arange(len(empty)), np.argmax(filled[donors], axis=1)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket key per band."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(5) + column)
    return keys.view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """Bit planes of a sorted set's bins: the low four bits of the smallest value, and whether there is one."""
    bins = (hashes >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64)
    values = np.zeros(SKETCH, np.uint8)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values[bins[first]] = (hashes[first] & np.uint64(15)).astype(np.uint8) | 16
    return np.packbits(values[None, :] >> np.arange(5, dtype=np.uint8)[:, None] & 1, axis=1).tobytes()


def signatures(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, n_shingles, keys, sketch) per document row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            digests, sizes, keys, sketches = [], [], [], []
            for digest, hashes in shingles(batch.column("text")):
                digests.append(digest)
                sizes.append(len(hashes))
                keys.append(band_keys(signature(hashes)) if len(hashes) else None)
                sketches.append(sketch(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc", "digest", "n_shingles", "keys", "sketch"],
            )

    source = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(sign, f"doc {kind}, digest binary, n_shingles bigint, keys array<bigint>, sketch binary")


def _chunks(pairs: DataFrame) -> DataFrame:
    """Who goes where: (doc, centre, chunk, member), the centre itself once to each of its chunks."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    count = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("b"), F.col("count")).cast("int")
    counted = pairs.join(sizes.select("a", count.alias("count")), "a")
    members = counted.select(F.col("b").alias("doc"), F.col("a").alias("centre"), chunk.alias("chunk"), F.lit(True).alias("member"))
    each = F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("chunk")
    centres = sizes.select(F.col("a").alias("doc"), F.col("a").alias("centre"), count.alias("count")).select("doc", "centre", each, F.lit(False).alias("member"))
    return members.unionByName(centres)


def _small(ids: DataFrame) -> DataFrame:
    """A table of ids with a broadcast hint if it is known to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def linked(documents: DataFrame, pairs: DataFrame, id: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """Those pairs (a, b) of ids whose full sets are similar enough."""
    places = scratch.cut(_chunks(pairs))
    wanted = scratch.cut(places.select("doc").distinct())
    source = documents.select(F.col(id).alias("doc"), F.col(text).alias("text")).join(_small(wanted), "doc")
    kind = source.schema["doc"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            made = pa.array([hashes.tobytes() for _, hashes in shingles(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), made], ["doc", "hashes"])

    rows = source.mapInArrow(sets, f"doc {kind}, hashes binary").join(places, "doc").select("centre", "chunk", "member", "doc", "hashes")
    dealt = rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "member")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre_sets = None, []
        for batch in batches:
            a, b = [], []
            for centre, chunk, member, doc, raw in zip(*(batch.column(n).to_pylist() for n in ("centre", "chunk", "member", "doc", "hashes"))):
                hashes = np.frombuffer(raw, np.uint64)
                if at != (centre, chunk):
                    at, centre_sets = (centre, chunk), []
                if not member:
                    centre_sets.append(hashes)
                elif any(_similar(hashes, other, threshold) for other in centre_sets):
                    a.append(centre)
                    b.append(doc)
            kept = batch.schema.field("doc").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kept), pa.array(b, kept)], ["a", "b"])

    return dealt.mapInArrow(confirm, f"a {kind}, b {kind}")


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    least, most = sorted((len(x), len(y)))
    if 100 * least < threshold * most:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (least + most - common)


def _alike(a: Column, b: Column, threshold: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component, kept) per document row; the component is the smallest id that links reach."""
    signed = scratch.cut(signatures(documents, id, text), scratch.BATCH_BYTES)
    with_id = signed.where("doc IS NOT NULL AND digest IS NOT NULL")
    classes = scratch.cut(
        with_id.groupBy("digest").agg(
            F.min("doc").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
        )
    )
    copied = looked_up(with_id.select("doc", "digest"), "digest", classes.select("digest", "rep"))
    copies = copied.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    rows = classes.select("rep", "n", F.explode("keys").alias("key"))
    buckets = scratch.cut(
        rows.join(rows.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("_top")).where("centre < _top").drop("_top"), "key")
    )
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    stars = buckets.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"), "n").distinct()
    candidates = stars.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a").where(_alike(F.col("n"), F.col("n_a"), threshold))
    links = scratch.cut(linked(documents, candidates.select("a", "b"), id, text, threshold), scratch.BATCH_BYTES)
    links = _rest(documents, classes, buckets, links, id, text, threshold)
    roots = components(links.unionByName(copies))
    known = signed.where("doc IS NOT NULL").join(roots, F.col("doc") == F.col("node"), "left")
    # Rows without an id match nothing and stay where they are.
    rest = signed.where("doc IS NULL").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in roots.schema])
    found = known.unionByName(rest).select(F.col("doc").alias(id), "n_shingles", F.coalesce("root", "doc").alias("component"))
    return found.withColumn("kept", F.col(id).eqNullSafe(F.col("component")))


def _rest(documents: DataFrame, classes: DataFrame, buckets: DataFrame, links: DataFrame, id: str, text: str, threshold: int) -> DataFrame:
    """The links, with those that the first stars could not see."""
    roots = components(links)
    rows = _mixed(buckets.select("rep", "n", "key"), roots).join(classes.select("rep", "sketch", "keys"), "rep")
    for best in (True, False):
        rows = scratch.cut(_mixed(rows, roots))
        pairs = scratch.cut(_compared(rows, threshold, best), scratch.BATCH_BYTES)
        if pairs.isEmpty():
            return links
        links = scratch.cut(links.unionByName(linked(documents, pairs, id, text, threshold)), scratch.BATCH_BYTES)
        if best:
            roots = components(links)
    return links


def _compared(rows: DataFrame, threshold: int, best: bool) -> DataFrame:
    """(a, b), a < b, of all members of a bucket that are in different components and of like size and sketch.

    With ``best`` only the likest earlier member for each member and tile; otherwise
    a pair is given by the first of the buckets that it shares.
    """
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), count).cast("int")
    placed = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    tile = F.xxhash64("key", F.greatest("block", "other"), F.least("block", "other")).alias("tile")
    whole, late = (F.col("block") == F.col("other")).alias("whole"), (F.col("block") >= F.col("other")).alias("late")
    dealt = placed.select(tile, whole, late, "key", "rep", "n", "root", "sketch", "keys").repartition("tile").sortWithinPartitions("tile", "late", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unbroken(batches, "tile"):
            tiles, whole, late, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "whole", "late", "n"))
            root = batch.column("root").dictionary_encode().indices.to_numpy()
            planes = _planes(batch.column("sketch").to_pylist())
            key, keys = batch.column("key").to_numpy(), batch.column("keys").flatten().to_numpy().reshape(-1, BANDS)
            at = np.arange(len(tiles))
            first = np.append(True, tiles[1:] != tiles[:-1])
            number = np.cumsum(first) - 1
            start = np.flatnonzero(first)[number]
            early = np.bincount(number, ~late)[number].astype(np.int64)
            before = np.append(0, np.cumsum(np.where(whole, at - start, np.where(late, early, 0))))
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(before, before[i] + SLAB, side="right")) - 1)
                a = np.repeat(at[i:j], np.diff(before[i : j + 1]))
                b = start[a] + np.arange(before[i], before[j]) - before[a]
                i = j
                n_a, n_b = sizes[a], sizes[b]
                kept = (root[a] != root[b]) & (100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b))
                a, b = a[kept], b[kept]
                equal, filled = _agreement(planes, a, b)
                kept = equal >= _least(filled, sizes[a] + sizes[b], threshold)
                a, b, share = a[kept], b[kept], equal[kept] / filled[kept]
                if best:
                    order = np.lexsort((b, -share, a))
                    order = order[np.unique(a[order], return_index=True)[1]]
                    a, b = a[order], b[order]
                else:
                    shared = keys[a] == keys[b]
                    here = keys[a, shared.argmax(axis=1)] == key[a]
                    kept = here | ~shared.any(axis=1)
                    a, b = a[kept], b[kept]
                if len(a):
                    rep = batch.column("rep")
                    yield pa.RecordBatch.from_arrays([rep.take(pa.array(a)), rep.take(pa.array(b))], ["a", "b"])

    kind = rows.schema["rep"].dataType.simpleString()
    met = dealt.mapInArrow(compare, f"a {kind}, b {kind}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unbroken(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The sorted rows again, those of one value of ``column`` in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        if held and held[-1].column(column)[-1].as_py() != values[0]:
            yield pa.concat_batches(held)
            held = []
        ends = np.flatnonzero(values[1:] != values[:-1]) + 1
        if len(ends):
            yield pa.concat_batches([*held, batch.slice(0, ends[-1])])
            held = []
        held.append(batch.slice(ends[-1] if len(ends) else 0))
    if held:
        yield pa.concat_batches(held)


def _planes(sketches: list[bytes]) -> np.ndarray:
    """(plane, word, row) of sketches."""
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, 5, SKETCH // 64).transpose(1, 2, 0).copy()


def _agreement(planes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many bins the sketches a and b are equal, of how many that either fills."""
    differ = np.zeros((SKETCH // 64, len(a)), np.uint64)
    for plane in planes:
        left, right = plane[:, a], plane[:, b]
        differ |= left ^ right
    filled = np.bitwise_count(left | right).sum(axis=0, dtype=np.int64)
    return filled - np.bitwise_count(differ).sum(axis=0, dtype=np.int64), filled


def _least(filled: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Equal bins without which a pair is not confirmed, by the filled bins and the sum of the set sizes."""
    share = threshold / 100
    union = sizes / (1 + share)
    unseen = np.maximum(union - filled, 0)
    deviation = np.sqrt(share * (1 - share) * unseen * np.minimum(filled / union, 1))
    return share * filled - np.minimum((1 - share) * unseen, 5.5 * deviation) - 1e-6


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets whose members are in different components, with the component ``root`` and the bucket's ``members``."""
    rows = rows.drop("root", "members")
    known = rows.join(roots, rows["rep"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "rep"))
    buckets = known.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("members"))
    return known.join(buckets.where("_low < _high").select("key", "members"), "key")


def deduplicated(documents: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents, all columns, with one row of each group: that of the smallest id.

    Rows that share an id stay together.
    """
    found = near_duplicates(documents, id, text, threshold)
    name = free_name("_gone", documents.columns)
    gone = found.where(~F.col("kept")).select(F.col(id).alias(name)).distinct()
    return documents.join(_small(scratch.cut(gone)), F.col(id) == F.col(name), "left_anti")

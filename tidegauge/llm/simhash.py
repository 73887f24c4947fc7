"""Near-duplicate documents by SimHash, compared bit by bit over vertically stored planes.

A document's features are its runs of ``SHINGLE`` words, repeats included (A-Z
in lower case, words ``[^\\x20\\x09-\\x0D]+``; with fewer words the whole
sequence is the one feature).  A bit of the fingerprint is set if it is set in
over half of the features' 64-bit hashes.  Documents whose fingerprints differ
in at most ``radius`` bits are linked.

1. Equal fingerprints are one class, so copies cost one row from here on.
2. The 64 bits are cut into ``radius + 1`` parts; fingerprints within the radius
   agree in one of them.  Each part is a bucket key.
3. A bucket too large for one task is cut again: its members differ only in the
   other bits, which are cut into ``radius + 1`` parts in turn.  This goes on
   until every bucket fits; with few free bits a bucket cannot be large, as its
   fingerprints are distinct.  No pair is lost at any depth.
4. In a bucket the fingerprints are stored as bit planes, 64 rows to a word.
   A row is compared with the words behind it: each plane adds one bit to all 64
   distances by carry-save counters, a row that exceeds the radius stays out,
   and a word is abandoned once all its rows do.
5. A bucket returns its links as a star for each group it ties together, so they
   never outnumber its rows.  Components of the stars are those of all links.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; rows that share an id are the same document; a null id is never
linked and has a null component, its row is kept; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.components import components
from tidegauge.llm.lookups import looked_up
from tidegauge.llm.textbatch import NOT_SPACE, sliced
from tidegauge.llm.wordspans import laid_out, span_hashes
from tidegauge.plans import scratch

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Rows of a bucket that are compared at once; larger ones are cut by further bits, in Spark or within the task.
BUCKET = 4096
#: (row, word) comparisons held at a time, and planes between two looks at what can be abandoned.
SLAB = 1 << 16
STRIDE = 8

_BYTE_LANES = np.uint64(0x0101010101010101)


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One fingerprint per text."""
    laid = laid_out(column, NOT_SPACE)
    starts, ends, bounds = laid.runs(shingle)
    hashes = span_hashes(laid.data, starts, ends, seed)
    set_bits = bit_counts(hashes, bounds)
    n = np.diff(bounds)
    # Texts of fewer words are one feature.
    words = np.diff(laid.docs)
    short = np.flatnonzero((words > 0) & (words < shingle))
    if len(short):
        whole = span_hashes(laid.data, laid.starts[laid.docs[short]], laid.ends[laid.docs[short + 1] - 1], seed)
        set_bits[short] = np.unpackbits(whole.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n[short] = 1
    return np.packbits(2 * set_bits > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many values of each row have each bit, (rows, 64).

    Eight counters of a byte each fit a word, so up to 255 values are summed in eight additions.
    """
    rows = len(bounds) - 1
    counts = np.zeros((rows, BITS), np.int64)
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled):
        return counts
    pieces = -(-np.diff(bounds)[filled] // 255)
    first = np.concatenate(([0], np.cumsum(pieces)))
    inside = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
    cuts = np.repeat(bounds[:-1][filled], pieces) + 255 * inside
    for lane in range(8):
        sums = np.add.reduceat((values >> np.uint64(lane)) & _BYTE_LANES, cuts)
        by_byte = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
        counts[filled, lane::8] = by_byte
    return counts


def signed(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc, fingerprint) per document row; the fingerprint's 64 bits as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = fingerprints(batch.column("text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found.view(np.int64))], ["doc", "fingerprint"])

    rows = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, f"doc {rows.schema['doc'].dataType.simpleString()}, fingerprint bigint")


def parts(free: int, radius: int) -> list[int]:
    """The bits of ``free`` in ``radius + 1`` masks of nearly equal size."""
    bits = [i for i in range(BITS) if free >> i & 1]
    n = radius + 1
    return [sum(1 << i for i in bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]


def _bigint(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _split(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Rows of buckets fixed by any of ``masks``, dealt into the buckets that fix one more part."""
    finer = F.create_map(*[x for m in masks for x in (F.lit(_bigint(m)), F.array(*[F.lit(_bigint(m | p)) for p in parts(~m & (1 << BITS) - 1, radius)]))])
    return rows.select("fingerprint", "rep", F.explode(finer[F.col("fixed")]).alias("fixed"))


def linked_classes(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the ``rep`` of classes (fingerprint, rep), fingerprints distinct: stars with the components of all links."""
    key = [F.col("fixed"), F.col("fingerprint").bitwiseAND(F.col("fixed")).alias("value")]
    spark = classes.sparkSession
    # With no more free bits than the radius a bucket cannot be cut, but holds at most so many distinct rows.
    bucket = max(bucket, 1 << radius)
    masks = [0]
    open_rows = classes.select("fingerprint", "rep", F.lit(0).cast("long").alias("fixed"))
    ready = []
    while masks:
        # Buckets of this depth; those above an average task are few and go one level deeper.
        rows = scratch.cut(_split(open_rows, masks, radius))
        masks = [m | p for m in masks for p in parts(~m & (1 << BITS) - 1, radius)]
        counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        top = counts.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
        limit = max(bucket, (top["total"] or 0) // int(spark.conf.get("spark.sql.shuffle.partitions")))
        heavy = counts.where(F.col("n") > limit).collect() if (top["top"] or 0) > limit else []
        if not heavy:
            ready.append(rows)
            break
        # Never more heavy buckets than shuffle partitions.
        named = F.broadcast(spark.createDataFrame([(r["fixed"], r["value"]) for r in heavy], "fixed bigint, value bigint"))
        keyed = rows.select("fingerprint", "rep", *key)
        ready.append(keyed.join(named, ["fixed", "value"], "left_anti").select("fingerprint", "rep", "fixed"))
        open_rows = keyed.join(named, ["fixed", "value"], "left_semi").select("fingerprint", "rep", "fixed")
        used = {r["fixed"] for r in heavy}
        masks = [m for m in masks if _bigint(m) in used]
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.select("fingerprint", "rep", *key).repartition("fixed", "value").sortWithinPartitions("fixed", "value")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            values = rows.column("fingerprint").to_numpy().view(np.uint64)
            fixed, value = (rows.column(c).to_numpy() for c in ("fixed", "value"))
            first = np.flatnonzero(np.append(True, (fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])))
            labels = stars(values, fixed.view(np.uint64), np.append(first, len(values)), radius, bucket)
            tied = np.flatnonzero(labels != np.arange(len(labels)))
            if len(tied):
                rep = rows.column("rep")
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(labels[tied])), rep.take(pa.array(tied))], ["a", "b"])

    kind = classes.schema["rep"].dataType.simpleString()
    return dealt.mapInArrow(link, f"a {kind}, b {kind}")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows again, every bucket in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        fixed, value = (batch.column(c).to_numpy() for c in ("fixed", "value"))
        if held and (held[-1].column("fixed")[-1].as_py(), held[-1].column("value")[-1].as_py()) != (fixed[0], value[0]):
            yield pa.concat_batches(held)
            held = []
        edges = np.flatnonzero((fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])) + 1
        if len(edges):
            yield pa.concat_batches([*held, batch.slice(0, edges[-1])])
            held = []
        held.append(batch.slice(edges[-1] if len(edges) else 0))
    if held:
        yield pa.concat_batches(held)


def stars(values: np.ndarray, fixed: np.ndarray, bounds: np.ndarray, radius: int, bucket: int = BUCKET) -> np.ndarray:
    """For each fingerprint the first row of the group that links tie it to, bucket by bucket (``bounds``)."""
    labels = np.arange(len(values))
    sizes = np.diff(bounds)
    for i in np.flatnonzero(sizes > bucket):
        some = np.arange(bounds[i], bounds[i + 1])
        # Further parts of the free bits, within the task.
        for mask in parts(~int(fixed[bounds[i]]) & (1 << BITS) - 1, radius):
            order = some[np.argsort(values[some] & np.uint64(mask), kind="stable")]
            cuts = np.flatnonzero(np.diff(values[order] & np.uint64(mask))) + 1
            inner = stars(values[order], fixed[order] | np.uint64(mask), np.concatenate(([0], cuts, [len(order)])), radius, bucket)
            _tie(labels, order, order[inner])
    usual = (sizes > 1) & (sizes <= bucket)
    if usual.any():
        rows = np.flatnonzero(np.repeat(usual, sizes))
        kept = np.concatenate(([0], np.cumsum(sizes[usual])))
        for a, b in close(values[rows], kept, radius):
            _tie(labels, rows[a], rows[b])
    return labels


def close(values: np.ndarray, bounds: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket within the radius, some at a time."""
    n = len(values)
    words = -(-n // 64)
    padded = np.zeros(64 * words, np.uint64)
    padded[:n] = values
    # Plane k holds bit k of all rows, 64 rows to a word.
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    rows = np.arange(n)
    count = np.where(ends > rows + 1, ((ends - 1) >> 6) - ((rows + 1) >> 6) + 1, 0)
    before = np.concatenate(([0], np.cumsum(count)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(before, before[i] + SLAB, side="right")) - 1)
        row = np.repeat(rows[i:j], count[i:j])
        word = np.arange(before[i], before[j]) - before[row] + ((row + 1) >> 6)
        i = j
        # Rows up to the compared one and beyond its bucket are out from the start.
        low = np.clip(row + 1 - 64 * word, 0, 63).astype(np.uint64)
        high = np.clip(ends[row] - 64 * word, 1, 64).astype(np.uint64)
        every = np.uint64(2**64 - 1)
        out = ~((every << low) & (every >> (np.uint64(64) - high)))
        counters = [np.zeros(len(row), np.uint64) for _ in range(radius.bit_length())]
        mine = values[row]
        for k in range(BITS):
            carry = planes[k][word] ^ -(mine >> np.uint64(k) & np.uint64(1))
            for place, counter in enumerate(counters):
                counters[place], carry = counter ^ carry, counter & carry
            # Beyond the counters' range, or above the radius within it.
            out |= carry | _above(counters, radius)
            if k % STRIDE == STRIDE - 1:
                alive = out != every
                if not alive.all():
                    row, word, mine, out = row[alive], word[alive], mine[alive], out[alive]
                    counters = [c[alive] for c in counters]
                    if not len(row):
                        break
        if len(row):
            hit = np.unpackbits((~out).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(hit)
            yield row[at], 64 * word[at] + bit


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Rows whose bit-sliced count is above the radius."""
    above, equal = np.uint64(0), np.uint64(2**64 - 1)
    for place in range(len(counters) - 1, -1, -1):
        if radius >> place & 1:
            equal = equal & counters[place]
        else:
            above = above | equal & counters[place]
            equal = equal & ~counters[place]
    return above | np.zeros_like(counters[0])


def _tie(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make every pair's labels equal, the smaller row number of each group."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fingerprint, component) per document row; the component is the smallest id that links reach."""
    rows = scratch.cut(signed(documents, id, text, shingle, seed))
    classes = scratch.cut(rows.where("doc IS NOT NULL").groupBy("fingerprint").agg(F.min("doc").alias("rep")))
    # An id with several texts ties their classes together.
    known = rows.where("doc IS NOT NULL").select("doc", "fingerprint").distinct()
    several = known.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    shared = looked_up(known.join(several, "doc", "left_semi"), "fingerprint", classes).select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    roots = components(linked_classes(classes, radius).unionByName(shared))
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "rep").alias("component"))
    found = looked_up(rows, "fingerprint", scratch.cut(named), "left")
    return found.select(F.col("doc").alias(id), "fingerprint", F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))

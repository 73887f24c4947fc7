"""Importance resampling: documents drawn so that their n-grams look like those of a target.

Runs of 1 to ``max_n`` words, repeats counted, are dealt into ``buckets`` by the
CRC-32 of their bytes.  A bucket's gain is the smoothed log ratio of its share in
the target and in the source, in thousandths; a document's weight is the floored
mean gain of its features.  Gumbel noise from a hash of the document id makes the
highest scores a sample without replacement, proportional to the weights.

N-grams of a batch of texts are interned in an open-addressed table of NumPy
arrays: places are found from XXH64, the bytes decide whether two n-grams are the
same, and the entries hold bucket and count.  The entry number of every
occurrence then gathers its gain.  CRC-32 is taken once for each entry.

Counts of buckets are the only thing that reaches the driver (two vectors of
``buckets`` numbers), and with them the histogram of whole-numbered scores; gains
go back as one broadcast vector.  Texts are read twice, nothing about them is
shuffled.  Only the drawn rows are sorted, by range.

Defined cases: null and empty texts have no features and weight 0; a null id
draws its noise from the empty text and loses ties; rows that share an id are
drawn for themselves; an empty target or source gives smoothed gains as the
formula says; other columns are left alone.  A text of any length is a batch of
its own: memory is a few times its size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.textbatch import sliced
from tidegauge.llm.wordspans import WORDLIKE, laid_out, span_hashes
from tidegauge.plans import scratch

MAX_N = 1
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 10
SEED = 2024
#: Occurrences interned at a time; the table grows before it is half full.
BLOCK = 1 << 17


class Interned:
    """Open-addressed table of byte spans of one buffer; entries have ``bucket`` and ``count``."""

    def __init__(self, data: np.ndarray, buckets: int):
        self._data, self._buckets = data, buckets
        self._slots = np.full(1 << 16, -1, np.int64)
        self._keys = np.zeros(0, np.uint64)
        self._starts = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)
        self.bucket = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def add(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every span, new ones included; ``starts`` ascend."""
        out = [self._added(starts[i : i + BLOCK], ends[i : i + BLOCK]) for i in range(0, len(starts), BLOCK)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _added(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reserve(len(starts))
        known = len(self._keys)
        keys, sizes = span_hashes(self._data, starts, ends), ends - starts
        all_keys, all_starts, all_sizes = (np.concatenate(p) for p in ((self._keys, keys), (self._starts, starts), (self._sizes, sizes)))
        mask = np.int64(len(self._slots) - 1)
        place = keys.view(np.int64) & mask
        entry = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        while len(todo):
            at = place[todo]
            free = self._slots[at] < 0
            # Of those that want one free slot, one gets it; the others look at it again.
            self._slots[at[free]] = known + todo[free]
            held = self._slots[at]
            same = all_keys[held] == keys[todo]
            same[same] = self._equal(all_starts, all_sizes, held[same], known + todo[same])
            entry[todo[same]] = held[same]
            todo = todo[~same]
            place[todo] = (place[todo] + 1) & mask
        # Entries are numbered in the order of their slots' owners, without gaps.
        owners = np.unique(entry[entry >= known])
        number = np.append(np.arange(known), np.zeros(len(keys), np.int64))
        number[owners] = known + np.arange(len(owners))
        slots = np.flatnonzero(self._slots >= known)
        self._slots[slots] = number[self._slots[slots]]
        entry = number[entry]
        self._keys = np.append(self._keys, all_keys[owners])
        self._starts = np.append(self._starts, all_starts[owners])
        self._sizes = np.append(self._sizes, all_sizes[owners])
        raw = self._data.data
        made = [zlib.crc32(raw[a : a + n]) % self._buckets for a, n in zip(all_starts[owners], all_sizes[owners])]
        self.bucket = np.append(self.bucket, np.array(made, np.int64))
        self.count = np.append(self.count, np.zeros(len(owners), np.int64)) + np.bincount(entry, minlength=len(self._keys))
        return entry

    def _equal(self, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b hold the same bytes."""
        out = sizes[a] == sizes[b]
        todo = np.flatnonzero(out & (a != b))
        n = sizes[a[todo]]
        bounds = np.concatenate(([0], np.cumsum(n)))
        if bounds[-1]:
            step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
            differ = self._data[np.repeat(starts[a[todo]], n) + step] != self._data[np.repeat(starts[b[todo]], n) + step]
            out[todo] = np.add.reduceat(differ, bounds[:-1], dtype=np.int64) == 0
        return out

    def _reserve(self, more: int) -> None:
        size = len(self._slots)
        while 2 * (len(self._keys) + more) > size:
            size *= 2
        if size == len(self._slots):
            return
        # Entries are known to differ, so each only needs a free slot.
        self._slots = np.full(size, -1, np.int64)
        place, todo = self._keys.view(np.int64) & np.int64(size - 1), np.arange(len(self._keys))
        while len(todo):
            free = self._slots[place[todo]] < 0
            self._slots[place[todo[free]]] = todo[free]
            todo = todo[self._slots[place[todo]] != todo]
            place[todo] = (place[todo] + 1) & np.int64(size - 1)


def _features(column: pa.Array, max_n: int, buckets: int) -> tuple[Interned, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The table of a slice, entries and row bounds for each length of run, and words per row."""
    laid = laid_out(column, WORDLIKE)
    table = Interned(laid.data, buckets)
    found = []
    for n in range(1, max_n + 1):
        starts, ends, bounds = laid.runs(n)
        found.append((table.add(starts, ends), bounds))
    return table, found, np.diff(laid.docs)


def bucket_counts(texts: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, "text"):
            table, _, _ = _features(batch.column("text"), max_n, buckets)
            np.add.at(total, table.bucket, table.count)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    found = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, for each bucket."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    ratios = ((float(t) + 1) * all_source / ((float(s) + 1) * all_target) for s, t in zip(source, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighted(documents: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", max_n: int = MAX_N) -> DataFrame:
    """(id, n_words, n_features, weight) per document row."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            table, found, n_words = _features(batch.column("text"), max_n, len(shared.value))
            of_entry = shared.value[table.bucket]
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for entries, bounds in found:
                sums = np.concatenate(([0], np.cumsum(of_entry[entries])))
                total += sums[bounds[1:]] - sums[bounds[:-1]]
                n += np.diff(bounds)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            columns = [batch.column("doc"), *(pa.array(c, pa.int64()) for c in (n_words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("doc", id)


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def resampled(
    documents: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    share: int = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) per document row; rank is null for rows that are not drawn.

    Of the rows with at least ``min_words`` words, ``share`` per cent (floored) are drawn.
    """
    gain = gains(bucket_counts(documents, text, max_n, buckets), bucket_counts(target, target_text, max_n, buckets))
    rows = weighted(documents, gain, id, text, max_n)
    scored = scratch.cut(rows.withColumn("score", F.col("weight") + noise(F.col(id), seed)))
    return _drawn(scored, id, min_words, share)


def _drawn(scored: DataFrame, id: str, min_words: int, share: int) -> DataFrame:
    able = F.col("n_words") >= min_words
    # Scores are whole thousandths of logarithms of counts: some ten thousand different ones whatever the rows.
    histogram = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    wanted = share * sum(r["n"] for r in histogram) // 100
    least, reached = None, 0
    for row in histogram:
        if reached >= wanted:
            break
        least, reached = row["score"], reached + row["n"]
    columns = [id, "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = able & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last(id), F.asc("n_features")]
    part = F.spark_partition_id().alias("_part")
    sorted_rows = scored.where(near).select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.cut(sorted_rows.select(*columns, part, F.monotonically_increasing_id().alias("_place")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # One row per partition that was written.
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first") + 1).alias("_start"))
    rank = F.col("_start") + F.col("_place")
    drawn = placed.join(F.broadcast(starts), "_part").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))

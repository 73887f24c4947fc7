"""Even shards by sampled splitters, in built-in functions only.

Records are ordered by a key (here the leading 60 bits of the text's MD5, then
the id, then a row number), so equal texts lie next to each other.  One pass
over the texts stores key, size and checksum; all later steps read that narrow
table:

1. Keys are drawn with probability proportional to their size, about
   ``DRAWS`` for each of ``shards * PIECES`` ranges whatever the input; the
   quantiles of the sorted draws are the splitters between the ranges.
2. Every range's rows and bytes are summed.  A range with more than
   ``OVERFULL`` times the mean rows or bytes is subdivided by a draw of its own,
   again and again while that makes progress; single rows cannot be cut.
3. Sums over the ranges and a running sum inside each range give every record
   its place in the whole order.  A record belongs to the shard in which its
   first byte lies if all bytes are dealt out evenly in that order, so shards
   differ by no more than a record at either end.

Defined cases: a null text counts no bytes and its checksum is that of the
empty text; every record has ``OVERHEAD`` bytes besides; repeated rows each get
a place (their row numbers tell them apart); null ids come first among equal
texts; an empty table has no shards.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegauge.plans import scratch

SHARDS = 24
OVERHEAD = 8
#: Ranges per shard before subdivision, and draws per range.
PIECES = 16
DRAWS = 16
OVERFULL = 2
_KEY = ("h", "doc", "row")


def _measured(documents: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        F.col(id).alias("doc"),
        F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("long").alias("h"),
        (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
        F.crc32(body).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows the driver knows, as a table."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _splitters(rows: DataFrame) -> list:
    """Keys that cut each range, which has so many ``bytes``, into about so many ``pieces``, from a size-weighted draw."""
    uniform = F.pmod(F.xxhash64(*_KEY), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(uniform < F.col("pieces") * DRAWS * F.col("size") / F.col("bytes"))
    by_range = Window.partitionBy("range")
    ranked = drawn.withColumns({"at": F.row_number().over(by_range.orderBy(*_KEY)), "n": F.count(F.lit(1)).over(by_range)})
    quantile = F.floor(F.col("at") * F.col("pieces") / F.col("n")) > F.floor((F.col("at") - 1) * F.col("pieces") / F.col("n"))
    return ranked.where(quantile & (F.col("at") < F.col("n"))).select(F.struct(*_KEY).alias("key")).collect()


def _place(keys: list, kinds: dict) -> Column:
    """How many of the sorted splitters are below the row's key: a binary search in halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(keys).bit_length()))])
    table = F.array(*[F.struct(*[F.lit(key[c]).cast(kinds[c]).alias(c) for c in _KEY]) for key in keys])

    def search(at: Column, step: Column) -> Column:
        return at + F.when(F.get(table, at + step - 1) < F.struct(*_KEY), step).otherwise(F.lit(0))

    return F.aggregate(steps, F.lit(0), search).cast("long")


def _cut(rows: DataFrame, shards: int) -> tuple[DataFrame, list]:
    """The rows with their range (ordered as the keys are), and every range's rows and bytes."""
    spark, kinds = rows.sparkSession, {c: rows.schema[c].dataType for c in _KEY}
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    fair = shards * PIECES
    cut, keys, sums = rows.withColumn("range", F.lit(0).cast("long")), [], []
    asked = cut.withColumns({"bytes": F.lit(total["bytes"]), "pieces": F.lit(fair)})
    while asked is not None:
        more = _splitters(asked)
        if not more:
            break
        keys = sorted(keys + [r["key"] for r in more], key=lambda key: [(key[c] is not None, key[c]) for c in _KEY])
        cut = rows.withColumn("range", _place(keys, kinds))
        sums = cut.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        over = [
            {"range": r["range"], "bytes": r["bytes"], "pieces": 1 + int(max(r["n"] * fair / total["n"], r["bytes"] * fair / total["bytes"]))}
            for r in sums
            if r["n"] > 1 and max(r["n"] * fair / total["n"], r["bytes"] * fair / total["bytes"]) > OVERFULL
        ]
        asked = cut.join(F.broadcast(_table(spark, over, "range:bigint,bytes:bigint,pieces:int")), "range") if over else None
    return cut, sums or [{"range": 0, "bytes": total["bytes"], "n": total["n"]}]


def shard(documents: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) per document row; shards are even in bytes and contiguous in key order."""
    rows = scratch.cut(_measured(documents, id, text))
    if rows.isEmpty():
        cut, sums = rows.withColumn("range", F.lit(0).cast("long")), [{"range": 0, "bytes": 0, "n": 0}]
    else:
        cut, sums = _cut(rows, shards)
    before, starts = {"bytes": 0, "n": 0}, []
    for r in sorted(sums, key=lambda r: r["range"]):
        starts.append({"range": r["range"], "bytes_before": before["bytes"], "rows_before": before["n"]})
        before = {"bytes": before["bytes"] + r["bytes"], "n": before["n"] + r["n"]}
    # As many rows as ranges: shards * PIECES and those that overfull ones were cut into.
    offsets = _table(rows.sparkSession, starts, "range:bigint,bytes_before:bigint,rows_before:bigint")
    order = Window.partitionBy("range").orderBy(*_KEY)
    placed = cut.join(F.broadcast(offsets), "range").select(
        F.col("doc").alias(id),
        "size",
        F.col("crc").alias("text_crc32"),
        F.expr(f"(bytes_before + sum(size) OVER (PARTITION BY range ORDER BY h, doc, row) - size) * {shards} DIV {max(before['bytes'], 1)}").cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("_at"),
    )
    placed = scratch.cut(placed)
    heads = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_at").alias("_head"))
    return placed.join(F.broadcast(heads), F.col("shard") == F.col("_shard")).select(
        id, "size", "text_crc32", "shard", (F.col("_at") - F.col("_head")).alias("slot")
    )


def write_shards(documents: DataFrame, placed: DataFrame, path: str, id: str = "doc_id") -> None:
    """One folder per shard with the documents' own columns; ids must be unique."""
    where = placed.select(F.col(id).alias("_id"), "shard", "slot")
    joined = documents.join(where, F.col(id).eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)

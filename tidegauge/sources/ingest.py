"""From batches, stored JSON and collector output to sample rows.

Everything here works on static and streaming frames alike, except the
last-write-wins merges, which need the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schema
from tidegauge.functions.labels import METRIC_TYPES, decode, labels_hash, metric_type, with_labels
from tidegauge.plans.groups import attach


def micros_of_nanos(column: str) -> Column:
    """Nanoseconds to a timestamp, rounded down, in whole numbers throughout."""
    return F.timestamp_micros(F.expr(f"({column} - pmod({column}, 1000)) div 1000"))


def unpack_batches(batches: DataFrame) -> DataFrame:
    """One row per metric of each batch; times arrive as nanoseconds."""
    metric = F.col("metric")
    return batches.withColumn("metric", F.explode("metrics")).select(
        "node_id",
        "session_id",
        "batch_seq",
        "sent_at",
        metric["name"].alias("name"),
        metric["value"].alias("value"),
        micros_of_nanos("metric.timestamp").alias("ts"),
        metric["timestamp"].alias("ts_ns"),
        metric["labels"].alias("labels"),
        decode(metric["type"], METRIC_TYPES).alias("type"),
        metric["help"].alias("help"),
        metric["unit"].alias("unit"),
    )


def accept_sessions(batches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Batches of known sessions, stamped with the session's node.

    Sessions are one row per connected agent.
    """
    known = sessions.select("session_id", F.col("node_id").alias("_node"))
    joined = batches.join(known, "session_id") if batches.isStreaming else attach(batches, known, ["session_id"])
    return joined.withColumn("node_id", F.col("_node")).drop("_node")


def reject_sessions(batches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Batches without a session, or with one nobody opened."""
    return batches.join(sessions.select("session_id"), "session_id", "left_anti")


def store_ready(batches: DataFrame, sessions: DataFrame, collector: str) -> DataFrame:
    """All ingest steps in turn: session check, unpacking, times, labels."""
    accepted = accept_sessions(batches, sessions)
    samples = default_time(unpack_batches(accepted), F.col("sent_at"))
    return enrich(samples, F.col("node_id"), F.lit(collector))


def default_time(samples: DataFrame, arrival: Column) -> DataFrame:
    """A zero time means the time of arrival."""
    missing = F.coalesce(F.col("ts_ns"), F.lit(0)) == 0
    arrived = F.unix_micros(arrival.cast("timestamp"))
    return samples.withColumns(
        {
            "ts": F.when(missing, F.timestamp_micros(arrived)).otherwise(F.col("ts")),
            "ts_ns": F.when(missing, arrived * 1000).otherwise(F.col("ts_ns")),
        }
    )


def enrich(samples: DataFrame, node: Column, collector: Column) -> DataFrame:
    """Set the ``node`` and ``collector`` labels on every sample."""
    return samples.withColumn("labels", with_labels(F.col("labels"), node=node, collector=collector))


def decode_stored(rows: DataFrame) -> DataFrame:
    """``key``/``value`` text pairs back to samples; ``ok`` is false where either is malformed."""
    parts = F.split(F.col("key"), ":")
    body = F.from_json("value", schema.STORED_VALUE, {"mode": "PERMISSIVE"})
    ts_ns = F.get(parts, F.lit(2)).try_cast("bigint")
    return rows.withColumns({"_body": body, "ts_ns": ts_ns, "name": F.get(parts, F.lit(1))}).select(
        *[c for c in rows.columns if c not in ("key", "value")],
        "name",
        "ts_ns",
        micros_of_nanos("ts_ns").alias("ts"),
        F.col("_body.v").alias("value"),
        F.col("_body.n").alias("node_id"),
        F.col("_body.l").alias("labels"),
        metric_type(F.col("_body.t")).alias("type"),
        (F.col("ts_ns").isNotNull() & F.col("_body.v").isNotNull()).alias("ok"),
    )


def last_write(rows: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """Keep the last arrival per key.

    The whole row travels as one struct through a partial aggregate, so a key
    rewritten millions of times is already one row per task before the shuffle.
    """
    rest = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*arrival)).alias("_row")
    return rows.groupBy(*key).agg(newest).select(*key, "_row.*")


def upsert_samples(samples: DataFrame, arrival: list[str]) -> DataFrame:
    """Samples are the same when name, nanosecond time and labels are; the last write wins."""
    keyed = samples.withColumn("labels_hash", labels_hash(F.col("labels")))
    return last_write(keyed, schema.SAMPLE_KEY, arrival)


def union_collectors(parts: list[DataFrame]) -> DataFrame:
    """Outputs of several collectors under one schema; columns a collector lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

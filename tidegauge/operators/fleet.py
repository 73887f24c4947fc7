"""Node registry, heartbeats and health."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.timing import as_micros, instant, micros
from tidegauge.plans.ordered import Ordered, Previous, RunningSum

# Heartbeat timeout, and how many timeouts make a node offline.
HEARTBEAT_TIMEOUT = timedelta(seconds=90)
OFFLINE_AFTER = 3


def latest_rows(rows: DataFrame, key: list[str], order: list[str], attributes: list) -> DataFrame:
    """Newest attributes per key, reduced on the map side."""
    named = [F.col(a) if isinstance(a, str) else a for a in attributes]
    newest = F.max_by(F.struct(*named), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(newest).select(*key, "_row.*")


def registry(registrations: DataFrame, key: str, order: list[str], attributes: list[str]) -> DataFrame:
    """Latest attributes, first and last registration and the number of sessions per node."""
    return registrations.groupBy(key).agg(
        F.max_by(F.struct(*attributes), F.struct(*order)).alias("_row"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("session_count"),
    ).select(key, "_row.*", "created_at", "last_seen", "session_count", F.lit("healthy").alias("status"))


def last_seen(beats: DataFrame, node: str = "node") -> DataFrame:
    return beats.groupBy(node).agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("heartbeats"))


def health_status(age_us: Column, timeout: timedelta = HEARTBEAT_TIMEOUT) -> Column:
    """Strictly older than the timeout is unhealthy, than three timeouts offline."""
    limit = as_micros(timeout)
    return (
        F.when(age_us > limit * OFFLINE_AFTER, "offline").when(age_us > limit, "unhealthy").otherwise("healthy")
    )


def check_health(nodes: DataFrame, as_of, timeout: timedelta = HEARTBEAT_TIMEOUT) -> DataFrame:
    age = micros(instant(as_of)) - micros(F.col("last_seen"))
    return nodes.withColumn("status", health_status(age, timeout))


def recoveries(beats: DataFrame, timeout: timedelta, tie: list[str], node: str = "node") -> DataFrame:
    """Heartbeats that follow a silence longer than the timeout."""
    seen = Ordered(beats, [node], ["ts", *tie]).scan(down_since=Previous(F.col("ts"))).frame()
    silence = micros(F.col("ts")) - micros(F.col("down_since"))
    return seen.filter(silence > as_micros(timeout)).withColumn("silence_us", silence)


def transitions(beats: DataFrame, timeout: timedelta, tie: list[str], as_of, node: str = "node") -> DataFrame:
    """Every status change up to ``as_of``: (node, status, at, last_seen).

    A node is healthy from its first beat on, unhealthy once it has been silent
    longer than the timeout, offline after three, healthy again with the beat
    that ends an outage.  ``at`` is when the silence got too long.
    """
    limit = as_micros(timeout)
    steps = (("unhealthy", limit), ("offline", limit * OFFLINE_AFTER))
    seen = Ordered(beats.select(node, "ts", *tie), [node], ["ts", *tie]).scan(_before=Previous(F.col("ts"))).frame()

    def late(since: Column, status: str, after: int) -> Column:
        lasts = F.struct(F.lit(status).alias("status"), (since + F.lit(timedelta(microseconds=after))).alias("at"), since.alias("last_seen"))
        return F.struct(lasts.alias("row"), F.lit(after).alias("after"))

    def changes(since: Column, silence: Column, *more: Column) -> Column:
        found = F.filter(F.array(*[late(since, s, a) for s, a in steps]), lambda c: silence > c["after"])
        return F.concat(F.transform(found, lambda c: c["row"]), F.array_compact(F.array(*more)))

    silence = micros(F.col("ts")) - micros(F.col("_before"))
    healthy = F.struct(F.lit("healthy").alias("status"), F.col("ts").alias("at"), F.col("ts").alias("last_seen"))
    first = F.col("_before").isNull()
    back = F.when(first | (silence > limit), healthy)
    between = seen.filter(first | (silence > limit)).select(node, F.explode(changes(F.col("_before"), F.coalesce(silence, F.lit(0)), back)).alias("c"))
    newest = beats.groupBy(node).agg(F.max("ts").alias("_last"))
    open_ones = newest.select(node, F.explode(changes(F.col("_last"), micros(instant(as_of)) - micros(F.col("_last")))).alias("c"))
    log = between.unionByName(open_ones).select(node, "c.status", "c.at", "c.last_seen")
    return log.filter(F.col("at") <= instant(as_of))


def sessions(beats: DataFrame, gap: timedelta, tie: list[str], node: str = "node") -> DataFrame:
    """Runs of heartbeats no further apart than the gap; a session ends one gap after its last beat.

    Beats exactly one gap apart belong to different sessions, as in Spark's
    own session windows.
    """
    silence = micros(F.col("ts")) - micros(F.col("_before"))
    first = F.col("_before").isNull() | (silence >= as_micros(gap))
    numbered = (
        Ordered(beats, [node], ["ts", *tie])
        .scan(_before=Previous(F.col("ts")))
        .scan(session_no=RunningSum(F.when(first, 1).otherwise(0)))
        .frame()
    )
    return (
        numbered.groupBy(node, "session_no")
        .agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("beats"))
        .withColumn("ended", F.col("last_seen") + F.lit(gap))
    )


def status_changes(rows: DataFrame, node: str, tie: list[str], status: str = "status") -> DataFrame:
    """Rows whose status differs from the node's previous one."""
    compared = Ordered(rows, [node], ["ts", *tie]).scan(old_status=Previous(F.col(status))).frame()
    return compared.filter(F.col("old_status") != F.col(status))

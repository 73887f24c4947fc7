"""One message stream of samples, alerts and node states, and who gets what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the topic that stands for every message type.
ALL = "all"


def envelope(rows: DataFrame, kind: str, ts: Column, node: Column, data: list[str]) -> DataFrame:
    """type, ts, node_id and the payload as JSON."""
    payload = F.to_json(F.struct(*data), {"ignoreNullFields": "true"})
    return rows.select(F.lit(kind).alias("type"), ts.alias("ts"), node.alias("node_id"), payload.alias("data"))


def merged(parts: list[DataFrame]) -> DataFrame:
    feed, *rest = parts
    for part in rest:
        feed = feed.unionByName(part)
    return feed


def delivered(feed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages of any type per client subscribed to that type or to ``all``, each once.

    A client of ``all`` needs no other topic, so no message can match a client
    twice and the match is a plain equi-join.
    """
    wanted = subscriptions.select("client", "topic").distinct()
    every = wanted.filter(F.col("topic") == ALL)
    typed = wanted.filter(F.col("topic") != ALL).join(every.select("client"), "client", "left_anti")
    topics = F.array_distinct(F.array("type", F.lit(ALL)))
    addressed = feed.withColumn("topic", F.explode(topics))
    return addressed.join(every.unionByName(typed), "topic").select("client", *feed.columns)

"""The given tables read as samples, nodes, counters and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.plans.ordered import Ordered, RunningSum

KEYS = ["name", "node"]
TIE = ["event_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Hours of the day and epoch arithmetic are defined in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as samples: one metric per event type, ten nodes, one user label."""
    node = F.concat(F.lit("node-"), F.col("user_id") % 10)
    user = F.concat(F.lit("user-"), F.col("user_id"))
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "value",
        F.col("event_type").alias("name"),
        node.alias("node"),
        user.alias("usr"),
        F.concat(F.lit("collector=events,node="), node, F.lit(",user="), user, F.lit(",")).alias("series_key"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the labels as a map."""
    base = metrics(spark, folder)
    pairs = F.create_map(
        F.lit("user"), F.col("usr"), F.lit("node"), F.col("node"), F.lit("collector"), F.lit("events")
    )
    return base.select("event_id", "ts", "value", "name", pairs.alias("labels"))


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def counts_k(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("name"),
        F.concat(F.lit("node-"), F.col("user_id") % 10).alias("node"),
        k_of(F.col("props")).alias("k"),
    )


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """An integer counter per (node, name) that falls back to zero past 1000."""
    running = Ordered(counts_k(spark, folder), ["node", "name"], ["ts", "event_id"]).scan(total=RunningSum(F.col("k")))
    return running.frame().select("event_id", "ts", "name", "node", (F.col("total") % 1000).cast("double").alias("value"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One node per user, every event a heartbeat."""
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("heartbeats"))
        .select(
            F.concat(F.lit("node-"), F.col("user_id")).alias("id"),
            F.when(F.col("user_id") % 3 == 0, "linux").when(F.col("user_id") % 3 == 1, "darwin").otherwise("windows").alias("os"),
            "created_at",
            "last_seen",
            "heartbeats",
        )
    )


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("node-"), F.col("user_id")).alias("node"), "ts", F.col("event_type").alias("status")
    )


def newest(df: DataFrame, ts: str = "ts"):
    """The largest timestamp: one value, used as the point in time a query is asked at."""
    return df.agg(F.max(ts)).first()[0]


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as samples: node = supplier, name = return flag."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_returnflag").alias("name"),
        F.concat(F.lit("node-"), F.col("l_suppkey")).alias("node"),
    )


def comparable(value: Column) -> Column:
    """Six decimals, cut at an odd offset so that decimal ties and sum order do not matter."""
    return F.floor(value * 1e6 + 0.3141592) / 1e6

"""Arithmetic between metrics, overlays and correlations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.timing import as_micros, micros, time_bucket
from tidegauge.operators.aggregate import downsample_mean
from tidegauge.operators.select import by_name
from tidegauge.plans.ordered import Ordered, RunningSum, asof


def vector(samples: DataFrame, name: str, by: list[str], step: timedelta, tie: list[str], take: str = "last") -> DataFrame:
    """One value of a metric per label set and step."""
    points = downsample_mean(by_name(samples, name), by, step, tie if take == "last" else None)
    return points.select(*by, "bucket", F.col(take).alias("value"))


def combine(left: DataFrame, right: DataFrame, on: list[str], value: Column) -> DataFrame:
    """One-to-one match on labels and step; ``value`` is written in terms of ``left`` and ``right``.

    Both sides hold one row per key, so the equi-join cannot fan out.
    """
    joined = left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), on)
    return joined.select(*on, "left", "right", value.alias("value"))


def paired(samples: DataFrame, names: list[str], by: list[str], step: timedelta, tie: list[str]) -> DataFrame:
    """Several metrics of the same labels and step side by side, from a single aggregation.

    When both sides of an expression come from one table and share their
    labels, a conditional aggregate replaces the self-join: one scan, one
    shuffle.  Rows where a metric is missing hold null.
    """
    wanted = by_name(samples, *names).withColumn("bucket", time_bucket(F.col("ts"), step))
    newest = F.struct("ts", *tie)
    picks = [F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, newest)).alias(n) for n in names]
    return wanted.groupBy(*by, "bucket").agg(*picks)


def load_per_cpu(samples: DataFrame, load: str, cores: str, by: list[str], step: timedelta, tie: list[str]) -> DataFrame:
    both = paired(samples, [load, cores], by, step, tie)
    return both.withColumn("value", F.try_divide(F.col(load), F.col(cores))).filter(F.col("value").isNotNull())


def overlay(points: DataFrame, events: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Each point with the latest event at or before it."""
    return asof(points, events, keys, order, order, payload)


def correlate(
    events: DataFrame, samples: DataFrame, keys: list[str], event_id: str, around: timedelta, tie: list[str]
) -> DataFrame:
    """Count and mean of the samples in the ``around`` before and after each event, ends included.

    An event contributes four marks: window start and end, and its own time for
    either half.  Running totals within time slots, forwards and backwards, read
    at the marks give both halves.  No event-sample pairs are formed, so the cost
    is two sorts however dense the windows are.
    """
    value = F.col("value")
    stacked_samples = samples.select(
        *keys, F.col("ts").alias("_at"), F.lit(1).alias("_rank"), value.alias("_v"), F.when(value.isNotNull(), 1).otherwise(0).alias("_one"),
        F.struct(*tie).alias("_tie"), F.lit(None).cast("string").alias("_mark"),
        F.lit(None).cast(events.schema[event_id].dataType).alias(event_id), F.lit(None).cast(events.schema["ts"].dataType).alias("_event_ts"),
    )
    tie_type = stacked_samples.schema["_tie"].dataType
    # Rank 0 reads totals before the samples of the same instant, rank 2 after them.
    marks = F.array(
        F.struct((F.col("ts") - F.lit(around)).alias("at"), F.lit(0).alias("rank"), F.lit("open").alias("mark")),
        F.struct(F.col("ts").alias("at"), F.lit(0).alias("rank"), F.lit("before").alias("mark")),
        F.struct(F.col("ts").alias("at"), F.lit(2).alias("rank"), F.lit("upto").alias("mark")),
        F.struct((F.col("ts") + F.lit(around)).alias("at"), F.lit(2).alias("rank"), F.lit("close").alias("mark")),
    )
    stacked_events = events.withColumn("_m", F.explode(marks)).select(
        *keys, F.col("_m.at").alias("_at"), F.col("_m.rank").alias("_rank"), F.lit(None).cast("double").alias("_v"),
        F.lit(0).alias("_one"), F.lit(None).cast(tie_type).alias("_tie"), F.col("_m.mark").alias("_mark"), event_id,
        F.col("ts").alias("_event_ts"),
    )
    # Slots as wide as a window: each window is the end of one slot and the beginning of the next, so it is a sum of
    # its own samples only; nothing before it can blur or spoil that sum.
    slot = F.floor(micros(F.col("_at")) / F.lit(as_micros(around)))
    stacked = stacked_samples.unionByName(stacked_events).withColumns({"_slot": slot, "_back": -micros(F.col("_at")), "_rank_back": -F.col("_rank")})
    within = [*keys, "_slot"]
    one, given = F.col("_one"), F.when(F.col("_one") == 1, F.col("_v"))
    upto = Ordered(stacked, within, ["_at", "_rank", "_tie", event_id, "_mark"]).scan(_n=RunningSum(one), _s=RunningSum(given)).frame()
    onward = Ordered(upto, within, ["_back", "_rank_back", "_tie", event_id, "_mark"]).scan(_rn=RunningSum(one), _rs=RunningSum(given)).frame()
    totals = onward.filter(F.col("_mark").isNotNull())

    def at(mark: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_mark") == mark, F.col(column))), F.lit(0))

    before_n, after_n = at("open", "_rn") + at("upto", "_n"), at("before", "_rn") + at("close", "_n")
    before_s, after_s = at("open", "_rs") + at("upto", "_s"), at("before", "_rs") + at("close", "_s")
    return totals.groupBy(event_id, *keys).agg(
        F.max("_event_ts").alias("ts"),
        before_n.alias("samples_before"),
        F.try_divide(before_s, before_n).alias("mean_before"),
        after_n.alias("samples_after"),
        F.try_divide(after_s, after_n).alias("mean_after"),
    )

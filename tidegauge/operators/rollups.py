"""Stored downsampling: bucket states per day at several levels, and range queries that read the level they need.

A state is count, sum, least, greatest and last value of a bucket, so states of
small buckets merge into those of larger ones.  Each day's finest level is built
from the samples once, every coarser one from the level below it.  A query takes
the coarsest level whose buckets fit its step and reads samples only where its
range does not begin or end on a bucket of that level.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions.timing import as_micros, instant, time_bucket, utc_date
from tidegauge.operators.select import TimeRange, by_name, in_range
from tidegauge.plans import scratch

DAY = timedelta(days=1)
LEVELS = (timedelta(minutes=5), timedelta(hours=1), timedelta(hours=6))
_MICRO = timedelta(microseconds=1)
_EPOCH = datetime(1, 1, 1)


def _valid(levels: tuple[timedelta, ...]) -> tuple[timedelta, ...]:
    for finer, coarser in zip(levels, [*levels[1:], DAY]):
        if coarser % finer:
            raise ValueError("every level must divide the next one, and the last a day")
    return levels


def _raw_states(samples: DataFrame, keys: list[str], level: timedelta, tie: list[str]) -> DataFrame:
    """States of samples; rows without a value do not count."""
    rows = samples.filter(F.col("value").isNotNull()).withColumn("bucket", time_bucket(F.col("ts"), level))
    return rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.max(F.struct("ts", *tie, "value")).alias("last"),
    )


def _merged(states: DataFrame, keys: list[str], step: timedelta) -> DataFrame:
    """States of the buckets of ``step`` from states of smaller ones."""
    rows = states.withColumn("bucket", time_bucket(F.col("bucket"), step))
    return rows.groupBy(*keys, "bucket").agg(
        F.sum("points").alias("points"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("last").alias("last")
    )


def _place(path: str, level: timedelta) -> str:
    return f"{path}/seconds={as_micros(level) // 1_000_000}"


def build(samples: DataFrame, path: str, keys: list[str], tie: list[str], start: date, end: date, levels: tuple[timedelta, ...] = LEVELS) -> None:
    """(Re)build the states of the days from ``start`` up to ``end`` (exclusive); other days stay as they are.

    ``keys`` contain ``name``.  A day that has samples is rebuilt from them, so
    repeating a run, or running it again after late samples, leaves no trace of
    the first.
    """
    spark = samples.sparkSession
    days = in_range(samples, datetime(start.year, start.month, start.day), datetime(end.year, end.month, end.day), open_end=True)
    states = None
    for level in _valid(levels):
        states = scratch.cut(_raw_states(days, keys, level, tie) if states is None else _merged(states, keys, level))
        dated = states.withColumn("date", utc_date(F.col("bucket"), dict(states.dtypes)["bucket"]))
        # A day is one task's worth of a metric's series after the first level, or several files of it.
        spread = dated.repartitionByRange("date", "name", F.xxhash64(*keys, "bucket"))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(_place(path, level))


def _aligned(moment: datetime, level: timedelta, up: bool) -> datetime:
    past = (moment - _EPOCH) % level
    return moment if not past else moment - past + (level if up else timedelta(0))


def level_for(span: TimeRange, levels: tuple[timedelta, ...] = LEVELS) -> timedelta | None:
    """The coarsest level that divides the step and has a whole bucket in the range."""
    for level in reversed(levels):
        if as_micros(span.step) > 0 and not span.step % level and _aligned(span.start, level, True) < _aligned(span.end + _MICRO, level, False):
            return level
    return None


def range_query(
    spark: SparkSession, samples: DataFrame, path: str, names: list[str], span: TimeRange, keys: list[str], tie: list[str], levels: tuple[timedelta, ...] = LEVELS
) -> DataFrame:
    """Mean, extremes, sum, count and last value per bucket of the step, both ends of the range included.

    The same rows as from the samples alone.  ``span`` is in UTC without a zone.
    What lies before the first and after the last whole bucket of the level
    comes from the samples of those days; if nothing does, they are not read.
    """
    level = level_for(span, _valid(levels))
    if level is None:
        states = _raw_states(in_range(by_name(samples, *names), span.start, span.end), keys, span.step, tie)
    else:
        first, after = _aligned(span.start, level, True), _aligned(span.end + _MICRO, level, False)
        stored = spark.read.parquet(_place(path, level))
        parts = [in_range(by_name(stored, *names), first, after, ts="bucket", open_end=True).drop("date")]
        for low, high, open_end in ((span.start, first, True), (after, span.end, False)):
            if low < high or (low == high and not open_end):
                parts.append(_raw_states(in_range(by_name(samples, *names), low, high, open_end=open_end), keys, level, tie))
        states = parts[0]
        for part in parts[1:]:
            states = states.unionByName(part)
        states = _merged(states, keys, span.step)
    mean: Column = F.col("total") / F.col("points")
    return states.select(*keys, "bucket", mean.alias("mean"), "low", "high", "total", "points", F.col("last.value").alias("last"))

"""Retention, storage tiers and compaction."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.timing import as_micros, instant, micros
from tidegauge.operators.aggregate import downsample_mean
from tidegauge.operators.select import in_range


@dataclass(frozen=True)
class Tiers:
    """Fixed default values of the shipped configuration."""

    hot: timedelta = timedelta(hours=24)
    warm: timedelta = timedelta(hours=168)
    cold: timedelta = timedelta(hours=720)
    keep: timedelta = timedelta(hours=720)


def tier(as_of, tiers: Tiers, ts: str = "ts") -> Column:
    age = micros(instant(as_of)) - micros(F.col(ts))
    return (
        F.when(age <= as_micros(tiers.hot), "hot")
        .when(age <= as_micros(tiers.warm), "warm")
        .when(age <= as_micros(tiers.cold), "cold")
        .otherwise("expired")
    )


def kept(samples: DataFrame, as_of, tiers: Tiers) -> DataFrame:
    """Samples not older than the retention period; older days of a stored table are not even listed."""
    return in_range(samples, as_of - tiers.keep, None)


def expired(samples: DataFrame, as_of, tiers: Tiers) -> DataFrame:
    """Samples older than the retention period, from the days that can hold any."""
    return in_range(samples, None, as_of - tiers.keep, open_end=True)


def compacted(samples: DataFrame, keys: list[str], as_of, tiers: Tiers, step: timedelta) -> DataFrame:
    """Hot samples as they are, warm ones as bucket means: one view over both."""
    at = as_of - tiers.hot
    hot = in_range(samples, at, None).select(*keys, "ts", "value", F.lit(1).cast("bigint").alias("points"), F.lit("hot").alias("tier"))
    warm_rows = in_range(samples, as_of - tiers.warm, at, open_end=True)
    warm = downsample_mean(warm_rows, keys, step).select(
        *keys, F.col("bucket").alias("ts"), F.col("mean").alias("value"), "points", F.lit("warm").alias("tier")
    )
    return hot.unionByName(warm)


def stats(samples: DataFrame, as_of, tiers: Tiers) -> DataFrame:
    """Settings and sample counts per tier, in one row."""
    name = tier(as_of, tiers)
    counts = [F.count_if(name == t).alias(f"{t}_metrics") for t in ("hot", "warm", "cold", "expired")]
    hours = [F.lit(as_micros(getattr(tiers, f)) // 3_600_000_000).alias(f"{f}_hours") for f in ("keep", "hot", "warm", "cold")]
    return samples.agg(F.count(F.lit(1)).alias("total_metrics"), *counts).select("*", *hours)

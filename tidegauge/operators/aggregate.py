"""Time buckets, series lists, store and fleet statistics."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.labels import Matcher, label
from tidegauge.functions.timing import as_micros, time_bucket
from tidegauge.operators.select import TimeRange, selection
from tidegauge.plans.groups import attach
from tidegauge.plans.ordered import Ordered, RunningSum

# Weights halve with every later row; below this power they are zero anyway.
_SMALLEST_POWER = 1100


def bucketed(samples: DataFrame, step: timedelta) -> DataFrame:
    return samples.withColumn("bucket", time_bucket(F.col("ts"), step))


def downsample_pairwise(samples: DataFrame, keys: list[str], step: timedelta, tie: list[str]) -> DataFrame:
    """Fold ``(acc + v) / 2`` over each bucket in time order, starting with its first value.

    Unrolled, the row that is j-th from the end weighs 0.5^j and the first row
    counts once more at the last weight, which leaves a row count from the end
    and a plain sum.
    """
    group = [*keys, "bucket"]
    newest_first = [F.col(c).desc() for c in ("ts", *tie)]
    ranked = Ordered(bucketed(samples, step), group, newest_first).scan(_from_end=RunningSum(F.lit(1))).frame()
    half = F.pow(F.lit(0.5), F.least(F.col("_from_end"), F.lit(_SMALLEST_POWER)))
    rows = F.least(F.count(F.lit(1)), F.lit(_SMALLEST_POWER))
    folded = F.sum(F.col("value") * half) + F.max_by("value", "_from_end") * F.pow(F.lit(0.5), rows)
    return ranked.groupBy(*group).agg(folded.alias("value"), F.count(F.lit(1)).alias("points"))


def downsample_mean(samples: DataFrame, keys: list[str], step: timedelta, tie: list[str] | None = None) -> DataFrame:
    """Mean, extremes, sum and count per bucket; with tie columns also the last value.

    The last value needs a compound order, which Spark aggregates by sorting;
    without it the whole aggregation is hashed.
    """
    last = [] if tie is None else [F.max_by("value", F.struct("ts", *tie)).alias("last")]
    return (
        bucketed(samples, step)
        .groupBy(*keys, "bucket")
        .agg(
            F.avg("value").alias("mean"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.sum("value").alias("total"),
            F.count(F.lit(1)).alias("points"),
            *last,
        )
    )


def range_query(
    samples: DataFrame,
    names: list[str],
    matchers: list[Matcher],
    span: TimeRange,
    keys: list[str],
    tie: list[str],
    how: str = "pairwise",
) -> DataFrame:
    """Select by name, time and labels, group by series, downsample to the step.

    ``how`` is ``pairwise``, ``mean`` (mean, extremes, sum, count) or ``last``
    (the same and the last value).
    """
    chosen = selection(samples, names, matchers, span)
    if as_micros(span.step) <= 0:
        return chosen.select(*keys, F.col("ts").alias("bucket"), "value", *tie)
    if how == "pairwise":
        return downsample_pairwise(chosen, keys, span.step, tie)
    return downsample_mean(chosen, keys, span.step, tie if how == "last" else None)


def matrix(points: DataFrame, keys: list[str], step: timedelta, points_per_row: int = 1000) -> DataFrame:
    """Series as rows of (time, value) arrays.

    A long series takes several rows, each covering ``points_per_row`` steps, so
    no row or task ever holds more than that many points.  ``bucket`` must be
    unique per series, as a downsampled series is.
    """
    return (
        points.withColumn("chunk", time_bucket(F.col("bucket"), step * points_per_row))
        .groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("bucket").alias("ts"), "value"))).alias("samples"))
    )


def series_list(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.select(*keys).distinct()


def label_names(samples: DataFrame) -> DataFrame:
    """Every label name in use; key sets are reduced before they are exploded."""
    return (
        samples.select(F.array_sort(F.map_keys("labels")).alias("names"))
        .distinct()
        .select(F.explode("names").alias("label"))
        .distinct()
    )


def label_values(samples: DataFrame, name: str, metric: str | None = None) -> DataFrame:
    chosen = samples if metric is None else samples.filter(F.col("name") == metric)
    return chosen.select(label(chosen, name).alias("label_value")).filter("label_value <> ''").distinct()


def store_stats(samples: DataFrame, nodes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Row counts of the three tables and the time range of the samples, in one row."""
    kinds = [
        samples.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")).withColumn(
            "kind", F.lit("metrics")
        ),
        nodes.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("nodes")),
        alerts.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("alerts")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("n")))

    return stacked.agg(
        of("metrics").alias("total_metrics"),
        of("nodes").alias("total_nodes"),
        of("alerts").alias("total_alerts"),
        F.min("oldest").alias("oldest_metric"),
        F.max("newest").alias("newest_metric"),
    )


def node_stats(nodes: DataFrame) -> DataFrame:
    """Nodes by status; degraded counts as unhealthy, unknown only in the total."""
    status = F.col("status")
    return nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(status == "healthy").alias("healthy_nodes"),
        F.count_if(status.isin("unhealthy", "degraded")).alias("unhealthy_nodes"),
        F.count_if(status == "offline").alias("offline_nodes"),
    )


def node_metric_count(samples: DataFrame, node: str = "node") -> DataFrame:
    return samples.groupBy(node).agg(F.count(F.lit(1)).alias("metrics_count"))


def overview(nodes: DataFrame, samples: DataFrame, alerts: DataFrame) -> DataFrame:
    """Total nodes, active nodes, total metrics and active alerts, in one row."""
    parts = [
        nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if("online").alias("active_nodes")),
        samples.agg(F.count(F.lit(1)).alias("total_metrics")),
        alerts.agg(F.count_if(F.col("state").isin("pending", "firing")).alias("active_alerts")),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in ("total_nodes", "active_nodes", "total_metrics", "active_alerts")])


def active_counts(nodes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Open alerts and known nodes, in one row."""
    parts = [
        alerts.agg(F.count_if(F.col("state").isin("pending", "firing")).alias("active_alerts")),
        nodes.agg(F.count(F.lit(1)).alias("nodes")),
    ]
    stacked = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return stacked.agg(F.max("active_alerts").alias("active_alerts"), F.max("nodes").alias("nodes"))


def sum_by(points: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return points.groupBy(*by).agg(F.sum(value).alias("value"))


def heatmap(samples: DataFrame, step: timedelta, low: float, high: float, bins: int) -> DataFrame:
    """Rows per time bucket and value bin; bins 0 and bins+1 take values outside [low, high)."""
    return (
        bucketed(samples, step)
        .withColumn("bin", F.width_bucket("value", F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
        .groupBy("bucket", "bin")
        .agg(F.count(F.lit(1)).alias("points"))
    )


def compare_hosts(samples: DataFrame, hosts: list[str], step: timedelta) -> DataFrame:
    """Mean per bucket with one column per host; hosts are named, so no extra pass finds them."""
    return bucketed(samples, step).groupBy("bucket").pivot("node", hosts).agg(F.avg("value"))


def minmax_scale(points: DataFrame, keys: list[str]) -> DataFrame:
    """Scale each series to 0..1 over a range that always includes zero."""
    extremes = points.groupBy(*keys).agg(
        F.least(F.min("value"), F.lit(0.0)).alias("low"), F.greatest(F.max("value"), F.lit(0.0)).alias("high")
    )
    width = F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(1.0))
    return attach(points, extremes, keys).withColumn("scaled", (F.col("value") - F.col("low")) / width)


def last_values(samples: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Latest value per series, two decimals."""
    newest = F.max_by("value", F.struct("ts", *tie))
    return samples.groupBy(*keys).agg(F.floor(newest * 100 + 0.5).alias("hundredths"), F.max("ts").alias("ts")).select(
        *keys, "ts", (F.col("hundredths") / 100).alias("value")
    )

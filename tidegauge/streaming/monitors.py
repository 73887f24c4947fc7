"""Continuous versions of ingest, downsampling, rates, sessions, alerts and health."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.timing import as_micros, bucket_origin, micros
from tidegauge.operators.fleet import OFFLINE_AFTER
from tidegauge.operators.forecast import KEPT_POINTS
from tidegauge.streaming import machines
from tidegauge.streaming.inorder import SLOT, Folded, run_in_order

#: Parts of a metric's series in a stream of rules; each sees every change of the metric's rules.
LANES = 16
#: Parts that a stream of heartbeats deals its nodes to; at least as many as the cluster has cores.
NODE_LANES = 64
# Fixed value: points between two fits of an updated forecast.
REFIT_EVERY = 100


def text(span: timedelta) -> str:
    return f"{as_micros(span)} microseconds"


def deduplicated(samples: DataFrame, key: list[str], delay: timedelta) -> DataFrame:
    """Each sample once; state is kept only as long as repeats can still arrive."""
    return samples.withWatermark("ts", text(delay)).dropDuplicatesWithinWatermark(key)


def downsampled(samples: DataFrame, keys: list[str], step: timedelta, delay: timedelta) -> DataFrame:
    """Mean, extremes and count per bucket, emitted once a bucket is complete."""
    window = F.window("ts", text(step), startTime=text(bucket_origin(step)))
    grouped = samples.withWatermark("ts", text(delay)).groupBy(*keys, window).agg(
        F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("points")
    )
    return grouped.select(*keys, F.col("window.start").alias("bucket"), "mean", "low", "high", "points")


def activity_sessions(beats: DataFrame, node: str, gap: timedelta, delay: timedelta) -> DataFrame:
    """Sessions split by silence, emitted once they cannot grow any more."""
    window = F.session_window("ts", text(gap))
    grouped = beats.withWatermark("ts", text(delay)).groupBy(node, window).agg(
        F.count(F.lit(1)).alias("beats"), F.max("ts").alias("last_seen")
    )
    return grouped.select(
        node, F.col("session_window.start").alias("started"), "last_seen", F.col("session_window.end").alias("ended"), "beats"
    )


def live_last(samples: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Latest value per series, updated with every micro-batch."""
    at = F.struct("ts", tie)
    return samples.groupBy(*keys).agg(F.max("ts").alias("ts"), F.max_by("value", at).alias("value"))


def _rows(samples: DataFrame, keys: list[str], tie: str, delay: timedelta) -> DataFrame:
    return samples.withWatermark("ts", text(delay)).select(
        *keys, "ts", micros(F.col("ts")).alias("us"), F.col(tie).cast("bigint").alias("tie"), "value"
    )


def growths(counters: DataFrame, keys: list[str], tie: str, delay: timedelta, slot: timedelta = SLOT) -> DataFrame:
    """Counter growth per sample, reset-aware, in event-time order."""
    machine = Folded(keys, "last double", machines.growths, slot)
    return run_in_order(_rows(counters, keys, tie, delay), keys, machine, "ts timestamp, increase double", "ts")


def sliding_rate(
    counters: DataFrame, keys: list[str], tie: str, span: timedelta, every: timedelta, delay: timedelta, slot: timedelta = SLOT
) -> DataFrame:
    """Per-second growth over a look-back span (a multiple of ``every``), emitted for each completed window."""
    machine = machines.SlidingSums(keys, as_micros(span), as_micros(every), as_micros(bucket_origin(every)), slot)
    windows = run_in_order(_rows(counters, keys, tie, delay), keys, machine, "window_us bigint, increase double")
    rate = F.col("increase") / F.lit(as_micros(span) / 1e6)
    return windows.select(*keys, F.timestamp_micros("window_us").alias("window_end"), rate.alias("rate"))


def alert_transitions(
    samples: DataFrame, keys: list[str], tie: str, threshold: float, hold: timedelta, delay: timedelta, slot: timedelta = SLOT
) -> DataFrame:
    """One row whenever an alert of ``value > threshold`` becomes pending, firing or resolved."""
    machine = Folded(keys, "active bigint, fired boolean", machines.threshold(threshold, as_micros(hold)), slot)
    rows = run_in_order(
        _rows(samples, keys, tie, delay), keys, machine, "transition string, at_us bigint, active_us bigint, value double"
    )
    return rows.select(
        *keys, "transition", F.timestamp_micros("at_us").alias("at"), F.timestamp_micros("active_us").alias("active_at"), "value"
    )


def refits(
    points: DataFrame, keys: list[str], tie: str, delay: timedelta, every: int = REFIT_EVERY, kept: int = KEPT_POINTS, slot: timedelta = SLOT
) -> DataFrame:
    """A new forecast model of a series' newest ``kept`` points whenever it holds a multiple of ``every``.

    State is those points.  A series that is full has a multiple at every point,
    as the original rule says; ``at`` is the time of the point that caused the fit.
    """
    machine = Folded(keys, "us array<bigint>, value array<double>", machines.refits(kept, every), slot)
    models = run_in_order(
        _rows(points, keys, tie, delay), keys, machine, "at_us bigint, n bigint, slope double, intercept double, season array<double>, variance double"
    )
    return models.select(*keys, F.timestamp_micros("at_us").alias("at"), "n", "slope", "intercept", "season", "variance")


def firing_notices(
    samples: DataFrame, keys: list[str], tie: str, threshold: float, hold: timedelta, delay: timedelta, slot: timedelta = SLOT
) -> DataFrame:
    """Alerts of ``value > threshold`` at the moment they fire, (keys, ts, at_us, value), with event time for a further machine."""
    machine = Folded(keys, "active bigint, fired boolean", machines.firing(threshold, as_micros(hold)), slot)
    return run_in_order(_rows(samples, keys, tie, delay), keys, machine, "ts timestamp, at_us bigint, value double", "ts")


def rule_alerts(
    samples: DataFrame, changes: DataFrame, keys: list[str], tie: str, delay: timedelta, slot: timedelta = SLOT, lanes: int = LANES
) -> DataFrame:
    """The alert log under rules that change while the samples stream in.

    ``samples`` have ``name``, the keys, ``ts``, ``tie`` and ``value``; ``changes``
    have ``ts``, ``tie``, ``name`` (the metric), ``rule``, ``op`` (put, delete,
    enable, disable) and, for a put, ``operator``, ``threshold`` and ``hold_us``.
    A rule belongs to one metric.  A metric's series are dealt to ``lanes``
    state keys, so that a metric of many nodes is many tasks; the few changes go
    to each of them.  Both streams share one watermark: a change that is later
    than the delay is dropped as a sample would be.
    """
    series = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]))
    nothing = {"rule": "string", "op": "string", "operator": "string", "threshold": "double", "hold_us": "bigint"}
    sampled = samples.select(
        "name", F.pmod(F.xxhash64(series), F.lit(lanes)).cast("int").alias("lane"), "ts", F.lit(1).alias("kind"),
        F.col(tie).cast("bigint").alias("tie"), series.alias("series"), F.col("value").cast("double").alias("value"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()],
    )
    changed = changes.select(
        "name", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "ts", F.lit(0).alias("kind"),
        F.col(tie).cast("bigint").alias("tie"), F.lit(None).cast("string").alias("series"), F.lit(None).cast("double").alias("value"),
        *[F.col(c).cast(kind).alias(c) for c, kind in nothing.items()],
    )
    both = sampled.unionByName(changed).withWatermark("ts", text(delay)).withColumn("us", micros(F.col("ts")))
    log = run_in_order(
        both, ["name", "lane"], machines.RuleTable(["name", "lane"], slot),
        "rule string, series string, transition string, at_us bigint, active_us bigint, value double",
    )
    parts = F.from_json("series", ", ".join(f"`{k}` string" for k in keys))
    named = log.withColumn("_s", parts).withColumns({k: F.col("_s")[k].cast(samples.schema[k].dataType) for k in keys})
    return named.select(
        "name", "rule", *keys, "transition", F.timestamp_micros("at_us").alias("at"), F.timestamp_micros("active_us").alias("active_at"),
        F.nanvl("value", F.lit(None).cast("double")).alias("value"),
    )


def ewma_scores(
    samples: DataFrame, keys: list[str], tie: str, alpha: float, limit: float, delay: timedelta, slot: timedelta = SLOT
) -> DataFrame:
    """Detect with the past, then update; a series' first sample is not judged."""
    machine = Folded(keys, "mean double, var double", machines.ewma(alpha, limit, tie), slot)
    rows = run_in_order(
        _rows(samples, keys, tie, delay), keys, machine, f"{tie} bigint, us bigint, mean_before double, score double, is_anomaly boolean"
    )
    return rows.withColumn("ts", F.timestamp_micros("us")).drop("us")


def health(beats: DataFrame, node: str, timeout: timedelta, delay: timedelta, slot: timedelta = SLOT, lanes: int = NODE_LANES) -> DataFrame:
    """Every status change of every node, (node, status, at, last_seen), whatever beats arrived together.

    Nodes are dealt to ``lanes`` state keys; a lane's nodes are kept and judged
    together.  A stream that is started again must keep its lanes.
    """
    lane = F.pmod(F.xxhash64(node), F.lit(lanes)).cast("int").alias("_lane")
    rows = beats.withWatermark("ts", text(delay)).select(lane, node, "ts", micros(F.col("ts")).alias("us"))
    machine = machines.FleetHealth(["_lane"], node, as_micros(timeout), OFFLINE_AFTER, slot)
    kind = beats.schema[node].dataType.simpleString()
    changes = run_in_order(rows, ["_lane"], machine, f"{node} {kind}, at_us bigint, status string, last_seen_us bigint")
    return changes.select(
        node, "status", F.timestamp_micros("at_us").alias("at"), F.timestamp_micros("last_seen_us").alias("last_seen")
    )

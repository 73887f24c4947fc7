"""Deltas, rates, top lists, vector arithmetic and correlations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.operators import fleet, select as sel, series, vectors
from tidegauge.operators.aggregate import bucketed
from tidegauge.operators.select import TimeRange, by_name
from tidegauge.plans.ordered import Ordered, RunningSum
from tidegauge.sources.ingest import union_collectors
from tidegauge.workload.registry import AS_OF, COUNTERS, COUNTS, METRICS, q6, query

DAY = timedelta(days=1)
ORDER = ["ts", "event_id"]
SERIES = "(PARTITION BY name, node ORDER BY ts, event_id)"


@query(
    f"""WITH {METRICS} SELECT event_id, {q6(f"value - coalesce(lag(value) OVER {SERIES}, 0)")} AS delta FROM m"""
)
def delta_encode(spark, folder):
    deltas = series.delta_encode(fx.metrics(spark, folder), fx.KEYS, ORDER)
    return deltas.select("event_id", fx.comparable(F.col("delta")).alias("delta"))


@query(f"WITH {METRICS} SELECT event_id, {q6('value')} AS value FROM m")
def delta_decode(spark, folder):
    deltas = series.delta_encode(fx.metrics(spark, folder), fx.KEYS, ORDER).drop("value")
    return series.delta_decode(deltas, fx.KEYS, ORDER).select("event_id", fx.comparable(F.col("value")).alias("value"))


GROWTH = f"""{COUNTERS}, d AS (SELECT *, value - lag(value) OVER w AS dv, lag(ts) OVER w AS before FROM ct
    WINDOW w AS (PARTITION BY node, name ORDER BY ts, event_id)),
  g AS (SELECT event_id, node, name, ts, CASE WHEN dv < 0 THEN value ELSE dv END AS increase,
    (epoch_us(ts) - epoch_us(before)) / 1e6 AS seconds FROM d WHERE before IS NOT NULL)"""


@query(f"WITH {GROWTH} SELECT event_id, increase, seconds, {q6('increase / seconds')} AS rate FROM g")
def counter_rate(spark, folder):
    rates = series.counter_rate(fx.counters(spark, folder), ["node", "name"], ORDER)
    return rates.select("event_id", "increase", "seconds", fx.comparable(F.col("rate")).alias("rate"))


WINDOWS = f"""{GROWTH}, w AS (
  SELECT node, name, time_bucket(INTERVAL 6 HOUR, ts) + i * INTERVAL 6 HOUR AS window_end, increase
  FROM g, (SELECT unnest([1, 2, 3, 4]) AS i))"""


@query(
    f"""WITH {WINDOWS} SELECT node, name, window_end, window_end - INTERVAL 1 DAY AS window_start,
    {q6("sum(increase) / 86400.0")} AS rate FROM w GROUP BY 1, 2, 3"""
)
def rate_window(spark, folder):
    rates = series.rate_window(fx.counters(spark, folder), ["node", "name"], ORDER, DAY, timedelta(hours=6))
    return rates.select("node", "name", "window_end", "window_start", fx.comparable(F.col("rate")).alias("rate"))


@query(
    f"""WITH {WINDOWS} SELECT node, name, window_end, sum(increase) AS increase, count(*) AS samples
    FROM w GROUP BY 1, 2, 3"""
)
def increase_window(spark, folder):
    grown = series.increase_window(fx.counters(spark, folder), ["node", "name"], ORDER, DAY, timedelta(hours=6))
    return grown.drop("window_start")


CPU = """tick AS (
  SELECT node, time_bucket(INTERVAL 1 HOUR, ts) AS ts,
    CAST(coalesce(sum(k) FILTER (name = 'click'), 0) AS DOUBLE) AS u, CAST(coalesce(sum(k) FILTER (name = 'view'), 0) AS DOUBLE) AS s,
    CAST(coalesce(sum(k) FILTER (name = 'purchase'), 0) AS DOUBLE) AS i, CAST(coalesce(sum(k) FILTER (name = 'error'), 0) AS DOUBLE) AS w,
    CAST(coalesce(sum(k) FILTER (name = 'signup'), 0) AS DOUBLE) AS n
  FROM mk GROUP BY 1, 2)"""


@query(
    f"""WITH {COUNTS}, {CPU}, p AS (SELECT *, u + s + n + i + w AS total, lag(ts) OVER (PARTITION BY node ORDER BY ts) AS before FROM tick)
    SELECT node, ts, {q6("100 * u / total")} AS user_percent, {q6("100 * s / total")} AS system_percent,
    {q6("100 * i / total")} AS idle_percent, {q6("100 * w / total")} AS iowait_percent
    FROM p WHERE before IS NOT NULL AND total > 0"""
)
def cpu_percent(spark, folder):
    """Hourly ticks per node; the states are running totals, as the kernel reports them."""
    states = {"user": "click", "system": "view", "idle": "purchase", "iowait": "error", "nice": "signup"}
    ticks = bucketed(fx.counts_k(spark, folder), timedelta(hours=1)).groupBy("node", F.col("bucket").alias("ts")).agg(
        *[F.sum(F.when(F.col("name") == n, F.col("k")).otherwise(0)).cast("double").alias(f"in_{s}") for s, n in states.items()]
    )
    times = Ordered(ticks, ["node"], ["ts"]).scan(**{s: RunningSum(F.col(f"in_{s}")) for s in states}).frame()
    shares = series.cpu_percent(times, ["node"], ["ts"])
    return shares.select("node", "ts", *[fx.comparable(F.col(c)).alias(c) for c in shares.columns[2:]])


@query(
    f"""WITH {METRICS}, p AS (SELECT node, time_bucket(INTERVAL 1 DAY, ts) AS bucket, max(value) AS value FROM m
      WHERE name = 'purchase' GROUP BY 1, 2)
    SELECT * FROM (SELECT node, bucket, value, row_number() OVER (PARTITION BY bucket ORDER BY value DESC, node) AS rank FROM p)
    WHERE rank <= 3"""
)
def topk(spark, folder):
    points = vectors.vector(fx.metrics(spark, folder), "purchase", ["node"], DAY, fx.TIE, take="high")
    return series.top_k(points, 3, ["node"]).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""WITH {METRICS} SELECT event_id, node, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, event_id DESC) AS r
    FROM m WHERE ts BETWEEN {AS_OF} - INTERVAL 5 DAY AND {AS_OF}) WHERE r <= 60"""
)
def latest_n(spark, folder):
    samples = fx.metrics(spark, folder).select("event_id", "node", "ts", "value")
    return sel.latest_points(samples, fx.newest(samples), timedelta(days=5), 60, "event_id")


@query(
    """SELECT event_id, node, ts, old_status, status FROM (SELECT event_id, 'node-' || user_id AS node, ts, event_type AS status,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM events) WHERE old_status <> status"""
)
def status_changes(spark, folder):
    return fleet.status_changes(fx.heartbeats(spark, folder), "node", fx.TIE)


@query(
    f"""WITH {METRICS}, c AS (SELECT event_id, value - lag(value, 3) OVER {SERIES} AS dv,
      (epoch_us(ts) - epoch_us(lag(ts, 3) OVER {SERIES})) / 1e6 AS dt FROM m)
    SELECT event_id, floor(dv / dt * 1e9 + 0.3141592) / 1e9 AS change_per_second, abs(dv / dt) > 0.01 AS fast FROM c WHERE dt IS NOT NULL"""
)
def rate_of_change(spark, folder):
    changes = series.rate_of_change(fx.metrics(spark, folder), fx.KEYS, ORDER, 3)
    change = F.col("change_per_second")
    return changes.select(
        "event_id", (F.floor(change * 1e9 + 0.3141592) / 1e9).alias("change_per_second"), (F.abs(change) > 0.01).alias("fast")
    )


def _daily(name, alias):
    return f"{alias} AS (SELECT node, time_bucket(INTERVAL 1 DAY, ts) AS bucket, arg_max(value, ts) AS value FROM m WHERE name = '{name}' GROUP BY 1, 2)"


TWO = f"{METRICS}, {_daily('click', 'a')}, {_daily('view', 'b')}"


def _vectors(spark, folder):
    samples = fx.metrics(spark, folder)
    return [vectors.vector(samples, n, ["node"], DAY, fx.TIE) for n in ("click", "view")]


@query(
    f"""WITH {TWO} SELECT node, bucket, a.value AS left_value, b.value AS right_value, a.value > b.value * 2 AS breach
    FROM a JOIN b USING (node, bucket)"""
)
def vector_compare(spark, folder):
    both = vectors.combine(*_vectors(spark, folder), ["node", "bucket"], F.col("left") > F.col("right") * 2)
    return both.select("node", "bucket", F.col("left").alias("left_value"), F.col("right").alias("right_value"), F.col("value").alias("breach"))


@query(f"WITH {TWO} SELECT node, bucket, {q6('a.value / b.value')} AS value FROM a JOIN b USING (node, bucket)")
def vector_ratio(spark, folder):
    both = vectors.combine(*_vectors(spark, folder), ["node", "bucket"], F.try_divide("left", "right"))
    return both.select("node", "bucket", fx.comparable(F.col("value")).alias("value"))


@query(f"WITH {TWO} SELECT node, bucket, {q6('a.value - b.value')} AS value FROM a JOIN b USING (node, bucket)")
def vector_diff(spark, folder):
    both = vectors.combine(*_vectors(spark, folder), ["node", "bucket"], F.col("left") - F.col("right"))
    return both.select("node", "bucket", fx.comparable(F.col("value")).alias("value"))


@query(f"WITH {TWO} SELECT node, bucket, {q6('a.value / b.value')} AS value FROM a JOIN b USING (node, bucket)")
def load_per_cpu(spark, folder):
    ratio = vectors.load_per_cpu(fx.metrics(spark, folder), "click", "view", ["node"], DAY, fx.TIE)
    return ratio.select("node", "bucket", fx.comparable(F.col("value")).alias("value"))


@query(
    f"""WITH {METRICS} SELECT s.event_id, s.node, s.ts, s.value, e.deployed_at, e.deployed_value FROM (SELECT * FROM m WHERE name = 'signup') s
    ASOF LEFT JOIN (SELECT node, ts AS deployed_at, value AS deployed_value FROM m WHERE name = 'error') e
    ON s.node = e.node AND s.ts >= e.deployed_at"""
)
def annotation_overlay(spark, folder):
    samples = fx.metrics(spark, folder)
    points = by_name(samples, "signup").select("node", "event_id", "ts", "value")
    events = by_name(samples, "error").select(
        "node", "event_id", "ts", F.col("ts").alias("deployed_at"), F.col("value").alias("deployed_value")
    )
    return vectors.overlay(points, events, ["node"], ORDER, ["deployed_at", "deployed_value"])


@query(
    f"""WITH {METRICS}, e AS (SELECT * FROM m WHERE name = 'signup'), s AS (SELECT * FROM m WHERE name = 'error')
    SELECT e.event_id, e.node, e.ts, count(*) FILTER (s.ts <= e.ts) AS samples_before, {q6("avg(s.value) FILTER (s.ts <= e.ts)")} AS mean_before,
    count(*) FILTER (s.ts >= e.ts) AS samples_after, {q6("avg(s.value) FILTER (s.ts >= e.ts)")} AS mean_after
    FROM e LEFT JOIN s ON s.node = e.node AND s.ts BETWEEN e.ts - INTERVAL 12 HOUR AND e.ts + INTERVAL 12 HOUR GROUP BY 1, 2, 3"""
)
def event_correlation(spark, folder):
    samples = fx.metrics(spark, folder)
    events = by_name(samples, "signup").select("event_id", "node", "ts")
    found = vectors.correlate(events, by_name(samples, "error"), ["node"], "event_id", timedelta(hours=12), fx.TIE)
    return found.withColumns({c: fx.comparable(F.col(c)) for c in ("mean_before", "mean_after")})


@query(
    f"""WITH {METRICS} SELECT event_id, ts, node, value, name AS collector, CASE WHEN name = 'view' THEN usr END AS usr
    FROM m WHERE name IN ('click', 'view', 'error')""",
    key="union_collectors",
)
def union_collectors_query(spark, folder):
    samples = fx.metrics(spark, folder)
    parts = []
    for name in ("click", "view", "error"):
        extra = ["usr"] if name == "view" else []
        parts.append(by_name(samples, name).select("event_id", "ts", "node", "value", F.lit(name).alias("collector"), *extra))
    return union_collectors(parts)


@query(
    f"""WITH {METRICS} SELECT event_id, node, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, event_id) AS r FROM m
    WHERE name = 'click' AND node IN ('node-1', 'node-4', 'node-6') AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00')
    WHERE r <= 60"""
)
def fanout_nodes(spark, folder):
    span = TimeRange(datetime(2024, 1, 5), datetime(2024, 1, 20))
    chosen = sel.fan_out(fx.metrics(spark, folder), ["node-1", "node-4", "node-6"], ["click"], span, 60, "event_id")
    return chosen.select("event_id", "node", "ts", "value")

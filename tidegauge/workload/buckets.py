"""Downsampling, series lists, statistics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.operators import aggregate as ag, alerting, fleet, series
from tidegauge.operators.select import by_name
from tidegauge.workload.registry import AS_OF, COUNTERS, METRICS, NODES, alerts_sql, q6, query
from tidegauge.workload.selection import FOLD

DAY = timedelta(days=1)
HOUR = timedelta(hours=1)

STATUS = f"""CASE WHEN {AS_OF} - last_seen > INTERVAL 18 HOUR THEN 'offline'
    WHEN {AS_OF} - last_seen > INTERVAL 6 HOUR THEN 'unhealthy' ELSE 'healthy' END"""

# The rule "error > 80 for 6 h" per node.
ERRORS = f"{METRICS}, src AS (SELECT node, ts, event_id AS tie, event_id, value, value > 80 AS breach FROM m WHERE name = 'error')"
ALERTS = f"{ERRORS}, {alerts_sql('src', 'node', 'INTERVAL 6 HOUR')}"


def error_alerts(spark, folder, by=("node",), hold=timedelta(hours=6)):
    errors = by_name(fx.metrics(spark, folder), "error")
    breach = F.col("value") > 80
    return alerting.alerts(errors, list(by), fx.TIE, breach, F.lit(hold))


@query(
    f"""WITH {METRICS} SELECT name, node, time_bucket(INTERVAL 1 DAY, ts) AS bucket, {q6(FOLD)} AS value,
    count(*) AS points FROM m GROUP BY 1, 2, 3"""
)
def downsample_pairwise(spark, folder):
    points = ag.downsample_pairwise(fx.metrics(spark, folder), fx.KEYS, DAY, fx.TIE)
    return points.withColumn("value", fx.comparable(F.col("value")))


@query(
    f"""WITH {METRICS} SELECT name, node, time_bucket(INTERVAL 1 DAY, ts) AS bucket, {q6("avg(value)")} AS mean,
    min(value) AS low, max(value) AS high, {q6("sum(value)")} AS total, count(*) AS points,
    arg_max(value, ts) AS last FROM m GROUP BY 1, 2, 3"""
)
def downsample_avg(spark, folder):
    points = ag.downsample_mean(fx.metrics(spark, folder), fx.KEYS, DAY, fx.TIE)
    return points.withColumns({c: fx.comparable(F.col(c)) for c in ("mean", "total")})


@query(
    f"""WITH {METRICS} SELECT series_key, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts
    FROM m GROUP BY series_key"""
)
def group_series(spark, folder):
    return fx.metrics(spark, folder).groupBy("series_key").agg(
        F.count(F.lit(1)).alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    f"""WITH {METRICS}, p AS (SELECT name, node, time_bucket(INTERVAL 1 DAY, ts) AS bucket, max(value) AS value
    FROM m GROUP BY 1, 2, 3)
    SELECT name, node, time_bucket(INTERVAL 10 DAY, bucket, TIMESTAMP '0001-01-01 00:00:00') AS chunk,
    string_agg(strftime(bucket, '%Y-%m-%d') || '=' || CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS VARCHAR), ' ' ORDER BY bucket) AS samples
    FROM p GROUP BY 1, 2, 3"""
)
def matrix_result(spark, folder):
    points = ag.downsample_mean(fx.metrics(spark, folder), fx.KEYS, DAY)
    rows = ag.matrix(points.select(*fx.KEYS, "bucket", F.col("high").alias("value")), fx.KEYS, DAY, points_per_row=10)
    text = F.transform(
        "samples",
        lambda s: F.concat(F.date_format(s["ts"], "yyyy-MM-dd"), F.lit("="), F.floor(s["value"] * 100 + 0.5)),
    )
    return rows.withColumn("samples", F.array_join(text, " "))


@query(f"WITH {METRICS} SELECT DISTINCT name, series_key FROM m")
def list_series(spark, folder):
    return ag.series_list(fx.metrics(spark, folder), ["name", "series_key"])


@query("SELECT DISTINCT unnest(['collector', 'node', 'user']) AS label FROM events")
def label_names(spark, folder):
    return ag.label_names(fx.labelled(spark, folder))


@query(f"WITH {METRICS} SELECT DISTINCT usr AS label_value FROM m WHERE name = 'signup'")
def label_values(spark, folder):
    return ag.label_values(fx.labelled(spark, folder), "user", metric="signup")


@query(
    f"""WITH {ALERTS}, {NODES} SELECT (SELECT count(*) FROM m) AS total_metrics, (SELECT count(*) FROM nd) AS total_nodes,
    (SELECT count(*) FROM alerts) AS total_alerts, (SELECT min(ts) FROM m) AS oldest_metric, (SELECT max(ts) FROM m) AS newest_metric"""
)
def store_stats(spark, folder):
    return ag.store_stats(fx.metrics(spark, folder), fx.nodes(spark, folder), error_alerts(spark, folder))


def checked_nodes(spark, folder):
    as_of = fx.newest(fx.table(spark, folder, "events"))
    return fleet.check_health(fx.nodes(spark, folder), as_of, timedelta(hours=6))


@query(
    f"""WITH {NODES}, s AS (SELECT {STATUS} AS status FROM nd) SELECT count(*) AS total_nodes,
    count(*) FILTER (status = 'healthy') AS healthy_nodes, count(*) FILTER (status = 'unhealthy') AS unhealthy_nodes,
    count(*) FILTER (status = 'offline') AS offline_nodes FROM s"""
)
def node_stats(spark, folder):
    return ag.node_stats(checked_nodes(spark, folder))


@query(f"WITH {METRICS} SELECT node, count(*) AS metrics_count FROM m GROUP BY node")
def node_metric_count(spark, folder):
    return ag.node_metric_count(fx.metrics(spark, folder))


@query(
    f"""WITH {ALERTS}, {NODES} SELECT (SELECT count(*) FROM nd) AS total_nodes,
    (SELECT count(*) FROM nd WHERE {STATUS} = 'healthy') AS active_nodes, (SELECT count(*) FROM m) AS total_metrics,
    (SELECT count(*) FROM alerts WHERE resolved_at IS NULL) AS active_alerts"""
)
def overview_cards(spark, folder):
    nodes = checked_nodes(spark, folder).withColumn("online", F.col("status") == "healthy")
    return ag.overview(nodes, fx.metrics(spark, folder), error_alerts(spark, folder))


@query(
    f"""WITH {ALERTS}, {NODES} SELECT (SELECT count(*) FROM alerts WHERE resolved_at IS NULL) AS active_alerts,
    (SELECT count(*) FROM nd) AS nodes"""
)
def active_alert_count(spark, folder):
    return ag.active_counts(fx.nodes(spark, folder), error_alerts(spark, folder))


@query(
    f"""WITH {COUNTERS}, d AS (SELECT *, value - lag(value) OVER w AS dv, ts - lag(ts) OVER w AS dt FROM ct
      WINDOW w AS (PARTITION BY node, name ORDER BY ts, event_id)),
    r AS (SELECT node, name, time_bucket(INTERVAL 1 DAY, ts) AS bucket,
      sum(CASE WHEN dv < 0 THEN value ELSE dv END) / 86400.0 AS rate FROM d WHERE dt IS NOT NULL GROUP BY 1, 2, 3)
    SELECT node, bucket, {q6("sum(rate)")} AS value FROM r GROUP BY 1, 2"""
)
def agg_sum_by(spark, folder):
    rates = series.rate_window(fx.counters(spark, folder), ["node", "name"], ["ts", "event_id"], DAY, DAY)
    summed = ag.sum_by(rates, ["node", "window_start"], "rate")
    return summed.select("node", F.col("window_start").alias("bucket"), fx.comparable(F.col("value")).alias("value"))


@query(
    f"""WITH {METRICS} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket,
    CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 51 ELSE CAST(floor(value / 10) AS BIGINT) + 1 END AS bin,
    count(*) AS points FROM m GROUP BY 1, 2"""
)
def heatmap(spark, folder):
    return ag.heatmap(fx.metrics(spark, folder), HOUR, 0, 500, 50).withColumn("bin", F.col("bin").cast("bigint"))


@query(
    f"""WITH {METRICS} SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket,
    {q6("avg(value) FILTER (node = 'node-1')")} AS node_1, {q6("avg(value) FILTER (node = 'node-2')")} AS node_2,
    {q6("avg(value) FILTER (node = 'node-3')")} AS node_3 FROM m WHERE name = 'view' AND node IN ('node-1', 'node-2', 'node-3')
    GROUP BY 1"""
)
def host_compare(spark, folder):
    hosts = ["node-1", "node-2", "node-3"]
    views = by_name(fx.metrics(spark, folder), "view").filter(F.col("node").isin(hosts))
    wide = ag.compare_hosts(views, hosts, DAY)
    return wide.select("bucket", *[fx.comparable(F.col(h)).alias(h.replace("-", "_")) for h in hosts])


@query(f"WITH {METRICS} SELECT name, node, max(ts) AS ts, floor(arg_max(value, ts) * 100 + 0.5) / 100 AS value FROM m GROUP BY 1, 2")
def last_value(spark, folder):
    return ag.last_values(fx.metrics(spark, folder), fx.KEYS, fx.TIE)

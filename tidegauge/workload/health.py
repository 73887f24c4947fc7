"""Node registry, heartbeats, sessions, fleet report, feed."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.functions.timing import instant
from tidegauge.operators import feed, fleet, report
from tidegauge.operators.select import by_name
from tidegauge.plans.small import spec_table
from tidegauge.workload.buckets import ALERTS, STATUS, checked_nodes, error_alerts
from tidegauge.workload.registry import AS_OF, METRICS, NODES, query

GAP = timedelta(hours=6)


@query(
    """SELECT 'node-' || user_id AS node, arg_max(event_type, ts) AS status_text, arg_max(value, ts) AS version,
    min(ts) AS created_at, max(ts) AS last_seen, count(*) AS session_count, 'healthy' AS status FROM events GROUP BY user_id"""
)
def node_registry(spark, folder):
    registrations = fx.table(spark, folder, "events").select(
        F.concat(F.lit("node-"), F.col("user_id")).alias("node"), "ts", "event_id",
        F.col("event_type").alias("status_text"), F.col("value").alias("version"),
    )
    return fleet.registry(registrations, "node", ["ts", "event_id"], ["status_text", "version"])


@query("SELECT 'node-' || user_id AS node, max(ts) AS last_seen, count(*) AS heartbeats FROM events GROUP BY user_id")
def heartbeat_update(spark, folder):
    return fleet.last_seen(fx.heartbeats(spark, folder))


@query(f"WITH {NODES} SELECT id, os, created_at, last_seen, heartbeats, {STATUS} AS status FROM nd")
def health_check(spark, folder):
    return checked_nodes(spark, folder)


@query(
    """SELECT event_id, node, ts, down_since, epoch_us(ts) - epoch_us(down_since) AS silence_us FROM (SELECT event_id, 'node-' || user_id AS node, ts,
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS down_since FROM events) WHERE ts - down_since > INTERVAL 6 HOUR"""
)
def node_recovered(spark, folder):
    return fleet.recoveries(fx.heartbeats(spark, folder), GAP, fx.TIE).drop("status")


def transitions_sql(as_of: str) -> str:
    """CTE ``hl`` (node, status, at, last_seen): all status changes up to a point in time."""
    return f"""hb AS (SELECT 'node-' || user_id AS node, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
  quiet AS (SELECT node, before AS since, ts - before AS silence FROM hb WHERE before IS NOT NULL
    UNION ALL SELECT node, max(ts), {as_of} - max(ts) FROM hb GROUP BY node),
  hl AS (SELECT * FROM (SELECT node, 'healthy' AS status, ts AS "at", ts AS last_seen FROM hb WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR
    UNION ALL SELECT node, 'unhealthy', since + INTERVAL 6 HOUR, since FROM quiet WHERE silence > INTERVAL 6 HOUR
    UNION ALL SELECT node, 'offline', since + INTERVAL 18 HOUR, since FROM quiet WHERE silence > INTERVAL 18 HOUR) x WHERE x."at" <= {as_of})"""


@query(f"WITH {transitions_sql(AS_OF)} SELECT * FROM hl")
def health_log(spark, folder):
    """Every status change of every node."""
    beats = fx.heartbeats(spark, folder)
    return fleet.transitions(beats, GAP, fx.TIE, fx.newest(beats))


SESSIONS = """gaps AS (SELECT 'node-' || user_id AS node, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, user_id FROM events),
  numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM gaps),
  ses AS (SELECT node, CAST(no AS BIGINT) AS session_no, min(ts) AS started, max(ts) AS last_seen, count(*) AS beats,
    max(ts) + INTERVAL 6 HOUR AS ended FROM numbered GROUP BY 1, 2)"""


@query(f"WITH {SESSIONS} SELECT * FROM ses")
def session_timeout(spark, folder):
    return fleet.sessions(fx.heartbeats(spark, folder), GAP, fx.TIE)


@query(
    f"""WITH {METRICS}, u AS (SELECT usr, max(ts) AS last_seen, max(value) FILTER (name = 'error') AS uptime_k,
      arg_max(value, ts) FILTER (name = 'view') AS mem, arg_max(value, ts) FILTER (name = 'click') AS disk, arg_max(value, ts) FILTER (name = 'error') AS up
      FROM m GROUP BY usr)
    SELECT usr AS id, {AS_OF} - last_seen <= INTERVAL 18 HOUR AS online,
    CASE WHEN up IS NULL OR up = 0 THEN 'N/A' ELSE CAST(CAST(floor(up * 10000 / 86400) AS BIGINT) AS VARCHAR) || 'd '
      || CAST(CAST(floor((up * 10000 % 86400) / 3600) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor((up * 10000 % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm' END AS uptime,
    CASE WHEN mem IS NULL OR mem = 0 THEN 'N/A' ELSE mb.n || ' MB' END AS memory,
    CASE WHEN disk IS NULL THEN NULL WHEN disk >= 90 THEN 'red' WHEN disk >= 80 THEN 'yellow' ELSE 'green' END AS disk_band
    FROM u, LATERAL (SELECT CAST(CAST(floor(mem) AS BIGINT) + 1 AS VARCHAR) AS n) mb"""
)
def node_report(spark, folder):
    """Latest metrics per node pivoted and worded; memory is scaled to whole MB between 1 and 1023."""
    samples = fx.metrics(spark, folder).withColumn("node", F.col("usr"))
    as_of = fx.newest(samples)
    names = {"uptime_seconds": "error", "memory_bytes": "view", "disk_percent": "click"}
    latest = report.latest_by_name(samples, "node", names, fx.TIE)
    scaled = latest.withColumns(
        {
            "uptime_seconds": F.col("uptime_seconds") * 10000,
            "memory_bytes": F.when(F.col("memory_bytes") != 0, (F.floor("memory_bytes") + 1) * 1048576.0),
            "online": instant(as_of) - F.col("last_seen") <= F.lit(timedelta(hours=18)),
        }
    )
    return scaled.select(
        F.col("node").alias("id"),
        "online",
        report.uptime_text(F.col("uptime_seconds")).alias("uptime"),
        report.bytes_text(F.col("memory_bytes")).alias("memory"),
        report.band(F.col("disk_percent")).alias("disk_band"),
    )


FEED = f"""{ALERTS}, {NODES}, feed AS (
  SELECT 'metrics' AS type, ts, node AS node_id, '{{"event_id":' || event_id || ',"name":"' || name || '"}}' AS data FROM m
  UNION ALL SELECT 'alert', active_at, node, '{{"state":"' || state || '","samples":' || samples || '}}' FROM alerts
  UNION ALL SELECT 'node_status', last_seen, id, '{{"id":"' || id || '","status":"' || {STATUS} || '"}}' FROM nd)"""


def _feed(spark, folder):
    samples, alerts, nodes = fx.metrics(spark, folder), error_alerts(spark, folder), checked_nodes(spark, folder)
    return feed.merged(
        [
            feed.envelope(samples, "metrics", F.col("ts"), F.col("node"), ["event_id", "name"]),
            feed.envelope(alerts, "alert", F.col("active_at"), F.col("node"), ["state", "samples"]),
            feed.envelope(nodes, "node_status", F.col("last_seen"), F.col("id"), ["id", "status"]),
        ]
    )


@query(f"WITH {FEED} SELECT * FROM feed")
def message_feed(spark, folder):
    return _feed(spark, folder)


@query(
    f"""WITH {FEED}, sub AS (SELECT * FROM (VALUES ('a', 'all'), ('a', 'alert'), ('b', 'alert'), ('b', 'node_status'), ('c', 'ping'), ('d', 'deploy'), ('d', 'alert')) t(client, topic)),
    more AS (SELECT type, ts, node_id, data FROM feed UNION ALL
      SELECT 'deploy', ts, node, '{{"event_id":' || event_id || '}}' FROM m WHERE name = 'purchase')
    SELECT DISTINCT client, type, ts, node_id, data FROM more JOIN sub ON sub.topic = more.type OR sub.topic = 'all'"""
)
def topic_filter(spark, folder):
    """Messages of a type that the feed did not know before reach who asks for it, and who asks for all."""
    rows = [("a", "all"), ("a", "alert"), ("b", "alert"), ("b", "node_status"), ("c", "ping"), ("d", "deploy"), ("d", "alert")]
    deploys = by_name(fx.metrics(spark, folder), "purchase")
    every = feed.merged([_feed(spark, folder), feed.envelope(deploys, "deploy", F.col("ts"), F.col("node"), ["event_id"])])
    return feed.delivered(every, spec_table(spark, rows, "client string, topic string"))

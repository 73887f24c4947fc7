"""Streaming queries, run to the end of the given events.

What a stream has not emitted yet is still open: rows, windows and sessions
past the final watermark, which lies one hour before the newest event.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.operators.fleet import latest_rows
from tidegauge.plans import scratch
from tidegauge.streaming import monitors as mo, outbox as ob
from tidegauge.streaming.run import ProgressTotals, drain, drain_updates, read_events
from tidegauge.workload.buckets import ALERTS
from tidegauge.workload.models import EWMA
from tidegauge.workload.alerts import RULE_LOG, rule_feed
from tidegauge.workload.health import SESSIONS, transitions_sql
from tidegauge.workload.registry import AS_OF, METRICS, q6, query

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)
ERROR_WATERMARK = "(date_trunc('milliseconds', (SELECT max(ts) FROM events WHERE event_type = 'error')) - INTERVAL 1 HOUR)"
WATERMARK = f"(date_trunc('milliseconds', {AS_OF}) - INTERVAL 1 HOUR)"


def samples(spark, folder, *reading):
    return read_events(spark, folder, *reading).select(
        "event_id", "ts", "value", F.col("event_type").alias("name"),
        F.concat(F.lit("node-"), F.col("user_id") % 10).alias("node"),
        F.concat(F.lit("node-"), F.col("user_id")).alias("machine"),
        fx.k_of(F.col("props")).cast("double").alias("k"),
    )


def plain(df):
    """Timestamps without zone, as the tables have them."""
    stamps = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


@query(f"WITH {METRICS} SELECT event_id, ts, name, node, value FROM m")
def stream_ingest(spark, folder):
    """Every sample arrives twice within a micro-batch and is stored once."""
    arrivals = samples(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    stored = mo.deduplicated(arrivals, ["event_id", "name", "node"], HOUR)
    return plain(drain(stored.select("event_id", "ts", "name", "node", "value"), "ingest"))


@query(
    f"""WITH {METRICS} SELECT * FROM (SELECT name, node, time_bucket(INTERVAL 1 DAY, ts) AS bucket, {q6("avg(value)")} AS mean, min(value) AS low,
    max(value) AS high, count(*) AS points FROM m GROUP BY 1, 2, 3) WHERE bucket + INTERVAL 1 DAY <= {WATERMARK}"""
)
def stream_downsample(spark, folder):
    rows = drain(mo.downsampled(samples(spark, folder), fx.KEYS, DAY, HOUR), "downsample")
    return plain(rows).withColumn("mean", fx.comparable(F.col("mean")))


@query(
    f"""WITH {METRICS}, mk AS (SELECT event_id, ts, event_type AS name, 'node-' || (user_id % 10) AS node, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
    d AS (SELECT name, node, ts, k - lag(k) OVER w AS dv, k FROM mk WINDOW w AS (PARTITION BY name, node ORDER BY ts, event_id)),
    p AS (SELECT name, node, time_bucket(INTERVAL 6 HOUR, ts) + i * INTERVAL 6 HOUR AS window_end, CASE WHEN dv < 0 THEN k ELSE dv END AS inc
      FROM d, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE dv IS NOT NULL)
    SELECT name, node, window_end, {q6("sum(inc) / 86400.0 * 1000")} AS rate FROM p WHERE window_end <= {WATERMARK} GROUP BY 1, 2, 3"""
)
def stream_rate_sliding(spark, folder):
    """The event property k taken as a counter that often resets."""
    counters = samples(spark, folder).drop("value").withColumnRenamed("k", "value")
    rates = mo.sliding_rate(counters, fx.KEYS, "event_id", DAY, timedelta(hours=6), HOUR, DAY)
    rows = plain(drain(rates, "sliding-rate"))
    return rows.withColumn("rate", fx.comparable(F.col("rate") * 1000))


@query(f"WITH {SESSIONS} SELECT node AS machine, started, last_seen, ended, beats FROM ses WHERE ended <= {WATERMARK}")
def stream_sessions(spark, folder):
    return plain(drain(mo.activity_sessions(samples(spark, folder), "machine", timedelta(hours=6), HOUR), "sessions"))


@query(
    f"""WITH {ALERTS}, tr AS (SELECT node, 'pending' AS transition, active_at AS at, active_at FROM alerts
      UNION ALL SELECT node, 'firing', fired_at, active_at FROM alerts WHERE fired_at IS NOT NULL
      UNION ALL SELECT node, 'resolved', resolved_at, active_at FROM alerts WHERE resolved_at IS NOT NULL)
    SELECT * FROM tr WHERE tr."at" <= {ERROR_WATERMARK}"""
)
def stream_alerts(spark, folder):
    errors = samples(spark, folder).filter(F.col("name") == "error")
    changes = mo.alert_transitions(errors, ["node"], "event_id", 80.0, timedelta(hours=6), HOUR, DAY)
    return plain(drain(changes, "alerts")).drop("value")


@query(
    f"""WITH RECURSIVE {ALERTS}, f AS (SELECT DISTINCT node, epoch_us(fired_at) AS t FROM alerts WHERE fired_at <= {ERROR_WATERMARK}),
    sent AS (SELECT node, min(t) AS t FROM f GROUP BY 1
      UNION ALL
      SELECT * FROM (SELECT s.node, (SELECT min(f.t) FROM f WHERE f.node = s.node AND f.t >= s.t + 172800000000) AS t FROM sent s) WHERE t IS NOT NULL)
    SELECT node, make_timestamp(t) AS sent_at, channel FROM sent, (SELECT unnest(['slack', 'email']) AS channel)"""
)
def stream_outbox(spark, folder):
    """Messages of alerts that fire, at most one in two days for each node, written by a sink that replays cannot double."""
    errors = samples(spark, folder).filter(F.col("name") == "error")
    notices = mo.firing_notices(errors, ["node"], "event_id", 80.0, timedelta(hours=6), HOUR, DAY)
    sent = ob.cooled_down(notices, ["node"], "at_us", 2 * DAY, slot=DAY)
    path = scratch.new_folder(spark, "outbox")
    ob.deliver(sent, path, scratch.new_folder(spark, "outbox-state"), ["node"], ["slack", "email"]).awaitTermination()
    return plain(spark.read.parquet(path)).select("node", "sent_at", "channel")


@query(
    f"""WITH {METRICS}, pt AS (SELECT name, node, ts, value, row_number() OVER (PARTITION BY name, node ORDER BY ts, event_id) AS rn FROM m WHERE ts <= {WATERMARK}),
    rf AS (SELECT name, node, rn, ts AS "at" FROM pt WHERE least(rn, 1000) % 20 = 0),
    wn AS (SELECT rf.*, p.value, p.rn - greatest(rf.rn - 1000, 0) - 1 AS x, hour(p.ts) AS h FROM rf JOIN pt p ON p.name = rf.name AND p.node = rf.node AND p.rn <= rf.rn AND p.rn > rf.rn - 1000),
    ft AS (SELECT name, node, rn, "at", count(*) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM wn GROUP BY ALL),
    hr AS (SELECT name, node, rn, h, avg(value - intercept - slope * x) AS mean, sum((value - intercept - slope * x) ** 2) AS sq, count(*) AS c FROM wn JOIN ft USING (name, node, rn) GROUP BY ALL),
    sn AS (SELECT name, node, rn, sum(mean) / 24 AS centre, sum(sq - c * mean * mean) / sum(c) AS inside, coalesce(max(mean) FILTER (h = 6), 0) AS six FROM hr GROUP BY ALL)
    SELECT name, node, "at", n, {q6("slope")} AS slope, {q6("intercept")} AS intercept, {q6("six - centre")} AS six, {q6("greatest(inside + centre * centre, 0.01)")} AS variance
    FROM ft JOIN sn USING (name, node, rn)"""
)
def stream_refit(spark, folder):
    """Forecast models that a stream fits again at every twentieth point of a series; of the season the hour from six on is shown."""
    models = mo.refits(samples(spark, folder), fx.KEYS, "event_id", HOUR, every=20, slot=DAY)
    rows = plain(drain(models, "refit")).withColumn("six", F.get("season", 6)).drop("season")
    return rows.withColumns({c: fx.comparable(F.col(c)) for c in ("slope", "intercept", "six", "variance")})


@query(f"""WITH {RULE_LOG} SELECT * FROM rule_log l WHERE l."at" <= {WATERMARK}""")
def stream_rules(spark, folder):
    """Rules of every metric change while the samples stream in; the log is that of the batch."""
    rows = samples(spark, folder)
    log = mo.rule_alerts(*rule_feed(rows), ["node"], "event_id", HOUR, DAY)
    return plain(drain(log, "rules")).drop("value")


@query(
    f"""WITH {EWMA} SELECT event_id, {q6("mean_before")} AS mean_before, {q6("CASE WHEN var_before > 0 THEN abs(value - mean_before) / (3 * sqrt(var_before)) WHEN value <> mean_before THEN 1 ELSE 0 END")} AS score,
    abs(value - mean_before) > 3 * sqrt(var_before) AS is_anomaly FROM ew JOIN (SELECT event_id, ts FROM events) USING (event_id)
    WHERE mean_before IS NOT NULL AND ts <= {WATERMARK}"""
)
def stream_ewma(spark, folder):
    scores = drain(mo.ewma_scores(samples(spark, folder), fx.KEYS, "event_id", 0.2, 3.0, HOUR, DAY), "ewma")
    return scores.select(
        "event_id", fx.comparable(F.col("mean_before")).alias("mean_before"), fx.comparable(F.col("score")).alias("score"), "is_anomaly"
    )


@query(f"WITH {METRICS} SELECT name, node, max(ts) AS ts, arg_max(value, ts) AS value FROM m GROUP BY 1, 2")
def stream_live_last(spark, folder):
    """The stored updates reduced to the newest per series, which is what a chart shows."""
    updates, _ = drain_updates(mo.live_last(samples(spark, folder), fx.KEYS, "event_id"), "live")
    return plain(latest_rows(updates, fx.KEYS, ["batch"], ["ts", "value"]))


@query(f"""WITH {transitions_sql(WATERMARK)} SELECT node AS machine, status, "at", last_seen FROM hl""")
def health_stream(spark, folder):
    """All status changes of every node, up to the final watermark."""
    return plain(drain(mo.health(samples(spark, folder), "machine", timedelta(hours=6), HOUR, DAY), "health"))


CUT = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query(
    f"""SELECT count(*) FILTER (ts < {CUT} AND ts < date_trunc('milliseconds', (SELECT max(ts) FROM events WHERE ts >= {CUT} AND event_id % 2 = 0)) - INTERVAL 1 HOUR) AS late_rows,
    count(*) AS rows_seen FROM events"""
)
def stream_late(spark, folder):
    """The earlier half of the events arrives last, after the watermark has passed it.

    Arrival files are written one slice after another; late rows are judged by
    the watermark of the batch before the previous one, hence three slices.
    """
    events = fx.table(spark, folder, "events")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    late = F.col("ts") < F.lit(ends["a"] + (ends["b"] - ends["a"]) / 2)
    arrivals = scratch.new_folder(spark, "arrivals")
    for part in (~late & (F.col("event_id") % 2 == 0), ~late & (F.col("event_id") % 2 != 0), late):
        events.filter(part).repartition(SLICE_FILES, "event_id").write.mode("append").parquet(arrivals)
    return late_report(samples(spark, arrivals, "*.parquet", SLICE_FILES), HOUR)


SLICE_FILES = 4


def late_report(rows, delay):
    """Late and seen row counts of a de-duplicated ingest, added up batch by batch.

    De-duplication sees single rows; an aggregation would count late groups.
    """
    with ProgressTotals(rows.sparkSession) as totals:
        drain_updates(mo.deduplicated(rows, ["event_id"], delay), "late")
    return rows.sparkSession.createDataFrame([(totals.late, totals.seen)], "late_rows bigint, rows_seen bigint")

"""Ingest, upserts, exports, retention."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.functions import labels as lb
from tidegauge.functions.timing import micros, utc_date
from tidegauge.operators import retention as rt, rollups as ru, summaries as sm
from tidegauge.operators.select import TimeRange, in_range
from tidegauge.plans import scratch
from tidegauge.sources import export as ex, ingest as ing, tables, upsert as up
from tidegauge.workload.registry import AS_OF, METRICS, q6, query
from tidegauge.workload.selection import END, START

DAY = timedelta(days=1)


def batches(spark, folder):
    """Events of an hour and a user as agent batches of at most 1000; the type code is the event's number mod 5."""
    hour = F.date_trunc("hour", F.col("ts"))
    metric = F.struct(
        F.col("event_type").alias("name"),
        "value",
        (micros(F.col("ts")) * 1000).alias("timestamp"),
        F.create_map(F.lit("user"), F.concat(F.lit("user-"), F.col("user_id")), F.lit("node"), F.lit("spoofed")).alias("labels"),
        (F.col("event_id") % 5).cast("int").alias("type"),
        F.lit("").alias("help"),
        F.col("event_id").cast("string").alias("unit"),
    )
    return fx.table(spark, folder, "events").groupBy("user_id", hour.alias("sent_at"), F.floor(F.col("event_id") / 1000)).agg(
        F.collect_list(metric).alias("metrics"), F.min("event_id").alias("batch_seq")
    ).select(
        F.lit("unknown").alias("node_id"), F.concat(F.lit("session-"), F.col("user_id")).alias("session_id"), "batch_seq", "sent_at", "metrics"
    )


def sessions(spark, folder):
    """Every third customer-numbered agent has no open session."""
    users = fx.table(spark, folder, "events").select("user_id").distinct().filter(F.col("user_id") % 3 != 0)
    return users.select(
        F.concat(F.lit("session-"), F.col("user_id")).alias("session_id"), F.concat(F.lit("node-"), F.col("user_id") % 10).alias("node_id")
    )


TYPE = "CASE event_id % 5 WHEN 0 THEN 'gauge' WHEN 1 THEN 'counter' WHEN 2 THEN 'histogram' WHEN 3 THEN 'summary' ELSE 'unknown' END"


@query(
    f"""SELECT CAST(event_id AS VARCHAR) AS unit, 'session-' || user_id AS session_id, event_type AS name, value, ts, epoch_us(ts) * 1000 AS ts_ns,
    'node=spoofed,user=user-' || user_id || ',' AS series_key, {TYPE} AS type FROM events"""
)
def ingest_batches(spark, folder):
    rows = ing.unpack_batches(batches(spark, folder))
    return rows.select(
        "unit", "session_id", "name", "value", F.col("ts").cast("timestamp_ntz").alias("ts"), "ts_ns",
        lb.series_key(F.col("labels")).alias("series_key"), "type",
    )


@query(
    """SELECT 'session-' || user_id AS session_id, CASE WHEN user_id % 3 <> 0 THEN 'node-' || (user_id % 10) END AS node_id,
    count(*) AS samples, user_id % 3 <> 0 AS accepted FROM events GROUP BY user_id"""
)
def session_lookup(spark, folder):
    arrived, open_sessions = batches(spark, folder), sessions(spark, folder)
    accepted = ing.accept_sessions(arrived, open_sessions).withColumn("accepted", F.lit(True))
    rejected = ing.reject_sessions(arrived, open_sessions).withColumns({"accepted": F.lit(False), "node_id": F.lit(None).cast("string")})
    return accepted.unionByName(rejected).groupBy("session_id", "node_id", "accepted").agg(F.sum(F.size("metrics")).cast("bigint").alias("samples"))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts,
    CASE WHEN event_id % 7 = 0 THEN epoch_us(date_trunc('day', ts)) * 1000 ELSE epoch_us(ts) * 1000 END AS ts_ns FROM events"""
)
def ts_default(spark, folder):
    arrival = F.date_trunc("day", F.col("ts"))
    raw = fx.table(spark, folder, "events").select(
        "event_id", arrival.alias("arrived"), F.when(F.col("event_id") % 7 == 0, F.lit(0)).otherwise(micros(F.col("ts")) * 1000).alias("ts_ns"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return ing.default_time(raw, F.col("arrived")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "ts_ns")


@query("SELECT event_id, 'collector=system,node=node-' || (user_id % 10) || ',user=user-' || user_id || ',' AS series_key FROM events")
def label_enrich(spark, folder):
    samples = fx.labelled(spark, folder).withColumn("home", F.col("labels")["node"])
    spoofed = samples.withColumn("labels", lb.with_labels(F.col("labels"), node=F.lit("spoofed")))
    enriched = ing.enrich(spoofed, F.col("home"), F.lit("system"))
    return enriched.select("event_id", lb.series_key(F.col("labels")).alias("series_key"))


@query("SELECT event_id, ts, event_type AS name, value + 1 AS value FROM events")
def metric_upsert(spark, folder):
    """Every sample arrives twice; the second arrival carries the value plus one."""
    first = fx.labelled(spark, folder).withColumns({"ts_ns": micros(F.col("ts")) * 1000, "arrival": F.lit(1)})
    second = first.withColumns({"value": F.col("value") + 1, "arrival": F.lit(2)})
    return ing.upsert_samples(first.unionByName(second), ["arrival", "event_id"]).select("event_id", "ts", "name", "value")


@query(
    """SELECT event_id, event_type AS name, ts, value, 'node-' || (user_id % 10) AS node_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_id % 3 = 0 THEN 'counter' ELSE 'gauge' END AS type FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0"""
)
def json_decode(spark, folder):
    """Stored pairs rebuilt from events; some bodies are cut short and some keys have no time."""
    events, text = fx.table(spark, folder, "events"), F.lit
    body = F.to_json(
        F.struct(
            F.col("value").alias("v"),
            F.create_map(text("k"), fx.k_of(F.col("props")).cast("string")).alias("l"),
            F.concat(text("node-"), F.col("user_id") % 10).alias("n"),
            F.when(F.col("event_id") % 3 == 0, "counter").otherwise("odd").alias("t"),
        )
    )
    ns = F.when(F.col("event_id") % 13 == 0, text("soon")).otherwise((micros(F.col("ts")) * 1000).cast("string"))
    pairs = events.select(
        "event_id",
        F.concat_ws(":", text("metric"), "event_type", ns, text("0123456789abcdef")).alias("key"),
        F.when(F.col("event_id") % 11 == 0, F.substring(body, 1, 12)).otherwise(body).alias("value"),
    )
    good = ing.decode_stored(pairs).filter("ok")
    return good.select(
        "event_id", "name", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "node_id", F.col("labels")["k"].cast("bigint").alias("k"), "type"
    )


@query("SELECT 'node-' || user_id AS node, max(ts) AS ts, arg_max(event_type, ts) AS status, max(event_id) AS event_id FROM events GROUP BY user_id")
def node_upsert(spark, folder):
    return ing.last_write(fx.heartbeats(spark, folder), ["node"], ["ts", "event_id"])


@query(
    f"""WITH {METRICS} SELECT name || '/' || node AS id, arg_max(CASE WHEN value > 80 THEN 'firing' ELSE 'resolved' END, ts) AS state,
    max(ts) AS ts, arg_max(value, ts) AS value FROM m GROUP BY 1"""
)
def alert_upsert(spark, folder):
    saved = fx.metrics(spark, folder).select(
        F.concat_ws("/", "name", "node").alias("id"), F.when(F.col("value") > 80, "firing").otherwise("resolved").alias("state"), "ts", "value", "event_id"
    )
    return ing.last_write(saved, ["id"], ["ts", "event_id"]).drop("event_id")


@query(
    """SELECT event_id, ts, event_type AS name, CASE WHEN event_id % 5 = 0 AND ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-14 00:00:00' THEN value + 2
    WHEN event_id % 3 = 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-10 00:00:00' THEN value + 1 ELSE value END AS value FROM events"""
)
def table_upsert(spark, folder):
    """A stored table after two overlapping batches of corrections, the second delivered twice."""
    path = scratch.new_folder(spark, "upserted")
    rows = fx.metrics(spark, folder).select("event_id", "ts", "name", "value", F.lit(0).alias("arrival"))
    tables.store(rows, path)
    for arrival, every, first, last in ((1, 3, 5, 10), (2, 5, 8, 14), (2, 5, 8, 14)):
        chosen = in_range(rows, datetime(2024, 1, first), datetime(2024, 1, last), open_end=True).filter(F.col("event_id") % every == 0)
        changes = chosen.withColumns({"value": F.col("value") + arrival, "arrival": F.lit(arrival), "date": utc_date(F.col("ts"), dict(rows.dtypes)["ts"])})
        up.upsert(changes, path, ["name", "ts", "event_id"], ["arrival"], scratch.new_folder(spark, "staged"))
    return tables.load(spark, path).select("event_id", "ts", "name", "value")


@query("SELECT 'node-' || user_id AS node, max(ts) AS ts, arg_max(event_type, ts) AS status FROM events GROUP BY user_id")
def registry_upsert(spark, folder):
    """The node table after heartbeats came in four deliveries, newest first."""
    path = scratch.new_folder(spark, "nodes")
    beats = fx.heartbeats(spark, folder).withColumn("part", up.bucket(F.col("node"), 8))
    for turn in (3, 1, 0, 2):
        up.upsert(beats.filter(F.col("event_id") % 4 == turn), path, ["node"], ["ts", "event_id"], scratch.new_folder(spark, "staged"), ["part"])
    return spark.read.parquet(path).select("node", "ts", "status")


def _rollups(spark, folder):
    """Samples stored by day, and their rollups, the first half of the days built before the second."""
    raw, path = scratch.new_folder(spark, "raw"), scratch.new_folder(spark, "rollups")
    tables.store(fx.metrics(spark, folder).select("event_id", "ts", "name", "node", "value"), raw)
    samples = tables.load(spark, raw)
    for first, last in ((datetime(2024, 1, 1), datetime(2024, 1, 16)), (datetime(2024, 1, 15), datetime(2024, 2, 2))):
        ru.build(samples, path, fx.KEYS, ["event_id"], first.date(), last.date())
    return samples, path


@query(
    f"""WITH {METRICS} SELECT name, count(*) AS samples, min(ts) AS first, max(ts) AS last, true AS series_close, 'collector,node,user' AS label_names
    FROM m WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00' GROUP BY name"""
)
def summary_stats(spark, folder):
    """Sixteen days out of stored daily summaries; the estimated number of series is held against the exact one."""
    path = scratch.new_folder(spark, "summaries")
    samples = fx.labelled(spark, folder).withColumn("key", lb.series_key(F.col("labels")))
    for first, last in ((datetime(2024, 1, 1), datetime(2024, 1, 12)), (datetime(2024, 1, 10), datetime(2024, 2, 2))):
        sm.build(samples, path, "key", first.date(), last.date(), "labels")
    start, end = datetime(2024, 1, 5), datetime(2024, 1, 21)
    exact = in_range(samples, start, end, open_end=True).groupBy("name").agg(F.count_distinct("key").alias("exact"))
    found = sm.stats(spark, path, start.date(), end.date()).join(exact, "name")
    close = F.abs(F.col("series") - F.col("exact")) <= F.col("exact") * sm.ERROR
    return found.select("name", "samples", "first", "last", close.alias("series_close"), F.array_join("label_names", ",").alias("label_names"))


def rollup_sql(low: str, high: str, step: str) -> str:
    return f"""WITH {METRICS} SELECT name, node, time_bucket(INTERVAL {step}, ts) AS bucket, {q6("avg(value)")} AS mean, min(value) AS low, max(value) AS high,
    {q6("sum(value)")} AS total, count(*) AS points, last(value ORDER BY ts, event_id) AS last FROM m WHERE name IN ('error', 'view') AND ts >= TIMESTAMP '{low}' AND ts <= TIMESTAMP '{high}' GROUP BY 1, 2, 3"""


def _rolled(spark, folder, span):
    samples, path = _rollups(spark, folder)
    rows = ru.range_query(spark, samples, path, ["error", "view"], span, fx.KEYS, ["event_id"])
    return rows.withColumns({c: fx.comparable(F.col(c)) for c in ("mean", "total")})


@query(rollup_sql("2024-01-04 05:00:00", "2024-01-20 20:59:59.999999", "3 HOUR"))
def rollup_range(spark, folder):
    """Three-hour buckets out of stored hours; no sample is read."""
    return _rolled(spark, folder, TimeRange(datetime(2024, 1, 4, 5), datetime(2024, 1, 20, 20, 59, 59, 999_999), timedelta(hours=3)))


@query(rollup_sql("2024-01-04 05:17:23", "2024-01-20 20:41:07", "1 DAY"))
def rollup_edges(spark, folder):
    """Days out of stored quarters of a day, and samples where the range cuts one."""
    return _rolled(spark, folder, TimeRange(datetime(2024, 1, 4, 5, 17, 23), datetime(2024, 1, 20, 20, 41, 7), timedelta(days=1)))


IN_ARCHIVE = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"


@query(f"WITH {METRICS} SELECT event_id, ts, name, node, value FROM m WHERE {IN_ARCHIVE}")
def archive_cold(spark, folder):
    samples = fx.metrics(spark, folder).select("event_id", "ts", "name", "node", "value")
    return ex.archive(samples, START, END, scratch.new_folder(spark, "archive"))


@query(
    f"WITH {METRICS}, f AS (SELECT unnest(['parquet', 'json', 'csv', 'orc']) AS form) SELECT form, event_id, ts, name, node, value, usr || '\"' AS user_label FROM m, f"
)
def export_files(spark, folder):
    """Samples with a label map, of which one value holds a quote."""
    labels = F.create_map(F.lit("node"), "node", F.lit("user"), F.concat("usr", F.lit('"')))
    samples = fx.metrics(spark, folder).select("event_id", "ts", "name", "node", "value", labels.alias("labels"))
    copies = [ex.export(samples, scratch.new_folder(spark, f"export-{f}"), f).withColumn("form", F.lit(f)) for f in ex.FORMATS]
    return ing.union_collectors(copies).withColumn("user_label", F.col("labels")["user"]).drop("labels")


@query(
    f"""WITH {METRICS} SELECT name || '{{node="' || node || '",user="' || replace(replace(usr, 'user-1', 'user\\\\1'), 'user-2', 'user\\"2') || '"}} '
    || CAST(floor(value * 100 + 0.5) AS BIGINT) || ' ' || (epoch_us(ts) // 1000) AS line FROM m"""
)
def export_exposition(spark, folder):
    """Some user labels hold a backslash or a quote, which the text escapes."""
    odd = F.replace(F.replace(F.col("usr"), F.lit("user-1"), F.lit("user\\1")), F.lit("user-2"), F.lit('user"2'))
    samples = fx.metrics(spark, folder).withColumn("user", odd)
    hundredths = F.floor(F.col("value") * 100 + 0.5)
    return ex.exposition(samples, ["user", "node"], hundredths, F.floor(micros(F.col("ts")) / 1000))


TIERS = rt.Tiers(cold=timedelta(hours=480), keep=timedelta(hours=480))
AGE = f"({AS_OF} - ts)"
TIER = f"CASE WHEN {AGE} <= INTERVAL 24 HOUR THEN 'hot' WHEN {AGE} <= INTERVAL 168 HOUR THEN 'warm' WHEN {AGE} <= INTERVAL 480 HOUR THEN 'cold' ELSE 'expired' END"


@query(f"WITH {METRICS} SELECT event_id, ts, name, value FROM m WHERE ts >= {AS_OF} - INTERVAL 480 HOUR")
def retention_delete(spark, folder):
    samples = fx.metrics(spark, folder).select("event_id", "ts", "name", "value")
    return rt.kept(samples, fx.newest(samples), TIERS)


@query(
    f"""WITH {METRICS}, d AS (SELECT event_id, ts >= CAST(CAST({AS_OF} AS DATE) - 20 AS TIMESTAMP) AS stays FROM m)
    SELECT event_id, (SELECT count(*) FROM d WHERE NOT stays) AS removed FROM d WHERE stays"""
)
def retention_purge(spark, folder):
    """What a stored table still holds once the days before the last twenty are removed, and how many samples went."""
    path = scratch.new_folder(spark, "hot")
    samples = fx.metrics(spark, folder).select("event_id", "ts", "name", "value")
    tables.store(samples, path)
    before = fx.newest(samples).date() - timedelta(days=20)
    removed = tables.delete_expired(spark, path, before).first()["removed"]
    return tables.load(spark, path).select("event_id", F.lit(removed).alias("removed"))


@query(f"WITH {METRICS} SELECT event_id, CASE WHEN {IN_ARCHIVE} THEN 'archive' ELSE 'hot' END AS place, (SELECT count(*) FROM m WHERE {IN_ARCHIVE}) AS moved FROM m")
def archive_move(spark, folder):
    """Every sample of a stored table after whole days were moved to an archive, and where it is."""
    hot, cold = scratch.new_folder(spark, "hot"), scratch.new_folder(spark, "archive")
    tables.store(fx.metrics(spark, folder).select("event_id", "ts", "name", "value"), hot)
    moved = ex.move_to_archive(spark, hot, START.date(), END.date(), cold).first()["moved"]
    parts = [tables.load(spark, path).select("event_id", F.lit(place).alias("place")) for path, place in ((hot, "hot"), (cold, "archive"))]
    return parts[0].unionByName(parts[1]).withColumn("moved", F.lit(moved))


@query(
    f"""WITH {METRICS} SELECT event_id, ts FROM m
    WHERE ts >= TIMESTAMP '2024-01-05 22:30:00' AND ts <= TIMESTAMP '2024-01-09 00:30:00'"""
)
def stored_range(spark, folder):
    """A range given in another time zone, read from a stored table with its days pruned."""
    path = scratch.new_folder(spark, "stored")
    tables.store(fx.metrics(spark, folder).select("event_id", "ts", "name", "value"), path)
    zone = timezone(timedelta(hours=2))
    start, end = datetime(2024, 1, 6, 0, 30, tzinfo=zone), datetime(2024, 1, 9, 2, 30, tzinfo=zone)
    return in_range(tables.load(spark, path), start, end).select("event_id", "ts")


@query(f"WITH {METRICS} SELECT event_id, {TIER} AS tier FROM m")
def tier_classify(spark, folder):
    samples = fx.metrics(spark, folder)
    return samples.select("event_id", rt.tier(fx.newest(samples), TIERS).alias("tier"))


@query(
    f"""WITH {METRICS} SELECT name, node, ts, {q6("value")} AS value, CAST(1 AS BIGINT) AS points, 'hot' AS tier FROM m WHERE ts >= {AS_OF} - INTERVAL 24 HOUR
    UNION ALL SELECT name, node, time_bucket(INTERVAL 1 HOUR, ts), {q6("avg(value)")}, count(*), 'warm' FROM m
    WHERE ts < {AS_OF} - INTERVAL 24 HOUR AND ts >= {AS_OF} - INTERVAL 168 HOUR GROUP BY name, node, time_bucket(INTERVAL 1 HOUR, ts)"""
)
def compact_range(spark, folder):
    samples = fx.metrics(spark, folder)
    view = rt.compacted(samples, fx.KEYS, fx.newest(samples), TIERS, timedelta(hours=1))
    return view.withColumn("value", fx.comparable(F.col("value")))


@query(
    f"""WITH {METRICS}, t AS (SELECT {TIER} AS tier FROM m) SELECT count(*) AS total_metrics, count(*) FILTER (tier = 'hot') AS hot_metrics,
    count(*) FILTER (tier = 'warm') AS warm_metrics, count(*) FILTER (tier = 'cold') AS cold_metrics, count(*) FILTER (tier = 'expired') AS expired_metrics,
    480 AS keep_hours, 24 AS hot_hours, 168 AS warm_hours, 480 AS cold_hours FROM t"""
)
def retention_stats(spark, folder):
    samples = fx.metrics(spark, folder)
    return rt.stats(samples, fx.newest(samples), TIERS)

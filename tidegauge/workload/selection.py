"""Selection, predicates and scalar functions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.functions import labels as lb
from tidegauge.functions.labels import Matcher
from tidegauge.functions.timing import instant, time_bucket, time_normalise
from tidegauge.operators import aggregate as ag, fleet, select as sel
from tidegauge.operators.select import TimeRange
from tidegauge.workload.registry import AS_OF, METRICS, NODES, q6, query

START, END = datetime(2024, 1, 5), datetime(2024, 1, 20)
DAY = timedelta(days=1)
IN_RANGE = "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"

# Literal fold of one bucket, kept in the oracle so the closed form is checked against it.
FOLD = "list_reduce(list(value ORDER BY ts, event_id), lambda acc, v: (acc + v) / 2)"


@query(
    f"""WITH {METRICS} SELECT name, series_key, time_bucket(INTERVAL 1 DAY, ts) AS bucket,
    {q6(FOLD)} AS value, count(*) AS points
    FROM m WHERE name = 'error' AND {IN_RANGE} AND node <> 'node-3' AND regexp_full_match(usr, 'user-.*[0-8]')
    GROUP BY 1, 2, 3"""
)
def range_query(spark, folder):
    matchers = [Matcher("node", "!=", "node-3"), Matcher("usr", "=~", "user-.*[0-8]")]
    span = TimeRange(START, END, DAY)
    points = ag.range_query(fx.metrics(spark, folder), ["error"], matchers, span, ["name", "series_key"], fx.TIE)
    return points.withColumn("value", fx.comparable(F.col("value")))


@query(f"WITH {METRICS} SELECT event_id, ts, name, node, value FROM m WHERE name = 'error'")
def sel_name(spark, folder):
    return sel.by_name(fx.metrics(spark, folder), "error").select("event_id", "ts", "name", "node", "value")


@query(f"WITH {METRICS} SELECT event_id, ts, name, value FROM m WHERE {IN_RANGE}")
def sel_time_range(spark, folder):
    return sel.in_range(fx.metrics(spark, folder), START, END).select("event_id", "ts", "name", "value")


@query(f"WITH {METRICS} SELECT event_id, ts, value FROM m WHERE node = 'node-8' AND usr = 'user-8'")
def sel_label_eq(spark, folder):
    # The label "zone" exists nowhere, and a missing label equals ''.
    matchers = [Matcher("node", "=", "node-8"), Matcher("user", "=", "user-8"), Matcher("zone", "=", "")]
    return lb.matching(fx.labelled(spark, folder), matchers).select("event_id", "ts", "value")


@query(f"WITH {METRICS} SELECT event_id, ts, node, value FROM m WHERE node <> 'node-8'")
def sel_label_neq(spark, folder):
    chosen = lb.matching(fx.metrics(spark, folder), [Matcher("node", "!=", "node-8"), Matcher("usr", "!=", "")])
    return chosen.select("event_id", "ts", "node", "value")


@query(
    f"""WITH {METRICS} SELECT event_id, node, usr, value FROM m
    WHERE regexp_full_match(node, 'node-[1-4]|node-7') AND NOT regexp_full_match(usr, 'user-1.*')"""
)
def sel_label_regex(spark, folder):
    matchers = [Matcher("node", "=~", "node-[1-4]|node-7"), Matcher("usr", "!~", "user-1.*")]
    return lb.matching(fx.metrics(spark, folder), matchers).select("event_id", "node", "usr", "value")


@query(
    f"""WITH {METRICS} SELECT name, node, time_bucket(INTERVAL 15 SECOND, ts) AS bucket, {q6(FOLD)} AS value,
    count(*) AS points FROM m WHERE ts BETWEEN {AS_OF} - INTERVAL 1 HOUR AND {AS_OF} GROUP BY 1, 2, 3"""
)
def default_range(spark, folder):
    samples = fx.metrics(spark, folder)
    span = TimeRange.ending(fx.newest(samples))
    points = ag.range_query(samples, [], [], span, fx.KEYS, fx.TIE)
    return points.withColumn("value", fx.comparable(F.col("value")))


@query(
    """SELECT event_id, CASE event_id % 5
      WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
      WHEN 2 THEN TIMESTAMP '2024-02-01 00:00:00' - (event_id % 50) * INTERVAL 1 MINUTE - INTERVAL 30 SECOND
      WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
      ELSE TIMESTAMP '2024-02-01 00:00:00' END AS at FROM events""",
    key="time_normalise",
)
def time_normalise_rows(spark, folder):
    """Raw rows carry their time as RFC 3339 (with or without offset), unix seconds, a length of time ago, or junk."""
    second = F.date_trunc("second", F.col("ts"))
    form = F.col("event_id") % 5
    text = (
        F.when(form == 0, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, F.unix_timestamp(second.cast("timestamp")).cast("string"))
        .when(form == 2, F.concat((F.col("event_id") % 50).cast("string"), F.lit("m30s")))
        .when(form == 3, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise("yesterday")
    )
    as_of = instant(datetime(2024, 2, 1))
    raw = fx.table(spark, folder, "events").select("event_id", text.alias("raw"))
    return raw.select("event_id", time_normalise(F.col("raw"), as_of, as_of).cast("timestamp_ntz").alias("at"))


@query(
    f"""WITH {METRICS} SELECT name, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, {q6("avg(value)")} AS value
    FROM m WHERE node = 'node-1' AND {IN_RANGE} GROUP BY 1, 2"""
)
def node_metrics(spark, folder):
    span = TimeRange(START, END, timedelta(hours=1))
    matchers = [Matcher("node", "=", "node-1")]
    points = ag.range_query(fx.metrics(spark, folder), [], matchers, span, ["name"], fx.TIE, how="mean")
    return points.select("name", "bucket", fx.comparable(F.col("mean")).alias("value"))


@query(
    f"""WITH {METRICS} SELECT event_id, ts, value FROM m WHERE node = 'node-1' AND name = 'error' AND {IN_RANGE}
    ORDER BY ts, event_id LIMIT 1000"""
)
def metrics_limit(spark, folder):
    span = TimeRange(START, END)
    chosen = sel.selection(fx.metrics(spark, folder), ["error"], [Matcher("node", "=", "node-1")], span)
    return sel.first_points(chosen.select("event_id", "ts", "value"), order=("ts", "event_id"))


@query(
    f"""WITH {NODES} SELECT id, os, created_at, last_seen, heartbeats FROM nd
    WHERE contains(lower(id), 'node-1') AND {AS_OF} - last_seen <= INTERVAL 18 HOUR"""
)
def node_search(spark, folder):
    nodes = fx.nodes(spark, folder)
    as_of = fx.newest(fx.table(spark, folder, "events"))
    known = nodes.withColumn("online", instant(as_of) - F.col("last_seen") <= F.lit(timedelta(hours=18)))
    return sel.search_nodes(known, "NODE-1", "online").drop("online")


@query(
    """WITH latest AS (SELECT 'node-' || user_id AS id, arg_max(event_type, ts) AS status, max(ts) AS last_seen
    FROM events GROUP BY user_id) SELECT * FROM latest WHERE id = 'node-42'"""
)
def node_lookup(spark, folder):
    beats = fx.heartbeats(spark, folder).withColumnRenamed("node", "id")
    latest = fleet.latest_rows(beats, ["id"], ["ts", "event_id"], ["status", F.col("ts").alias("last_seen")])
    return latest.filter(F.col("id") == "node-42")


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'tmpfs' WHEN 1 THEN 'ext4' WHEN 2 THEN 'overlay' ELSE 'xfs' END AS fstype,
    '/' || lower(p_brand) AS mount FROM part
    WHERE p_size % 4 NOT IN (0, 2) AND NOT starts_with('/' || lower(p_brand), '/brand#1')
    AND NOT starts_with('/' || lower(p_brand), '/brand#5')"""
)
def disk_filter(spark, folder):
    kind = F.element_at(F.array(*[F.lit(t) for t in ("tmpfs", "ext4", "overlay", "xfs")]), F.col("p_size") % 4 + 1)
    disks = fx.table(spark, folder, "part").select(
        "p_partkey", kind.alias("fstype"), F.concat(F.lit("/"), F.lower("p_brand")).alias("mount")
    )
    return sel.keep_disks(disks, ["tmpfs", "overlay"], ["/brand#1", "/brand#5"])


@query(
    """SELECT c_custkey, interface FROM (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'lo' WHEN 1 THEN 'eth'
    WHEN 2 THEN 'veth' ELSE 'wlan' END || (c_custkey % 3) AS interface FROM customer)
    WHERE NOT starts_with(interface, 'lo') AND (starts_with(interface, 'eth') OR starts_with(interface, 'wl'))"""
)
def iface_filter(spark, folder):
    kind = F.element_at(F.array(*[F.lit(t) for t in ("lo", "eth", "veth", "wlan")]), F.col("c_nationkey") % 4 + 1)
    interfaces = fx.table(spark, folder, "customer").select(
        "c_custkey", F.concat(kind, F.col("c_custkey") % 3).alias("interface")
    )
    return sel.keep_interfaces(interfaces, ["lo", "eth", "wl"])


@query(
    """SELECT s_suppkey, r_name AS namespace, n_name AS app, s_acctbal AS value FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA') AND r_name NOT IN ('AFRICA') AND n_name <> ''
    AND s_nationkey % 2 = 0"""
)
def namespace_filter(spark, folder):
    nations = fx.table(spark, folder, "nation").join(
        fx.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    samples = (
        fx.table(spark, folder, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "s_suppkey",
            F.col("r_name").alias("namespace"),
            F.col("n_name").alias("app"),
            F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("shard"),
            F.col("s_acctbal").alias("value"),
        )
    )
    kept = sel.keep_namespaces(samples, ["ASIA", "EUROPE", "AFRICA"], ["AFRICA"], {"shard": "even"})
    return kept.drop("shard")


@query(
    """SELECT event_id, substr(sha256('collector=events,node=node-' || (user_id % 10) || ',user=user-' || user_id), 1, 16)
    AS labels_hash FROM events"""
)
def labels_hash(spark, folder):
    return fx.labelled(spark, folder).select("event_id", lb.labels_hash(F.col("labels")).alias("labels_hash"))


@query(f"WITH {METRICS} SELECT event_id, series_key FROM m")
def series_key(spark, folder):
    return fx.labelled(spark, folder).select("event_id", lb.series_key(F.col("labels")).alias("series_key"))


@query(
    """SELECT event_id,
    CASE event_id % 6 WHEN 0 THEN 'gauge' WHEN 1 THEN 'counter' WHEN 2 THEN 'histogram' WHEN 3 THEN 'summary' ELSE 'unknown' END AS metric_type,
    CASE event_id % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'healthy' WHEN 2 THEN 'degraded' WHEN 3 THEN 'unhealthy' WHEN 4 THEN 'offline' ELSE 'unknown' END AS node_status,
    CASE event_id % 6 WHEN 0 THEN 'inactive' WHEN 1 THEN 'pending' WHEN 2 THEN 'firing' WHEN 3 THEN 'resolved' ELSE 'unknown' END AS alert_state,
    'gauge' AS stored_type FROM events"""
)
def decode_enums(spark, folder):
    code = F.col("event_id") % 6
    return fx.table(spark, folder, "events").select(
        "event_id",
        lb.decode(code, lb.METRIC_TYPES).alias("metric_type"),
        lb.decode(code, lb.NODE_STATUSES).alias("node_status"),
        lb.decode(code, lb.ALERT_STATES).alias("alert_state"),
        lb.metric_type(F.col("event_type")).alias("stored_type"),
    )


@query(f"WITH {METRICS} SELECT DISTINCT name, series_key, node || ' - CPU ' || usr || ' ' AS legend FROM m")
def series_legend(spark, folder):
    samples = fx.labelled(spark, folder)
    series = samples.select(
        "name", lb.series_key(F.col("labels")).alias("series_key"), F.map_entries("labels").alias("entries")
    ).dropDuplicates(["name", "series_key"])
    legend = lb.render(F.lit("{{node}} - CPU {{user}} {{missing}}"), F.map_from_entries("entries"))
    return series.select("name", "series_key", legend.alias("legend"))


@query(
    f"""WITH {METRICS}, x AS (SELECT name, node, least(min(value), 0) AS low, greatest(max(value), 0) AS high
    FROM m GROUP BY 1, 2)
    SELECT event_id, {q6("(value - low) / coalesce(nullif(high - low, 0), 1)")} AS scaled FROM m JOIN x USING (name, node)"""
)
def minmax_scale(spark, folder):
    scaled = ag.minmax_scale(fx.metrics(spark, folder), fx.KEYS)
    return scaled.select("event_id", fx.comparable(F.col("scaled")).alias("scaled"))


@query(
    f"""WITH {METRICS} SELECT event_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '0001-01-01 00:00:00') AS week,
    time_bucket(INTERVAL 1 DAY, ts) AS day, time_bucket(INTERVAL 1 HOUR, ts) AS hour,
    time_bucket(INTERVAL 15 SECOND, ts) AS quarter_minute, ts AS raw FROM m""",
    key="time_bucket",
)
def time_buckets(spark, folder):
    ts = F.col("ts")
    return fx.metrics(spark, folder).select(
        "event_id",
        time_bucket(ts, timedelta(days=7)).alias("week"),
        time_bucket(ts, DAY).alias("day"),
        time_bucket(ts, timedelta(hours=1)).alias("hour"),
        time_bucket(ts, timedelta(seconds=15)).alias("quarter_minute"),
        time_bucket(ts, timedelta(0)).alias("raw"),
    )

"""Rules, alert states, notifications, rule sets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.functions import labels as lb
from tidegauge.functions.timing import instant, micros
from tidegauge.operators import alerting as al, cooldown, rulesets as rs, select as sel, vectors
from tidegauge.operators.aggregate import downsample_mean
from tidegauge.operators.select import by_name
from tidegauge.plans.ordered import Ordered, RunningSum
from tidegauge.plans.small import spec_table
from tidegauge.workload.buckets import ALERTS, error_alerts
from tidegauge.workload.registry import COUNTERS, METRICS, alerts_sql, q6, query

HOLD = timedelta(hours=6)
NOON = datetime(2024, 1, 15, 12)

# Two rules per metric, one of them off; thresholds exercise every operator.
RULES = [
    al.Rule("HighErrors", "error", ">", 80, HOLD, "critical"),
    al.Rule("LowViews", "view", "<", 5, timedelta(hours=2), "warning"),
    al.Rule("ManyClicks", "click", ">=", 100, timedelta(0), "info"),
    al.Rule("FewPurchases", "purchase", "<=", 2.5, timedelta(hours=1), "warning"),
    al.Rule("ExactSignup", "signup", "==", 6.55, timedelta(0), "info"),
    al.Rule("OtherSignup", "signup", "!=", 6.55, timedelta(hours=12), "other"),
    al.Rule("Broken", "signup", "~", 1, timedelta(0), "info"),
    al.Rule("Off", "view", ">", 0, timedelta(0), "critical", enabled=False),
]
_RULES = """rules AS (SELECT * FROM (VALUES
  ('HighErrors', 'error', '>', 80.0, 21600, 'critical'), ('LowViews', 'view', '<', 5.0, 7200, 'warning'),
  ('ManyClicks', 'click', '>=', 100.0, 0, 'info'), ('FewPurchases', 'purchase', '<=', 2.5, 3600, 'warning'),
  ('ExactSignup', 'signup', '==', 6.55, 0, 'info'), ('OtherSignup', 'signup', '!=', 6.55, 43200, 'other'),
  ('Broken', 'signup', '~', 1.0, 0, 'info')) t(rule, metric, op, threshold, hold_s, severity))"""
MATCHED = f"""{METRICS}, {_RULES}, hit AS (
  SELECT rule, severity, hold_s, node, usr, ts, event_id, event_id AS tie, value, CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
    WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold
    WHEN '!=' THEN value <> threshold ELSE false END AS breach
  FROM m JOIN rules ON m.name = rules.metric)"""
FOUND = f"{MATCHED}, {alerts_sql('hit', 'rule, node, severity, hold_s', 'hold_s * INTERVAL 1 SECOND')}"


def matched(spark, folder):
    return al.match_rules(fx.metrics(spark, folder), al.rules_table(spark, RULES))


def found(spark, folder):
    hold = F.lit(timedelta(microseconds=1)) * F.col("hold_us")
    return al.alerts(matched(spark, folder), ["rule", "node"], fx.TIE, F.col("breach"), hold, carry=["severity"])


@query(f"WITH {MATCHED} SELECT rule, event_id, value, breach FROM hit")
def rule_match_join(spark, folder):
    return matched(spark, folder).select("rule", "event_id", "value", "breach")


@query(
    """SELECT event_id, value > 80 AS gt, value < 80 AS lt, value >= 6.55 AS ge, value <= 6.55 AS le, value = 6.55 AS eq, value <> 6.55 AS ne,
    false AS unknown FROM events"""
)
def rule_eval(spark, folder):
    value = F.col("value")
    tests = {"gt": (">", 80.0), "lt": ("<", 80.0), "ge": (">=", 6.55), "le": ("<=", 6.55), "eq": ("==", 6.55), "ne": ("!=", 6.55), "unknown": ("=~", 1.0)}
    return fx.table(spark, folder, "events").select(
        "event_id", *[al.compare(value, F.lit(op), F.lit(limit)).alias(n) for n, (op, limit) in tests.items()]
    )


# The default rules on events renamed to host metrics.
HOST_NAMES = {
    "error": "system_cpu_usage",
    "view": "system_memory_usage_percent",
    "click": "system_disk_usage_percent",
    "purchase": "system_load1",
    "signup": "system_cpu_cores",
}


@query(
    f"""WITH {METRICS}, hit AS (SELECT CASE name WHEN 'error' THEN 'HighCPUUsage' WHEN 'view' THEN 'HighMemoryUsage' ELSE 'LowDiskSpace' END AS rule,
      node, ts, event_id AS tie, value, value > CASE name WHEN 'error' THEN 80 WHEN 'view' THEN 90 ELSE 85 END AS breach,
      CASE name WHEN 'click' THEN 300 ELSE 120 END AS hold_s FROM m WHERE name IN ('error', 'view', 'click')),
    {alerts_sql("hit", "rule, node, hold_s", "hold_s * INTERVAL 1 SECOND")}
    SELECT rule, node, active_at, fired_at, resolved_at, samples, state, value FROM alerts"""
)
def default_rules(spark, folder):
    renamed = F.coalesce(*[F.when(F.col("name") == a, b) for a, b in HOST_NAMES.items()])
    samples = fx.metrics(spark, folder).withColumn("name", renamed)
    hits = al.match_rules(samples, al.rules_table(spark, al.DEFAULT_RULES))
    hold = F.lit(timedelta(microseconds=1)) * F.col("hold_us")
    return al.alerts(hits, ["rule", "node"], fx.TIE, F.col("breach"), hold)


def _timeline(spark, folder):
    errors = by_name(fx.metrics(spark, folder), "error")
    return al.timeline(errors, ["node"], fx.TIE, F.col("value") > 80, F.lit(HOLD))


STATES = f"""{ALERTS}, st AS (SELECT r.event_id, r.node, r.ts, r.value, CASE WHEN r.breach AND r.ts - r.run_start >= INTERVAL 6 HOUR THEN 'firing'
    WHEN r.breach THEN 'pending' WHEN r.was THEN 'resolved' ELSE 'inactive' END AS state,
    CASE WHEN r.breach OR r.was THEN r.run_start END AS active_at FROM run r)"""


@query(f"WITH {STATES} SELECT event_id, node, ts, value, active_at FROM st WHERE state = 'pending'")
def alert_pending(spark, folder):
    rows = _timeline(spark, folder).filter(F.col("state") == "pending")
    return rows.select("event_id", "node", "ts", "value", "active_at")


@query(f"WITH {STATES} SELECT event_id, node, ts, value, active_at FROM st WHERE state = 'firing'")
def alert_firing(spark, folder):
    rows = _timeline(spark, folder).filter(F.col("state") == "firing")
    return rows.select("event_id", "node", "ts", "value", "active_at")


@query(f"WITH {ALERTS} SELECT node, active_at, resolved_at, fired_at, samples, value FROM alerts WHERE resolved_at IS NOT NULL")
def alert_resolve(spark, folder):
    closed = error_alerts(spark, folder).filter(F.col("state") == "resolved")
    return closed.select("node", "active_at", "resolved_at", "fired_at", "samples", "value")


@query(f"WITH {FOUND} SELECT rule, node, severity, active_at, fired_at, samples, state, value FROM alerts WHERE resolved_at IS NULL")
def alert_active(spark, folder):
    return al.active(found(spark, folder)).drop("resolved_at")


RANKED = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"


@query(f"WITH {FOUND} SELECT rule, node, severity, active_at, value, {RANKED} AS rank FROM alerts WHERE state = 'firing'")
def alert_sort(spark, folder):
    rows = al.listed(found(spark, folder), ["rule", "node"])
    return rows.select("rule", "node", "severity", "active_at", "value", al.severity_rank(F.col("severity")).alias("rank"))


@query(
    f"""WITH {FOUND} SELECT rule, node, severity, active_at, fired_at, resolved_at, samples, state, value FROM alerts
    WHERE state IN ('resolved', 'firing') ORDER BY active_at DESC, rule, node LIMIT 50"""
)
def alert_history(spark, folder):
    return al.history(found(spark, folder), ["rule", "node"])


@query(
    f"""WITH {FOUND} SELECT rule, node, severity, active_at, samples, state FROM alerts
    WHERE state = 'resolved' AND severity = 'critical' AND node = 'node-1' AND active_at >= TIMESTAMP '2024-01-15 12:00:00'"""
)
def alert_filter(spark, folder):
    rows = sel.filter_alerts(found(spark, folder), "resolved", "critical", "node-1", NOON)
    return rows.select("rule", "node", "severity", "active_at", "samples", "state")


@query(f"WITH {FOUND} SELECT rule, node, active_at, state FROM alerts WHERE node = 'node-7'")
def node_alerts(spark, folder):
    return sel.filter_alerts(found(spark, folder), node="node-7").select("rule", "node", "active_at", "state")


@query(f"WITH {ALERTS} SELECT node, active_at, samples FROM alerts")
def alert_dedup(spark, folder):
    return error_alerts(spark, folder).select("node", "active_at", "samples")


@query(
    f"""WITH RECURSIVE {FOUND}, f AS (SELECT DISTINCT rule, node, epoch_us(fired_at) AS t FROM alerts WHERE fired_at IS NOT NULL),
    sent AS (SELECT rule, node, min(t) AS t FROM f GROUP BY 1, 2
      UNION ALL
      SELECT * FROM (SELECT s.rule, s.node, (SELECT min(f.t) FROM f WHERE f.rule = s.rule AND f.node = s.node AND f.t >= s.t + 86400000000) AS t FROM sent s)
      WHERE t IS NOT NULL)
    SELECT rule, node, make_timestamp(t) AS fired_at FROM sent"""
)
def alert_cooldown(spark, folder):
    fired = found(spark, folder).filter(F.col("fired_at").isNotNull())
    candidates = fired.withColumn("id", F.concat_ws("|", "rule", "node", micros(F.col("active_at")).cast("string")))
    sent = cooldown.cooled_down(candidates, ["rule", "node"], "fired_at", "id", timedelta(days=1))
    return sent.select("rule", "node", "fired_at")


# Every error of the first user of each node silences HighErrors there for a day.
SILENCES = f"""sil AS (SELECT 'HighErrors' AS rule, node, ts AS starts_at, ts + INTERVAL 1 DAY AS ends_at
    FROM m WHERE name = 'error' AND regexp_full_match(usr, 'user-[0-9]'))"""


@query(
    f"""WITH {FOUND}, {SILENCES} SELECT rule, node, active_at, state FROM alerts a WHERE NOT EXISTS (
    SELECT 1 FROM sil s WHERE s.rule = a.rule AND s.node = a.node AND a.active_at BETWEEN s.starts_at AND s.ends_at)"""
)
def silence_filter(spark, folder):
    errors = by_name(fx.metrics(spark, folder), "error").filter(F.col("usr").rlike("^user-[0-9]$"))
    silences = errors.select(
        F.lit("HighErrors").alias("rule"), "node", F.col("ts").alias("starts_at"), (F.col("ts") + F.lit(timedelta(days=1))).alias("ends_at")
    )
    return al.silenced_out(found(spark, folder), silences).select("rule", "node", "active_at", "state")


@query(
    f"""WITH {FOUND}, dep AS (SELECT * FROM (VALUES ('HighErrors', 'OtherSignup'), ('HighErrors', 'LowViews'), ('LowViews', 'FewPurchases')) t(child, parent))
    SELECT rule, node, active_at, state FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM dep JOIN alerts p ON p.rule = dep.parent
      WHERE dep.child = a.rule AND p.node = a.node AND p.active_at <= a.active_at AND (p.resolved_at IS NULL OR p.resolved_at > a.active_at))"""
)
def alert_dependency(spark, folder):
    pairs = [("HighErrors", "OtherSignup"), ("HighErrors", "LowViews"), ("LowViews", "FewPurchases")]
    dependencies = spec_table(spark, pairs, "child string, parent string")
    return al.without_children(found(spark, folder), dependencies).select("rule", "node", "active_at", "state")


# A chain of four, a diamond (ManyClicks - LowViews, ExactSignup - OtherSignup) and a cycle (Broken - Off - Broken) below HighErrors.
_LEVELS = [
    ("HighErrors", "LowViews"), ("LowViews", "FewPurchases"), ("FewPurchases", "OtherSignup"), ("ManyClicks", "LowViews"), ("ManyClicks", "ExactSignup"),
    ("ExactSignup", "OtherSignup"), ("LowViews", "OtherSignup"), ("Broken", "Off"), ("Off", "Broken"), ("Off", "HighErrors"), ("HighErrors", "HighErrors"),
]
ABOVE = f"""dep(child, parent) AS (VALUES {", ".join(map(str, _LEVELS))}),
    up(child, parent) AS (SELECT child, parent FROM dep UNION SELECT up.child, dep.parent FROM up JOIN dep ON up.parent = dep.child),
    above AS (SELECT child, parent FROM up a WHERE child <> parent AND NOT EXISTS (SELECT 1 FROM up b WHERE b.child = a.parent AND b.parent = a.child))"""


@query(
    f"""WITH RECURSIVE {ABOVE}, {FOUND}
    SELECT rule, node, active_at, state FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM above JOIN alerts p ON p.rule = above.parent
      WHERE above.child = a.rule AND p.node = a.node AND p.active_at <= a.active_at AND (p.resolved_at IS NULL OR p.resolved_at > a.active_at))"""
)
def alert_ancestry(spark, folder):
    """Alerts that no rule above theirs explains, however many levels up."""
    dependencies = spec_table(spark, _LEVELS, "child string, parent string")
    return al.without_descendants(found(spark, folder), dependencies).select("rule", "node", "active_at", "state")


@query(
    f"""WITH {FOUND}, t AS (SELECT rule, node, active_at, 'firing' AS transition, fired_at AS sent_at FROM alerts WHERE fired_at IS NOT NULL
      UNION ALL SELECT rule, node, active_at, 'resolved', resolved_at FROM alerts WHERE fired_at IS NOT NULL AND resolved_at IS NOT NULL)
    SELECT t.*, channel FROM t, (SELECT unnest(['slack', 'email']) AS channel)"""
)
def notify_outbox(spark, folder):
    rows = al.outbox(found(spark, folder), ["slack", "email"])
    return rows.select("rule", "node", "active_at", "transition", "sent_at", "channel")


@query(
    f"""WITH {FOUND} SELECT rule, node, active_at, replace(replace('Errors on NODE: VALUE%', 'NODE', node), 'VALUE', CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR)) AS description
    FROM alerts WHERE rule = 'HighErrors' AND fired_at IS NOT NULL"""
)
def annotation_render(spark, folder):
    rows = found(spark, folder).filter((F.col("rule") == "HighErrors") & F.col("fired_at").isNotNull())
    texts = spec_table(spark, [("HighErrors", "Errors on {{ $labels.node }}: {{ $value }}%{{ $labels.zone }}")], "rule string, description string")
    value = F.floor(F.col("value") + 0.5).cast("string")
    text = lb.render(F.col("description"), F.create_map(F.lit("node"), F.col("node")), value)
    return rows.join(texts, "rule").select("rule", "node", "active_at", text.alias("description"))


# Every event changes a rule named after its user: type decides the operation.
CHANGES = """ch AS (SELECT 'rule-' || (user_id % 50) AS rule, CASE event_type WHEN 'view' THEN 'put' WHEN 'click' THEN 'put' WHEN 'error' THEN 'delete'
    WHEN 'signup' THEN 'enable' ELSE 'disable' END AS op, value AS threshold, ts, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')"""


@query(
    f"""WITH {CHANGES}, p AS (SELECT rule, max(ts) AS put_at, arg_max(threshold, ts) AS threshold FROM ch WHERE op = 'put' GROUP BY 1),
    d AS (SELECT rule, max(ts) AS deleted_at FROM ch WHERE op = 'delete' GROUP BY 1),
    s AS (SELECT rule, arg_max(op, ts) AS switch FROM ch WHERE op IN ('put', 'enable', 'disable') GROUP BY 1)
    SELECT p.rule, threshold, switch <> 'disable' AS enabled FROM p LEFT JOIN d USING (rule) JOIN s USING (rule)
    WHERE deleted_at IS NULL OR put_at > deleted_at"""
)
def rule_admin(spark, folder):
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "put").when(kind == "error", "delete").when(kind == "signup", "enable").otherwise("disable")
    changes = fx.table(spark, folder, "events").select(
        F.concat(F.lit("rule-"), F.col("user_id") % 50).alias("rule"), op.alias("op"), F.col("value").alias("threshold"), "ts", "event_id"
    )
    return al.current_rules(changes, NOON, ["ts", "event_id"])


# Every 23rd event changes one of three rules on the metric of its type; the others are samples.
VERSIONED = f"""{METRICS}, rc AS (SELECT name, 'rule-' || (event_id // 23 % 3) AS rule, ts, event_id AS tie,
    CASE event_id // 23 // 3 % 7 WHEN 3 THEN 'disable' WHEN 4 THEN 'enable' WHEN 5 THEN 'delete' ELSE 'put' END AS op,
    list_extract(['>', '<', '>=', '<=', '==', '!='], CAST(event_id // 23 % 6 + 1 AS BIGINT)) AS operator, value AS threshold, (event_id // 23 % 4) * 7200000000 AS hold_us
    FROM m WHERE event_id % 23 = 0),
  rk AS (SELECT *, last_value(CASE op WHEN 'put' THEN {{'o': operator, 't': threshold, 'h': hold_us, 'ok': true}} WHEN 'delete' THEN {{'o': NULL, 't': NULL, 'h': NULL, 'ok': false}} END IGNORE NULLS) OVER w AS known,
    last_value(CASE op WHEN 'put' THEN true WHEN 'enable' THEN true WHEN 'disable' THEN false END IGNORE NULLS) OVER w AS switch, lead(ts) OVER (PARTITION BY name, rule ORDER BY ts, tie) AS until
    FROM rc WINDOW w AS (PARTITION BY name, rule ORDER BY ts, tie ROWS UNBOUNDED PRECEDING)),
  rv AS (SELECT name, rule, ts AS since, until, known.o AS operator, known.t AS threshold, known.h AS hold_us, coalesce(known.ok AND switch, false) AS alive FROM rk),
  vj AS (SELECT m.name, rv.rule, m.node, m.ts, 1 AS kind, m.event_id, m.value, rv.hold_us, CASE rv.operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
    WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold WHEN '!=' THEN value <> threshold ELSE false END AS breach
    FROM m JOIN rv ON m.name = rv.name AND rv.alive AND m.ts >= rv.since AND (rv.until IS NULL OR m.ts < rv.until) WHERE event_id % 23 <> 0),
  vall AS (SELECT *, CAST(0 AS BIGINT) AS dummy FROM vj UNION ALL
    SELECT s.name, s.rule, s.node, e.since, 0, 0, NULL, 0, false, 0 FROM (SELECT DISTINCT name, rule, node FROM vj WHERE breach) s JOIN rv e ON e.name = s.name AND e.rule = s.rule AND NOT e.alive),
  vsrc AS (SELECT name, rule, node, ts, kind * 1000000000 + event_id AS tie, value, breach, hold_us FROM vall)"""
_VERSIONED_ALERTS = alerts_sql("vsrc", "name, rule, node", "to_microseconds(hold_us)")
RULE_LOG = f"""{VERSIONED}, {_VERSIONED_ALERTS}, rule_log AS (
    SELECT name, rule, node, 'pending' AS transition, active_at AS "at", active_at FROM alerts WHERE fired_at IS NULL OR fired_at > active_at
    UNION ALL SELECT name, rule, node, 'firing', fired_at, active_at FROM alerts WHERE fired_at IS NOT NULL
    UNION ALL SELECT name, rule, node, 'resolved', resolved_at, active_at FROM alerts WHERE resolved_at IS NOT NULL)"""


def rule_feed(samples):
    """Samples and rule changes out of rows with name, ts, event_id and value (batch or stream)."""
    number = F.floor(F.col("event_id") / 23)
    turn = F.floor(number / 3) % 7
    op = F.when(turn == 3, "disable").when(turn == 4, "enable").when(turn == 5, "delete").otherwise("put")
    operators = F.array(*[F.lit(o) for o in (">", "<", ">=", "<=", "==", "!=")])
    changes = samples.filter(F.col("event_id") % 23 == 0).select(
        "name", F.concat(F.lit("rule-"), number % 3).alias("rule"), "ts", "event_id", op.alias("op"), F.get(operators, (number % 6).cast("int")).alias("operator"),
        F.col("value").alias("threshold"), ((number % 4) * 7_200_000_000).cast("bigint").alias("hold_us"),
    )
    return samples.filter(F.col("event_id") % 23 != 0), changes


@query(f"WITH {RULE_LOG} SELECT * FROM rule_log")
def alert_log(spark, folder):
    """Alert transitions under rules that are put, switched off and on, and deleted while samples arrive."""
    samples, changes = rule_feed(fx.metrics(spark, folder))
    return al.alert_log(samples, changes, ["node"], "event_id")


@query(
    f"""WITH {METRICS}, c AS (SELECT node, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, max(value) FILTER (name = 'error') > 80 AS hot,
      min(value) FILTER (name = 'view') < 5 AS idle, max(value) FILTER (name = 'purchase') > 100 AS paid FROM m
      WHERE name IN ('error', 'view', 'purchase') GROUP BY 1, 2)
    SELECT node, bucket, coalesce(hot, false) AS hot, coalesce(idle, false) AS idle, coalesce(paid, false) AS paid,
    coalesce(hot, false) AND (coalesce(idle, false) OR NOT coalesce(paid, false)) AS breach FROM c"""
)
def rule_boolean(spark, folder):
    samples, step = fx.metrics(spark, folder), timedelta(hours=6)
    specs = {"hot": ("error", "high", ">", 80.0), "idle": ("view", "low", "<", 5.0), "paid": ("purchase", "high", ">", 100.0)}
    conditions = {}
    for key, (name, take, op, limit) in specs.items():
        values = vectors.vector(samples, name, ["node"], step, fx.TIE, take=take)
        conditions[key] = values.withColumn("breach", al.compare(F.col("value"), F.lit(op), F.lit(limit)))
    flags = al.combine_conditions(conditions, ["node", "bucket"])
    return flags.withColumn("breach", F.col("hot") & (F.col("idle") | ~F.col("paid")))


@query(
    f"""WITH {METRICS}, w AS (SELECT name, node, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, avg(value) AS mean, min(value) AS low, max(value) AS high
      FROM m GROUP BY 1, 2, 3)
    SELECT name, node, bucket, mean > 60 AS mean_breach, low < 1 AS low_breach, high >= 200 AS high_breach FROM w"""
)
def rule_window_agg(spark, folder):
    windows = downsample_mean(fx.metrics(spark, folder), fx.KEYS, timedelta(hours=6))
    tests = {"mean_breach": ("mean", ">", 60.0), "low_breach": ("low", "<", 1.0), "high_breach": ("high", ">=", 200.0)}
    return windows.select(
        "name", "node", "bucket", *[al.compare(F.col(c), F.lit(op), F.lit(x)).alias(n) for n, (c, op, x) in tests.items()]
    )


# ---- shipped rule sets: a month of events played as one hour --------------------------------------------------------

EPOCH = datetime(2024, 1, 1)
SPEED = 720
FAST_SQL = f"""{COUNTERS}, fast AS (
  SELECT e.event_id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds((epoch_us(e.ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // {SPEED}) AS ts,
         event_type AS kind, 'node-' || (user_id % 10) AS node, e.value, ct.value AS counter, k,
         CASE user_id % 4 WHEN 0 THEN '/tmp' ELSE '/data' END AS mount, CASE user_id % 3 WHEN 0 THEN 'a' ELSE 'b' END AS container
  FROM events e JOIN ct USING (event_id) JOIN mk USING (event_id))"""


def _fast(spark, folder):
    offset = F.floor((micros(F.col("ts")) - micros(instant(EPOCH))) / SPEED)
    ts = instant(EPOCH) + F.lit(timedelta(microseconds=1)) * offset
    events = fx.table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("kind"),
        F.concat(F.lit("node-"), F.col("user_id") % 10).alias("node"),
        F.when(F.col("user_id") % 4 == 0, "/tmp").otherwise("/data").alias("mount"),
        F.when(F.col("user_id") % 3 == 0, "a").otherwise("b").alias("container"),
        "value",
        fx.k_of(F.col("props")).alias("k"),
    )
    counted = Ordered(events, ["node", "kind"], ["ts", "event_id"]).scan(total=RunningSum(F.col("k"))).frame()
    return counted.withColumns({"counter": (F.col("total") % 1000).cast("double"), "ts": ts}).drop("total")


def _played(spark, folder, plan):
    """Each event becomes the samples that ``plan`` lists for its kind."""
    choices = [
        F.when(F.col("kind") == kind, F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), *extra) for n, v, *extra in rows]))
        for kind, rows in plan.items()
    ]
    rows = _fast(spark, folder).withColumn("_s", F.explode(F.coalesce(*choices)))
    return rows.select("event_id", "ts", "node", "mount", "container", "_s.*")


def growth_sql(name: str, kind: str, every: int, series: str = "node, mount") -> str:
    """Windowed growth of the counter behind ``kind``: (node, mount, ts, increase)."""
    copies = 300 // every
    return f"""{name}_d AS (SELECT node, mount, ts, counter, counter - lag(counter) OVER w AS dv, lag(ts) OVER w AS before FROM fast WHERE kind = '{kind}'
    WINDOW w AS (PARTITION BY {series} ORDER BY ts, event_id)),
  {name} AS (SELECT node, mount, time_bucket(INTERVAL {every} SECOND, ts) + i * INTERVAL {every} SECOND AS ts,
    sum(CASE WHEN dv < 0 THEN counter ELSE dv END) AS increase
    FROM {name}_d, (SELECT unnest(range(1, {copies + 1})) AS i) WHERE before IS NOT NULL GROUP BY 1, 2, 3)"""


def last_sql(name: str, kind: str, every: int, value: str = "value") -> str:
    return f"""{name} AS (SELECT node, mount, time_bucket(INTERVAL {every} SECOND, ts) + INTERVAL {every} SECOND AS ts,
    last({value} ORDER BY ts, event_id) AS value FROM fast WHERE kind = '{kind}' GROUP BY 1, 2, 3)"""


SYSTEM_COND = f"""{FAST_SQL}, {growth_sql("oom", "error", 10)}, {growth_sql("net", "view", 10)}, {growth_sql("tcp", "click", 10)},
  {last_sql("load1", "purchase", 10)}, {last_sql("cores", "signup", 10)}, cond AS (
  SELECT 'HighCPUUsage' AS rule, node, mount, ts, event_id AS tie, value, value > 80 AS breach, 120 AS hold_s FROM fast WHERE kind = 'error'
  UNION ALL SELECT 'HighMemoryUsage', node, mount, ts, event_id, value, value > 90, 120 FROM fast WHERE kind = 'view'
  UNION ALL SELECT 'LowDiskSpace', node, mount, ts, event_id, value, value > 85, 300 FROM fast WHERE kind = 'click' AND mount <> '/tmp'
  UNION ALL SELECT 'CriticalDiskSpace', node, mount, ts, event_id, value, value > 95, 120 FROM fast WHERE kind = 'click' AND mount <> '/tmp'
  UNION ALL SELECT 'HighLoadAverage', node, mount, ts, 0, load1.value, load1.value > cores.value * 2, 300 FROM load1 JOIN cores USING (node, mount, ts)
  UNION ALL SELECT 'SystemOOMKills', node, mount, ts, 0, increase, increase > 0, 0 FROM oom
  UNION ALL SELECT 'HighNetworkErrors', node, mount, ts, 0, increase / 300.0, increase / 300.0 > 10, 120 FROM net
  UNION ALL SELECT 'HighTCPRetransmits', node, mount, ts, 0, increase / 300.0, increase / 300.0 > 100, 120 FROM tcp)"""


@query(
    f"""WITH {SYSTEM_COND}, {alerts_sql("cond", "rule, node, mount, hold_s", "hold_s * INTERVAL 1 SECOND")}
    SELECT rule, node, mount, active_at, fired_at, resolved_at, samples, state, {q6("value")} AS value FROM alerts"""
)
def ruleset_system(spark, folder):
    return _system_alerts(spark, folder).withColumn("value", fx.comparable(F.col("value"))).drop("severity")


TEXTS = """CASE rule WHEN 'HighCPUUsage' THEN 'High CPU usage on ' || node WHEN 'HighMemoryUsage' THEN 'High memory usage on ' || node
    WHEN 'LowDiskSpace' THEN 'Low disk space on ' || mount || ' (' || node || ')' WHEN 'CriticalDiskSpace' THEN 'Critical disk space on ' || mount || ' (' || node || ')'
    WHEN 'HighLoadAverage' THEN 'High load average on ' || node WHEN 'SystemOOMKills' THEN 'OOM kills detected on ' || node
    WHEN 'HighNetworkErrors' THEN 'High network errors on  (' || node || ')' WHEN 'HighTCPRetransmits' THEN 'High TCP retransmits on ' || node END"""


@query(
    f"""WITH {SYSTEM_COND}, {alerts_sql("cond", "rule, node, mount, hold_s", "hold_s * INTERVAL 1 SECOND")}
    SELECT rule, node, mount, active_at, state, CASE WHEN rule IN ('SystemOOMKills', 'CriticalDiskSpace') THEN 'critical' ELSE 'warning' END AS severity,
    {TEXTS} AS summary FROM alerts"""
)
def ruleset_texts(spark, folder):
    """Alerts of the system rules with the texts that a receiver gets; labels an alert lacks are empty."""
    found = _system_alerts(spark, folder)
    labels = F.create_map(F.lit("node"), "node", F.lit("mount"), "mount")
    shown = rs.rendered(found, rs.SYSTEM_RULES, labels, F.col("value").cast("string"))
    return shown.select("rule", "node", "mount", "active_at", "state", "severity", "summary")


def _system_alerts(spark, folder):
    value, counter = F.col("value"), F.col("counter")
    plan = {
        "error": [("system_cpu_usage", value), ("system_oom_kills", counter)],
        "view": [("system_memory_usage_percent", value), ("system_network_errors_total", counter)],
        "click": [("system_disk_usage_percent", value), ("system_tcp_retransmits", counter)],
        "purchase": [("system_load1", value)],
        "signup": [("system_cpu_cores", value)],
    }
    samples = _played(spark, folder, plan)
    return rs.ruleset_alerts(samples, rs.SYSTEM_RULES, ["node", "mount"], fx.TIE, rs.SYSTEM_EVERY)


COUNTER_OF = "node, mount, container"
KUBE_COND = f"""{FAST_SQL}, {growth_sql("restarts", "error", 30, COUNTER_OF)}, {growth_sql("cpu", "view", 30, COUNTER_OF)},
  {last_sql("cores", "click", 30)}, {last_sql("mem", "view", 30)}, {last_sql("memlimit", "click", 30)},
  {last_sql("capacity", "purchase", 30)}, {last_sql("allocatable", "signup", 30)}, cond AS (
  SELECT 'K8sPodCrashLooping' AS rule, node, mount, ts, 0 AS tie, increase AS value, increase > 3 AS breach, 120 AS hold_s FROM restarts
  UNION ALL SELECT 'K8sPodNotReady', node, mount, ts, event_id, k % 2, k % 2 = 1, 300 FROM fast WHERE kind = 'purchase' AND k % 5 < 4
  UNION ALL SELECT 'K8sNodeNotReady', node, mount, ts, event_id, k % 2, k % 2 = 1, 120 FROM fast WHERE kind = 'signup' AND k % 5 < 4
  UNION ALL SELECT 'K8sHighCPUUsage', node, mount, ts, 0, cpu.increase / 300.0 / cores.value, cpu.increase / 300.0 / cores.value > 0.8, 300
    FROM cpu JOIN cores USING (node, mount, ts)
  UNION ALL SELECT 'K8sHighMemoryUsage', node, mount, ts, 0, mem.value / memlimit.value, mem.value / memlimit.value > 0.9, 300
    FROM mem JOIN memlimit USING (node, mount, ts)
  UNION ALL SELECT 'K8sOutOfPods', node, mount, ts, 0, capacity.value - allocatable.value, capacity.value - allocatable.value < 10, 300
    FROM capacity JOIN allocatable USING (node, mount, ts)
  UNION ALL SELECT 'High Pod Restarts', node, mount, ts, event_id, value, value > 5, 300 FROM fast WHERE kind = 'error'
  UNION ALL SELECT 'Node Memory Pressure', node, mount, ts, event_id, k % 4, k % 4 = 1, 0 FROM fast WHERE kind = 'signup'
  UNION ALL SELECT 'Deployment Not Ready', node, mount, ts, event_id, k % 3, k % 3 > 0, 120 FROM fast WHERE kind = 'purchase')"""


@query(
    f"""WITH {KUBE_COND}, {alerts_sql("cond", "rule, node, mount, hold_s", "hold_s * INTERVAL 1 SECOND")}
    SELECT rule, node, mount, active_at, fired_at, resolved_at, samples, state, {q6("value")} AS value FROM alerts"""
)
def ruleset_kubernetes(spark, folder):
    """A pod's two containers each have counters of their own, which the rules sum."""
    value, counter, k = F.col("value"), F.col("counter"), F.col("k")
    plan = {
        "error": [("kube_pod_container_status_restarts_total", counter), ("kubernetes_pod_restarts_total", value)],
        "view": [("container_cpu_usage_seconds_total", counter), ("container_memory_working_set_bytes", value)],
        "click": [("kube_pod_container_resource_limits_cpu_cores", value), ("kube_pod_container_resource_limits_memory_bytes", value)],
        "purchase": [("kube_pod_status_ready", k % 2), ("kube_node_status_capacity_pods", value), ("kubernetes_deployment_replicas_unavailable", k % 3)],
        "signup": [("kube_node_status_condition", k % 2), ("kube_node_status_allocatable_pods", value), ("kubernetes_node_memory_pressure", k % 4)],
    }
    shaped = {kind: [(n, v, _labels(n)[0], _labels(n)[1]) for n, v in rows] for kind, rows in plan.items()}
    samples = _played(spark, folder, shaped)
    rows = rs.ruleset_alerts(samples, rs.KUBERNETES_RULES, ["node", "mount"], fx.TIE, rs.KUBERNETES_EVERY, ["node", "mount", "container"])
    return rows.withColumn("value", fx.comparable(F.col("value"))).drop("severity")


def _labels(name):
    """The ``condition`` and ``status`` labels; four in five readings report "false"."""
    reading = F.when(F.col("k") % 5 < 4, "false").otherwise("true")
    if name == "kube_node_status_condition":
        return F.lit("Ready").alias("condition"), reading.alias("status")
    return reading.alias("condition"), F.lit("").alias("status")

"""Alert rules over samples: matching, states, history, notifications."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegauge.functions.timing import as_micros, instant, micros
from tidegauge.plans import scratch
from tidegauge.plans.small import spec_table
from tidegauge.plans.ordered import Ordered, Previous, RunningLast, asof, covered


@dataclass(frozen=True)
class Rule:
    """A threshold on one metric that must hold for a while."""

    name: str
    metric: str
    operator: str
    threshold: float
    hold: timedelta = timedelta(0)
    severity: str = "warning"
    category: str = "system"
    summary: str = ""
    description: str = ""
    enabled: bool = True


# The rules every installation starts with.
DEFAULT_RULES = (
    Rule("HighCPUUsage", "system_cpu_usage", ">", 80.0, timedelta(minutes=2),
         summary="High CPU usage detected", description="CPU usage is above 80%"),
    Rule("HighMemoryUsage", "system_memory_usage_percent", ">", 90.0, timedelta(minutes=2),
         summary="High memory usage detected", description="Memory usage is above 90%"),
    Rule("LowDiskSpace", "system_disk_usage_percent", ">", 85.0, timedelta(minutes=5),
         summary="Low disk space", description="Disk usage is above 85%"),
)

# List order of severities; anything else comes last.
SEVERITIES = ("critical", "warning", "info")

HISTORY_LIMIT = 50


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (r.name, r.metric, r.operator, float(r.threshold), as_micros(r.hold), r.severity, r.category, r.summary, r.description, r.enabled)
        for r in rules
    ]
    columns = "rule string, metric_name string, operator string, threshold double, hold_us bigint, severity string, "
    return spec_table(spark, rows, columns + "category string, summary string, description string, enabled boolean")


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """The six comparisons; an unknown operator never breaches."""
    return (
        F.when(operator == ">", value > threshold)
        .when(operator == "<", value < threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", value == threshold)
        .when(operator == "!=", value != threshold)
        .otherwise(F.lit(False))
    )


def match_rules(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Every sample with every enabled rule on its metric, and whether it breaches.

    The rule table is tiny next to the samples, so Spark broadcasts it (by its
    measured size) and the samples stay where they are.
    """
    enabled = rules.filter("enabled").drop("enabled")
    matched = samples.join(enabled, samples["name"] == enabled["metric_name"])
    return matched.withColumn("breach", compare(F.col("value"), F.col("operator"), F.col("threshold")))


def timeline(samples: DataFrame, keys: list[str], tie: list[str], breach: Column, hold: Column) -> DataFrame:
    """Alert state at every sample: inactive, pending, firing or resolved.

    ``active_at`` is the start of the run of breaches the row belongs to (or
    has just ended), ``hold`` how long a run must last to fire, as an interval.
    """
    order = ["ts", *tie]
    live = F.col("_breach")
    rows = (
        Ordered(samples.withColumn("_breach", F.coalesce(breach, F.lit(False))), keys, order)
        .scan(_was=Previous(live))
        .derive(_first=F.when(live & ~F.coalesce(F.col("_was"), F.lit(False)), F.struct(*order)))
        .scan(_run=RunningLast(F.col("_first")))
        .frame()
    )
    lasted = micros(F.col("ts")) - micros(F.col("_run.ts"))
    long_enough = lasted >= micros(F.col("ts") + hold) - micros(F.col("ts"))
    state = (
        F.when(live & long_enough, "firing").when(live, "pending").when(F.col("_was"), "resolved").otherwise("inactive")
    )
    return rows.withColumns({"state": state, "active_at": F.when(live | F.col("_was"), F.col("_run.ts"))})


def alerts(samples: DataFrame, keys: list[str], tie: list[str], breach: Column, hold: Column, carry=()) -> DataFrame:
    """One row per run of breaches, which is also how repeated breaches are kept from re-opening an alert.

    ``carry`` names columns that are constant per key and go into the result.
    """
    rows = timeline(samples, keys, tie, breach, hold).filter(F.col("state") != "inactive")
    live, at = F.col("_breach"), F.struct("ts", *tie)
    firing, value = F.col("state") == "firing", F.col("value")
    grouped = rows.groupBy(*keys, "_run").agg(
        *[F.first(c).alias(c) for c in carry],
        F.min("active_at").alias("active_at"),
        F.min(F.when(firing, F.col("ts"))).alias("fired_at"),
        F.min(F.when(~live, F.col("ts"))).alias("resolved_at"),
        F.count_if(live).alias("samples"),
        F.min_by(F.when(live, value), F.when(live, at)).alias("_first_value"),
        F.max_by(F.when(live, value), F.when(live, at)).alias("_last_value"),
    )
    state = (
        F.when(F.col("resolved_at").isNotNull(), "resolved")
        .when(F.col("fired_at").isNotNull(), "firing")
        .otherwise("pending")
    )
    # While pending, an alert keeps the value it opened with.
    value = F.when(F.col("fired_at").isNotNull(), F.col("_last_value")).otherwise(F.col("_first_value"))
    return grouped.withColumns({"state": state, "value": value}).drop("_run", "_first_value", "_last_value")


def active(found: DataFrame) -> DataFrame:
    return found.filter(F.col("resolved_at").isNull())


def severity_rank(severity: Column) -> Column:
    ranks = [F.when(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)]
    return F.coalesce(*ranks, F.lit(len(SEVERITIES)))


def listed(found: DataFrame, tie: list[str], state: str = "firing") -> DataFrame:
    """Alerts of one state by severity, newest first."""
    order = [severity_rank(F.col("severity")), F.col("active_at").desc(), *[F.col(c) for c in tie]]
    return found.filter(F.col("state") == state).orderBy(*order)


def history(found: DataFrame, tie: list[str], limit: int = HISTORY_LIMIT) -> DataFrame:
    """The most recent closed or triggered alerts."""
    done = found.filter(F.col("state").isin("resolved", "firing"))
    return done.orderBy(F.col("active_at").desc(), *[F.col(c) for c in tie]).limit(limit)


def current_rules(changes: DataFrame, as_of, order: list[str]) -> DataFrame:
    """Rules after all changes up to ``as_of``.

    A change puts a rule (with its columns), deletes, enables or disables it.
    The definition is the latest put after the latest delete; the switch is the
    latest put, enable or disable.  Only maxima per rule are needed.
    """
    known = changes.filter(F.col("ts") <= instant(as_of))
    at, op = F.struct(*order), F.col("op")
    columns = [c for c in changes.columns if c not in ("rule", "op", *order)]
    latest = known.groupBy("rule").agg(
        F.max(F.when(op == "put", at)).alias("_put_at"),
        F.max(F.when(op == "delete", at)).alias("_deleted_at"),
        F.max_by(F.when(op == "put", F.struct(*columns)), F.when(op == "put", at)).alias("_row"),
        F.max_by(op, F.when(op.isin("put", "enable", "disable"), at)).alias("_switch"),
        F.max(F.when(op.isin("enable", "disable"), at)).alias("_switched_at"),
    )
    alive = F.col("_put_at").isNotNull() & (F.col("_deleted_at").isNull() | (F.col("_put_at") > F.col("_deleted_at")))
    # A switch thrown before the latest put no longer counts: a put starts enabled.
    off = F.col("_switch") == "disable"
    return latest.filter(alive).select("rule", "_row.*", (~off).alias("enabled"))


def rule_versions(changes: DataFrame, order: list[str]) -> DataFrame:
    """How each rule of each metric stood from each change on, until its next one.

    ``changes`` have ``name`` (the metric), ``rule``, ``op``, ``ts``, and for a
    put ``operator``, ``threshold`` and ``hold_us``; the result has ``since`` and
    the rest of ``order``, those terms, ``alive``, and ``gone_at``, the next time
    at which the rule is gone.  A put starts enabled; after a delete only a put
    brings the rule back.
    """
    rule = Window.partitionBy("name", "rule")
    so_far = rule.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    to_come = rule.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    op, parts = F.col("op"), ("operator", "threshold", "hold_us")
    # The definition that the latest put or delete left, and the latest switch.
    put = F.struct(*parts, F.lit(True).alias("there"))
    gone = F.struct(*[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in parts], F.lit(False).alias("there"))
    known = F.last(F.when(op == "put", put).when(op == "delete", gone), ignorenulls=True).over(so_far)
    switch = F.last(F.when(op.isin("put", "enable"), True).when(op == "disable", False), ignorenulls=True).over(so_far)
    alive = F.coalesce(F.col("_known.there") & F.col("_switch"), F.lit(False))
    rows = changes.withColumns({"_known": known, "_switch": switch}).withColumn("alive", alive)
    gone_at = F.last(F.when(~F.col("alive"), F.col("ts")), ignorenulls=True).over(to_come)
    terms = [F.col(f"_known.{c}").alias(c) for c in parts]
    return rows.select("name", "rule", F.col("ts").alias("since"), *order[1:], *terms, "alive", gone_at.alias("gone_at"))


def alert_log(samples: DataFrame, changes: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """One row whenever an alert becomes pending, firing or resolved under rules that change over time.

    Every sample is judged by the rules of its metric as they stood at its
    time, changes of the same time included.  What disables or deletes a rule
    resolves its open alerts; a put goes on with them under the new terms.

    A sample meets each rule of its metric once, as an as-of lookup among the
    rule's versions, so the rows do not grow with the number of changes.
    """
    versions = scratch.cut(rule_versions(changes, ["ts", tie])).filter(F.col("since").isNotNull())
    # Stored on its own, so that its size is known when the join is planned.
    rules = scratch.cut(versions.select(F.col("name").alias("_metric"), "rule").distinct())
    named = samples.select("name", *keys, "ts", F.col(tie).cast("bigint").alias("tie"), "value").filter(F.col("ts").isNotNull())
    asked = named.join(rules, named["name"] == rules["_metric"]).drop("_metric")
    terms = ["operator", "threshold", "hold_us", "alive", "gone_at"]
    stood = asof(asked, versions, ["name", "rule"], ["ts", "tie"], ["since", tie], terms).filter("alive")
    breach = compare(F.col("value"), F.col("operator"), F.col("threshold")).alias("breach")
    judged = scratch.cut(stood.select("name", "rule", *keys, "ts", F.lit(1).alias("kind"), "tie", "value", "hold_us", breach, "gone_at"))
    # A rule that goes away is a sample that breaches nothing, for each series that it found a breach in since it was last away.
    open_until = judged.filter(F.col("breach") & F.col("gone_at").isNotNull() & F.col("rule").isNotNull())
    closing = open_until.select("name", "rule", *keys, F.col("gone_at").alias("ts")).distinct().select(
        "name", "rule", *keys, "ts", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tie"), F.lit(None).cast("double").alias("value"),
        F.lit(0).cast("bigint").alias("hold_us"), F.lit(False).alias("breach"),
    )
    hold = F.lit(timedelta(microseconds=1)) * F.col("hold_us")
    found = alerts(judged.drop("gone_at").unionByName(closing), ["name", "rule", *keys], ["kind", "tie"], F.col("breach"), hold)
    waited = F.col("fired_at").isNull() | (F.col("fired_at") > F.col("active_at"))
    steps = (("pending", F.when(waited, F.col("active_at"))), ("firing", F.col("fired_at")), ("resolved", F.col("resolved_at")))
    each = F.array(*[F.struct(F.lit(n).alias("transition"), at.alias("at")) for n, at in steps])
    log = found.withColumn("_t", F.explode(each)).filter(F.col("_t.at").isNotNull())
    return log.select("name", "rule", *keys, "_t.transition", "_t.at", "active_at")


# Stands for "not over yet" where ends are compared.
_NEVER = datetime(9999, 1, 1)


def silenced_out(found: DataFrame, silences: DataFrame) -> DataFrame:
    """Alerts not covered by a silence of their rule and node at the time they opened."""
    checked = covered(found, "active_at", silences, "starts_at", "ends_at", ["rule", "node"])
    quiet = F.col("covered_until").isNotNull() & (F.col("covered_until") >= F.col("active_at"))
    return checked.filter(~quiet).drop("covered_until")


def without_children(found: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Drop alerts for which a parent rule was active on the same node when they opened."""
    parents = found.join(dependencies, found["rule"] == dependencies["parent"]).select(
        F.col("child").alias("rule"),
        "node",
        F.col("active_at").alias("opened"),
        F.coalesce("resolved_at", instant(_NEVER)).alias("closed"),
    )
    checked = covered(found, "active_at", parents, "opened", "closed", ["rule", "node"])
    under_parent = F.col("covered_until").isNotNull() & (F.col("covered_until") > F.col("active_at"))
    return checked.filter(~under_parent).drop("covered_until")


def ancestors(dependencies: DataFrame) -> DataFrame:
    """(child, parent) for every rule and every rule it depends on, directly or through others.

    Paths double in length with each round, so a chain of n takes log n rounds;
    the pairs number at most the square of the rules that depend on anything.
    Rules that depend on each other are peers: neither is the other's parent.
    """
    known = scratch.cut(dependencies.select("child", "parent").where("child <> parent").distinct())
    size = known.count()
    while True:
        up = known.select(F.col("child").alias("parent"), F.col("parent").alias("_above"))
        longer = known.join(up, "parent").select("child", F.col("_above").alias("parent"))
        known = scratch.cut(known.unionByName(longer).distinct())
        now = known.count()
        if now == size:
            break
        size = now
    back = known.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return known.join(back, ["child", "parent"], "left_anti")


def without_descendants(found: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Drop alerts for which any rule above theirs was active on the same node when they opened."""
    return without_children(found, ancestors(dependencies))


def outbox(found: DataFrame, channels: list[str]) -> DataFrame:
    """One row per firing or resolved transition and channel; nothing is sent."""
    transitions = F.array_compact(
        F.array(
            F.when(F.col("fired_at").isNotNull(), F.struct(F.lit("firing").alias("transition"), F.col("fired_at").alias("sent_at"))),
            # An alert that never fired was never announced, so its end is not either.
            F.when(
                F.col("fired_at").isNotNull() & F.col("resolved_at").isNotNull(),
                F.struct(F.lit("resolved").alias("transition"), F.col("resolved_at").alias("sent_at")),
            ),
        )
    )
    rows = found.withColumn("_t", F.explode(transitions)).select(*found.columns, "_t.*")
    return rows.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels]).cast("array<string>")))


def combine_conditions(conditions: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Conditions side by side per (labels, step), so that any boolean formula is a column expression.

    The inputs are stacked and aggregated once instead of joined one by one; a
    condition without a row there is false.
    """
    tagged = [df.select(*on, F.lit(n).alias("_c"), F.col("breach")) for n, df in conditions.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    flags = [F.coalesce(F.bool_or(F.when(F.col("_c") == n, F.col("breach"))), F.lit(False)).alias(n) for n in conditions]
    return stacked.groupBy(*on).agg(*flags)

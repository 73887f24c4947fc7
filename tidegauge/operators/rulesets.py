"""The shipped rule sets as column expressions over samples.

A rule set is evaluated by kind, not rule by rule: all plain thresholds share
one pass over the samples, all growth rules another, and each pair of metrics
is one aggregation.  The result of every kind is the same long table of
(rule, series, time, value, breach), which becomes alerts in a single scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.labels import Matcher, render
from tidegauge.functions.timing import as_micros
from tidegauge.operators.alerting import alerts, compare
from tidegauge.operators.select import by_name
from tidegauge.operators.series import increase_window
from tidegauge.operators.vectors import paired, vector
from tidegauge.plans.small import spec_table

MINUTE = timedelta(minutes=1)


@dataclass(frozen=True)
class Threshold:
    """A metric's samples against a constant."""

    metric: str
    matchers: tuple[Matcher, ...] = ()


@dataclass(frozen=True)
class Growth:
    """Counter growth over a look-back span, per second or in total."""

    metric: str
    span: timedelta = 5 * MINUTE
    per_second: bool = False


@dataclass(frozen=True)
class Pair:
    """Two metrics of the same labels and step: ``-``, ``/``, or left against right times ``factor``."""

    left: str
    right: str
    form: str
    factor: float = 1.0
    left_growth: bool = False


@dataclass(frozen=True)
class SetRule:
    name: str
    source: Threshold | Growth | Pair
    operator: str
    threshold: float
    hold: timedelta
    severity: str
    category: str
    summary: str = ""
    description: str = ""


_DISKS = (Matcher("mount", "!=", "/tmp"),)

# The eight system rules, evaluated every 10 s.
SYSTEM_EVERY = timedelta(seconds=10)
SYSTEM_RULES = (
    SetRule("HighCPUUsage", Threshold("system_cpu_usage"), ">", 80, 2 * MINUTE, "warning", "system",
            "High CPU usage on {{ $labels.node }}", "CPU usage is {{ $value }}% (threshold: 80%)"),
    SetRule("HighMemoryUsage", Threshold("system_memory_usage_percent"), ">", 90, 2 * MINUTE, "warning", "system",
            "High memory usage on {{ $labels.node }}", "Memory usage is {{ $value }}% (threshold: 90%)"),
    SetRule("LowDiskSpace", Threshold("system_disk_usage_percent", _DISKS), ">", 85, 5 * MINUTE, "warning", "system",
            "Low disk space on {{ $labels.mount }} ({{ $labels.node }})", "Disk usage is {{ $value }}% (threshold: 85%)"),
    SetRule("CriticalDiskSpace", Threshold("system_disk_usage_percent", _DISKS), ">", 95, 2 * MINUTE, "critical", "system",
            "Critical disk space on {{ $labels.mount }} ({{ $labels.node }})", "Disk usage is {{ $value }}% (threshold: 95%)"),
    SetRule("HighLoadAverage", Pair("system_load1", "system_cpu_cores", "against", factor=2), ">", 0, 5 * MINUTE, "warning", "system",
            "High load average on {{ $labels.node }}", "1-minute load average is {{ $value }} (CPUs: {{ system_cpu_cores }})"),
    SetRule("SystemOOMKills", Growth("system_oom_kills"), ">", 0, 0 * MINUTE, "critical", "system",
            "OOM kills detected on {{ $labels.node }}", "{{ $value }} OOM kills in the last 5 minutes"),
    SetRule("HighNetworkErrors", Growth("system_network_errors_total", per_second=True), ">", 10, 2 * MINUTE, "warning", "network",
            "High network errors on {{ $labels.interface }} ({{ $labels.node }})", "{{ $value }} errors per second"),
    SetRule("HighTCPRetransmits", Growth("system_tcp_retransmits", per_second=True), ">", 100, 2 * MINUTE, "warning", "network",
            "High TCP retransmits on {{ $labels.node }}", "{{ $value }} retransmits per second"),
)

# The six orchestration rules, evaluated every 30 s, and the three documented examples.
KUBERNETES_EVERY = timedelta(seconds=30)
KUBERNETES_RULES = (
    SetRule("K8sPodCrashLooping", Growth("kube_pod_container_status_restarts_total"), ">", 3, 2 * MINUTE, "critical", "kubernetes",
            "Pod {{ $labels.pod }} is crash looping", "Container {{ $labels.container }} restarted {{ $value }} times in 5 minutes"),
    SetRule("K8sPodNotReady", Threshold("kube_pod_status_ready", (Matcher("condition", "=", "false"),)), "==", 1, 5 * MINUTE,
            "warning", "kubernetes", "Pod {{ $labels.pod }} is not ready", "Pod has been not ready for more than 5 minutes"),
    SetRule("K8sNodeNotReady",
            Threshold("kube_node_status_condition", (Matcher("condition", "=", "Ready"), Matcher("status", "=", "false"))), "==", 1,
            2 * MINUTE, "critical", "kubernetes", "Node {{ $labels.node }} is not ready", "Node has been not ready for 2 minutes"),
    SetRule("K8sHighCPUUsage",
            Pair("container_cpu_usage_seconds_total", "kube_pod_container_resource_limits_cpu_cores", "/", left_growth=True), ">", 0.8,
            5 * MINUTE, "warning", "kubernetes", "High CPU usage in pod {{ $labels.pod }}", "CPU usage is {{ $value }}% of limit"),
    SetRule("K8sHighMemoryUsage",
            Pair("container_memory_working_set_bytes", "kube_pod_container_resource_limits_memory_bytes", "/"), ">", 0.9,
            5 * MINUTE, "warning", "kubernetes", "High memory usage in pod {{ $labels.pod }}", "Memory usage is {{ $value }}% of limit"),
    SetRule("K8sOutOfPods", Pair("kube_node_status_capacity_pods", "kube_node_status_allocatable_pods", "-"), "<", 10,
            5 * MINUTE, "warning", "kubernetes", "Node {{ $labels.node }} is running out of pod capacity",
            "Only {{ $value }} pods left available"),
    SetRule("High Pod Restarts", Threshold("kubernetes_pod_restarts_total"), ">", 5, 5 * MINUTE, "warning", "kubernetes",
            "Pod {{pod}} in namespace {{namespace}} has restarted {{value}} times"),
    SetRule("Node Memory Pressure", Threshold("kubernetes_node_memory_pressure"), "==", 1, 0 * MINUTE, "critical", "kubernetes"),
    SetRule("Deployment Not Ready", Threshold("kubernetes_deployment_replicas_unavailable"), ">", 0, 2 * MINUTE, "critical", "kubernetes"),
)


def rule_columns(samples: DataFrame, rules) -> DataFrame:
    """The rules' names, texts and limits as a small table."""
    rows = [(r.name, r.operator, float(r.threshold), as_micros(r.hold), r.severity, r.category, r.summary, r.description) for r in rules]
    return spec_table(
        samples.sparkSession,
        rows,
        "rule string, operator string, threshold double, hold_us bigint, severity string, category string, "
        "summary string, description string",
    )


def conditions(
    samples: DataFrame, rules, by: list[str], tie: list[str], every: timedelta, series: list[str] | None = None
) -> DataFrame:
    """(rule, labels, ts, tie, value, breach) for every rule of the set.

    Samples carry ``name``, ``ts``, ``value``, the tie columns, the labels in
    ``by`` and any label a matcher asks for.  ``series`` names all labels that
    tell counters apart (``by`` if left out): growth is taken counter by counter
    and then summed by the labels of the alert.
    """
    parts, series = [], series or by
    plain = [r for r in rules if isinstance(r.source, Threshold)]
    if plain:
        parts.append(_thresholds(samples, plain, by, tie))
    growth = [r for r in rules if isinstance(r.source, Growth)]
    for span in sorted({r.source.span for r in growth}):
        parts.append(_growths(samples, [r for r in growth if r.source.span == span], by, series, tie, span, every))
    parts += [_pair(samples, r, by, series, tie, every) for r in rules if isinstance(r.source, Pair)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ruleset_alerts(
    samples: DataFrame, rules, by: list[str], tie: list[str], every: timedelta, series: list[str] | None = None
) -> DataFrame:
    """Alerts of the whole set, one scan per (rule, labels)."""
    rows = conditions(samples, rules, by, tie, every, series)
    held = rows.join(rule_columns(samples, rules).select("rule", "hold_us", "severity"), "rule")
    hold = F.lit(timedelta(microseconds=1)) * F.col("hold_us")
    return alerts(held, ["rule", *by], ["tie"], F.col("breach"), hold, carry=["severity"])


def _thresholds(samples: DataFrame, rules, by: list[str], tie: list[str]) -> DataFrame:
    wanted = samples.filter(F.col("name").isin(*sorted({r.source.metric for r in rules})))
    hits = []
    for rule in rules:
        applies = reduce(lambda a, m: a & m.condition(samples), rule.source.matchers, F.col("name") == rule.source.metric)
        breach = compare(F.col("value"), F.lit(rule.operator), F.lit(float(rule.threshold)))
        hits.append(F.when(applies, F.struct(F.lit(rule.name).alias("rule"), breach.alias("breach"))))
    return wanted.withColumn("_h", F.explode(F.array_compact(F.array(*hits)))).select(
        "_h.rule", *by, "ts", F.col(tie[0]).cast("bigint").alias("tie"), "value", "_h.breach"
    )


def _grown(samples: DataFrame, names: list[str], by: list[str], series: list[str], tie: list[str], span: timedelta, every: timedelta) -> DataFrame:
    """Growth per name, labels and window, of each counter for itself and then summed."""
    grown = increase_window(by_name(samples, *names), ["name", *series], ["ts", *tie], span, every)
    if set(series) == set(by):
        return grown
    return grown.groupBy("name", *by, "window_end").agg(F.sum("increase").alias("increase"))


def _growths(samples: DataFrame, rules, by: list[str], series: list[str], tie: list[str], span: timedelta, every: timedelta) -> DataFrame:
    grown = _grown(samples, sorted({r.source.metric for r in rules}), by, series, tie, span, every)
    per_second = F.col("increase") / F.lit(as_micros(span) / 1e6)
    hits = []
    for rule in rules:
        value = per_second if rule.source.per_second else F.col("increase")
        breach = compare(value, F.lit(rule.operator), F.lit(float(rule.threshold)))
        hit = F.struct(F.lit(rule.name).alias("rule"), value.alias("value"), breach.alias("breach"))
        hits.append(F.when(F.col("name") == rule.source.metric, hit))
    return grown.withColumn("_h", F.explode(F.array_compact(F.array(*hits)))).select(
        "_h.rule", *by, F.col("window_end").alias("ts"), F.lit(0).cast("bigint").alias("tie"), "_h.value", "_h.breach"
    )


def _pair(samples: DataFrame, rule: SetRule, by: list[str], series: list[str], tie: list[str], every: timedelta) -> DataFrame:
    source = rule.source
    step_end = F.col("bucket") + F.lit(every)
    if source.left_growth:
        grown = _grown(samples, [source.left], by, series, tie, 5 * MINUTE, every)
        left = grown.select(*by, F.col("window_end").alias("ts"), (F.col("increase") / 300.0).alias("left"))
        right = vector(samples, source.right, by, every, tie).select(*by, step_end.alias("ts"), F.col("value").alias("right"))
        both = left.join(right, [*by, "ts"])
    else:
        wide = paired(samples, [source.left, source.right], by, every, tie)
        both = wide.select(*by, step_end.alias("ts"), F.col(source.left).alias("left"), F.col(source.right).alias("right"))
        both = both.filter(F.col("left").isNotNull() & F.col("right").isNotNull())
    value, limit = _pair_value(source, rule.threshold)
    breach = F.coalesce(compare(value, F.lit(rule.operator), limit), F.lit(False))
    return both.select(
        F.lit(rule.name).alias("rule"), *by, "ts", F.lit(0).cast("bigint").alias("tie"), value.alias("value"), breach.alias("breach")
    )


def _pair_value(source: Pair, threshold: float) -> tuple[Column, Column]:
    left, right = F.col("left"), F.col("right")
    match source.form:
        case "-":
            return left - right, F.lit(float(threshold))
        case "/":
            return F.try_divide(left, right), F.lit(float(threshold))
        case "against":
            return left, right * F.lit(float(source.factor))
    raise ValueError(f"unknown pair form {source.form!r}")


def rendered(found: DataFrame, rules, labels: Column, value: Column) -> DataFrame:
    """Add summary and description texts of each alert's rule."""
    texts = rule_columns(found, rules).select("rule", "summary", "description")
    return found.join(texts, "rule").withColumns(
        {"summary": render(F.col("summary"), labels, value), "description": render(F.col("description"), labels, value)}
    )

"""Choosing samples, alerts and nodes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.labels import Matcher, label, matching
from tidegauge.functions.timing import instant, utc_day
from tidegauge.plans.groups import top_n

# What a range query uses for arguments that are left out.
DEFAULT_SPAN = timedelta(hours=1)
DEFAULT_STEP = timedelta(seconds=15)
DEFAULT_LIMIT = 1000


@dataclass(frozen=True)
class TimeRange:
    """Inclusive on both ends."""

    start: datetime
    end: datetime
    step: timedelta = DEFAULT_STEP

    @staticmethod
    def ending(as_of: datetime, start=None, end=None, step=None) -> "TimeRange":
        """Missing ends are filled in relative to ``as_of``."""
        return TimeRange(start or as_of - DEFAULT_SPAN, end or as_of, DEFAULT_STEP if step is None else step)


def by_name(samples: DataFrame, *names: str) -> DataFrame:
    """Samples of the named metrics; no name means all of them."""
    if not names:
        return samples
    return samples.filter(F.col("name") == names[0] if len(names) == 1 else F.col("name").isin(*names))


def in_range(samples: DataFrame, start: datetime | None, end: datetime | None, ts: str = "ts", open_end: bool = False) -> DataFrame:
    """Both ends included (the end not, if ``open_end``); None leaves a side open.

    In a table with a ``date`` folder column, which holds the day in UTC, other
    days are not even listed.
    """
    chosen = samples
    if start is not None:
        chosen = chosen.filter(F.col(ts) >= instant(start))
    if end is not None:
        chosen = chosen.filter(F.col(ts) < instant(end) if open_end else F.col(ts) <= instant(end))
    if "date" in samples.columns:
        if start is not None:
            chosen = chosen.filter(F.col("date") >= F.lit(utc_day(start)))
        if end is not None:
            chosen = chosen.filter(F.col("date") <= F.lit(utc_day(end)))
    return chosen


def selection(samples: DataFrame, names: list[str], matchers: list[Matcher], span: TimeRange | None) -> DataFrame:
    """Name, time range and label conditions together, in the order a scan can prune."""
    chosen = by_name(samples, *names)
    if span is not None:
        chosen = in_range(chosen, span.start, span.end)
    return matching(chosen, matchers)


def first_points(samples: DataFrame, limit: int = DEFAULT_LIMIT, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The earliest ``limit`` points of a selection; the order must be total."""
    return samples.orderBy(*order).limit(limit)


def filter_alerts(alerts: DataFrame, state=None, severity=None, node=None, since=None) -> DataFrame:
    """Every condition is optional; ``severity`` and ``node`` are labels of the alert."""
    chosen = alerts
    if state is not None:
        chosen = chosen.filter(F.col("state") == state)
    if severity is not None:
        chosen = chosen.filter(label(chosen, "severity") == severity)
    if node is not None:
        chosen = chosen.filter(label(chosen, "node") == node)
    if since is not None:
        chosen = chosen.filter(F.col("active_at") >= instant(since))
    return chosen


def search_nodes(nodes: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Case-insensitive part of the id, and ``online``, ``offline`` or ``all``."""
    chosen = nodes.filter(F.lower(F.col("id")).contains(text.lower())) if text else nodes
    return chosen if status == "all" else chosen.filter(F.when(F.col("online"), "online").otherwise("offline") == status)


def _starts_with_any(column: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]).cast("array<string>"), lambda p: column.startswith(p))


def keep_disks(disks: DataFrame, ignored_types: list[str], ignored_mounts: list[str]) -> DataFrame:
    """Drop file systems by exact type and mounts by prefix."""
    kept = disks.filter(~F.col("fstype").isin(*ignored_types)) if ignored_types else disks
    return kept.filter(~_starts_with_any(F.col("mount"), ignored_mounts)) if ignored_mounts else kept


def keep_interfaces(
    interfaces: DataFrame, prefixes: list[str], include_all: bool = False, include_loopback: bool = False
) -> DataFrame:
    """Keep interfaces by name prefix; loopback only when asked for."""
    name = F.col("interface")
    kept = interfaces if include_loopback else interfaces.filter(~name.startswith("lo"))
    return kept if include_all else kept.filter(_starts_with_any(name, prefixes))


def keep_namespaces(
    samples: DataFrame, include: list[str] = (), exclude: list[str] = (), pod_labels: dict[str, str] | None = None
) -> DataFrame:
    """Include list (empty = all), exclude list and exact pod labels."""
    space = label(samples, "namespace")
    kept = samples.filter(space.isin(*include)) if include else samples
    kept = kept.filter(~space.isin(*exclude)) if exclude else kept
    return matching(kept, [Matcher(k, "=", v) for k, v in (pod_labels or {}).items()])


def newest_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group in the given order."""
    return top_n(df, group, order, n, "_rank").drop("_rank")


def fan_out(samples: DataFrame, nodes: list[str], names: list[str], span: TimeRange, limit: int, tie: str) -> DataFrame:
    """One query for many nodes: the first ``limit`` points of each."""
    chosen = selection(samples.filter(F.col("node").isin(*nodes)), names, [], span)
    return newest_per_group(chosen, ["node"], [F.col("ts"), F.col(tie)], limit)


def latest_points(samples: DataFrame, as_of: datetime, window: timedelta, n: int, tie: str) -> DataFrame:
    """Last ``n`` points per node within ``window`` before ``as_of``."""
    chosen = in_range(samples, as_of - window, as_of)
    return newest_per_group(chosen, ["node"], [F.col("ts").desc(), F.col(tie).desc()], n)

"""tidegauge: labelled time-series analytics for infrastructure metrics on Spark."""

from tidegauge.functions.labels import Matcher
from tidegauge.operators.aggregate import downsample_mean, downsample_pairwise, matrix, range_query
from tidegauge.operators.alerting import Rule, alerts, match_rules, rules_table, timeline
from tidegauge.operators.select import TimeRange, selection
from tidegauge.operators.series import counter_rate, increase_window, rate_window
from tidegauge.sources.tables import load, store

__all__ = [
    "Matcher",
    "Rule",
    "TimeRange",
    "alerts",
    "counter_rate",
    "downsample_mean",
    "downsample_pairwise",
    "increase_window",
    "load",
    "match_rules",
    "matrix",
    "range_query",
    "rate_window",
    "rules_table",
    "selection",
    "store",
    "timeline",
]

"""All registered queries."""

from tidegauge.workload import alerts, buckets, health, models, selection, storage, streams, timeseries  # noqa: F401
from tidegauge.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

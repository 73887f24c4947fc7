"""Queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Shared pieces of the oracle SQL: the fixture tables.
METRICS = """m AS (
  SELECT event_id, ts, value, event_type AS name, 'node-' || (user_id % 10) AS node, 'user-' || user_id AS usr,
         'collector=events,node=node-' || (user_id % 10) || ',user=user-' || user_id || ',' AS series_key
  FROM events)"""
COUNTS = """mk AS (
  SELECT event_id, ts, event_type AS name, 'node-' || (user_id % 10) AS node,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""
COUNTERS = (
    COUNTS
    + """, ct AS (
  SELECT event_id, ts, name, node,
         CAST(CAST(sum(k) OVER (PARTITION BY node, name ORDER BY ts, event_id) AS BIGINT) % 1000 AS DOUBLE) AS value
  FROM mk)"""
)
NODES = """nd AS (
  SELECT 'node-' || user_id AS id,
         CASE user_id % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'darwin' ELSE 'windows' END AS os,
         min(ts) AS created_at, max(ts) AS last_seen, count(*) AS heartbeats
  FROM events GROUP BY user_id)"""
AS_OF = "(SELECT max(ts) FROM events)"


def alerts_sql(source: str, keys: str, hold: str) -> str:
    """CTEs that turn ``source`` (keys, ts, tie, value, breach) into ``alerts``: gaps and islands."""
    return f"""was AS (
  SELECT *, lag(breach) OVER (PARTITION BY {keys} ORDER BY ts, tie) AS was FROM {source}),
isl AS (
  SELECT *, count(CASE WHEN breach AND NOT coalesce(was, false) THEN 1 END)
              OVER (PARTITION BY {keys} ORDER BY ts, tie) AS island FROM was),
run AS (
  SELECT *, min(ts) OVER (PARTITION BY {keys}, island) AS run_start FROM isl WHERE island > 0),
raw_alerts AS (
  SELECT {keys}, island, min(ts) FILTER (breach) AS active_at, count(*) FILTER (breach) AS samples,
         min(ts) FILTER (breach AND ts - run_start >= {hold}) AS fired_at,
         min(ts) FILTER (NOT breach AND was) AS resolved_at,
         first(value ORDER BY ts, tie) FILTER (breach) AS first_value, last(value ORDER BY ts, tie) FILTER (breach) AS last_value
  FROM run GROUP BY {keys}, island),
alerts AS (
  SELECT {keys}, active_at, fired_at, resolved_at, samples,
         CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN fired_at IS NOT NULL THEN 'firing' ELSE 'pending' END AS state,
         CASE WHEN fired_at IS NOT NULL THEN last_value ELSE first_value END AS value
  FROM raw_alerts)"""


def q6(expression: str) -> str:
    """SQL twin of ``fixtures.comparable``."""
    return f"floor(({expression}) * 1e6 + 0.3141592) / 1e6"


def query(sql: str | None = None, key: str | None = None) -> Callable[[Query], Query]:
    """Register a query, under its function name by default; no SQL means it is checked in the tests."""

    def register(function: Query) -> Query:
        name = key or function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register

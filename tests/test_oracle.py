"""Every registered query against its SQL on the smallest tables."""

import pytest
from comparison import oracle_connection, oracle_rows, spark_rows
from conftest import SMALL

import __spark_entry__ as entry_points
from tidegauge import workload

# The training-data queries have tests of their own in tests/llm.
QUERIES, ORACLES = workload.QUERIES, workload.ORACLES


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


def agree(spark, connection, key):
    df = QUERIES[key](spark, SMALL)
    names, want = oracle_rows(connection, ORACLES[key])
    assert sorted(df.columns) == names
    assert spark_rows(df) == want


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, key):
    agree(spark, connection, key)


SPLIT = (
    "range_query downsample_pairwise counter_rate delta_decode cpu_percent rate_of_change status_changes annotation_overlay event_correlation "
    "alert_resolve alert_active alert_cooldown alert_dependency silence_filter session_timeout zscore_detect zscore_online ewma_train ewma_detect "
    "fc_variance minmax_scale iforest_update detector_plugin"
).split()


@pytest.mark.parametrize("key", SPLIT)
def test_split_plans_agree_with_sql(spark, connection, split_everything, key):
    agree(spark, connection, key)


def test_every_query_has_a_home():
    assert set(ORACLES) <= set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) - set(ORACLES) == {"iforest_train", "iforest_score", "default_ensemble"}


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["name", "series_key", "bucket", "value", "points"]

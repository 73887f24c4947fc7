"""Stored tables: upserts and rollups, and which files they touch."""

import os
from datetime import date, datetime, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.functions.timing import utc_date
from tidegauge.operators import rollups, summaries
from tidegauge.operators.select import TimeRange
from tidegauge.plans import scratch
from tidegauge.sources import tables, upsert


def files(path):
    """Data files by folder, with the time they were written."""
    found = {}
    for folder, _, names in os.walk(path):
        data = {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
        if data:
            found[os.path.relpath(folder, path)] = data
    return found


def changed(before, after):
    return {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}


def dated(rows):
    return rows.withColumn("date", utc_date(F.col("ts"), dict(rows.dtypes)["ts"]))


@pytest.fixture
def stored(spark):
    path = scratch.new_folder(spark, "t-upsert")
    rows = fx.metrics(spark, SMALL).select("event_id", "ts", "name", "value", F.lit(0).alias("arrival"))
    tables.store(rows, path)
    return path, dated(rows)


KEY = ["name", "ts", "event_id"]


def content(spark, path):
    return {r["event_id"]: (r["value"], r["arrival"]) for r in tables.load(spark, path).collect()}


def test_upsert_rewrites_touched_folders_only(spark, stored):
    path, rows = stored
    base = content(spark, path)
    for arrival, condition in ((2, "name = 'error' AND day(ts) IN (3, 4)"), (1, "name = 'error' AND day(ts) IN (4, 5)"), (2, "name = 'error' AND day(ts) IN (3, 4)")):
        changes = rows.filter(condition).withColumns({"value": F.col("value") + arrival, "arrival": F.lit(arrival)})
        before = files(path)
        upsert.upsert(changes, path, KEY, ["arrival"], scratch.new_folder(spark, "t-staged"))
        days = {r[0] for r in changes.select(F.concat(F.lit("name=error/date="), F.col("date").cast("string"))).distinct().collect()}
        assert changed(before, files(path)) == days and len(days) == 2
    got = content(spark, path)
    assert len(got) == len(base)
    for r in rows.collect():
        day = r["ts"].day if r["name"] == "error" else 0
        arrival = 2 if day in (3, 4) else 1 if day == 5 else 0
        assert got[r["event_id"]] == (r["value"] + arrival, arrival)


def test_a_broken_upsert_is_finished_by_running_it_again(spark, stored):
    path, rows = stored
    changes = rows.filter("name = 'view'").withColumns({"value": F.lit(1.0), "arrival": F.lit(1)})
    staging = scratch.new_folder(spark, "t-staged")
    upsert._stage(changes, path, KEY, ["arrival"], staging, upsert.FOLDERS, "zstd")
    # A swap that died: the old folders of one day are gone, the new ones are not there yet.
    day = rows.filter("name = 'view'").select(F.min("date")).first()[0]
    for name in os.listdir(f"{path}/name=view/date={day}"):
        os.remove(f"{path}/name=view/date={day}/{name}")
    assert len(content(spark, path)) < rows.count()
    upsert.upsert(changes, path, KEY, ["arrival"], staging)
    got = content(spark, path)
    assert len(got) == rows.count()
    assert {i for i, v in got.items() if v == (1.0, 1)} == {r["event_id"] for r in rows.filter("name = 'view'").collect()}


def test_upsert_makes_a_table_and_leaves_it_without_rows(spark):
    path = scratch.new_folder(spark, "t-new")
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 5)], "id string, n int, at int").withColumn("part", upsert.bucket(F.col("id"), 4))
    upsert.upsert(rows, path, ["id"], ["at"], scratch.new_folder(spark, "t-staged"), ["part"])
    want = [("a", 2, 2), ("b", 1, 5)]
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "n", "at").collect())) == want
    before = files(path)
    upsert.upsert(rows.limit(0), path, ["id"], ["at"], scratch.new_folder(spark, "t-staged"), ["part"])
    assert files(path) == before


@pytest.fixture(scope="module")
def rolled(spark):
    raw, path = scratch.new_folder(spark, "t-raw"), scratch.new_folder(spark, "t-rollups")
    rows = fx.metrics(spark, SMALL).select("event_id", "ts", "name", "node", F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("value"))
    tables.store(rows, raw)
    samples = tables.load(spark, raw)
    rollups.build(samples, path, fx.KEYS, ["event_id"], date(2024, 1, 1), date(2024, 2, 2))
    return samples, raw, path


AT = datetime(2024, 1, 7)
SPANS = [
    (AT, AT + timedelta(days=3, microseconds=-1), timedelta(hours=1), False),
    (AT, AT + timedelta(days=3), timedelta(hours=6), True),
    (AT + timedelta(minutes=13), AT + timedelta(days=3, hours=5), timedelta(minutes=10), True),
    (AT + timedelta(minutes=1), AT + timedelta(minutes=3), timedelta(hours=1), True),
    (AT + timedelta(minutes=50), AT + timedelta(hours=7, minutes=10), timedelta(hours=6), True),
    (AT, AT + timedelta(days=2), timedelta(seconds=7), True),
]


@pytest.mark.parametrize("start, end, step, reads_samples", SPANS)
def test_rollups_give_the_rows_of_the_samples(spark, rolled, start, end, step, reads_samples):
    samples, raw, path = rolled
    span = TimeRange(start, end, step)
    got = rollups.range_query(spark, samples, path, ["error", "view"], span, fx.KEYS, ["event_id"])
    plain = rollups.range_query(spark, samples, path, ["error", "view"], span, fx.KEYS, ["event_id"], levels=())
    assert got.columns == plain.columns
    rows, want = ({(r["name"], r["node"], r["bucket"]): tuple(r)[3:] for r in f.collect()} for f in (got, plain))
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)
    read = {f.split("/name=")[0].removeprefix("file://") for f in got.inputFiles()}
    assert any(f.startswith(raw) for f in read) == reads_samples
    if not reads_samples:
        assert all(f"{path}/seconds=3600" in f for f in got.inputFiles()) and rows


def test_building_days_leaves_others_alone(spark, rolled):
    samples, _, path = rolled
    before = files(path)
    rollups.build(samples, path, fx.KEYS, ["event_id"], date(2024, 1, 9), date(2024, 1, 11))
    touched = changed(before, files(path))
    assert {f.split("/")[1] for f in touched} == {"date=2024-01-09", "date=2024-01-10"} and len(touched) == 6


def test_level_choice():
    def level(step, hours):
        return rollups.level_for(TimeRange(AT, AT + timedelta(hours=hours, microseconds=-1), step))

    assert level(timedelta(days=1), 24) == timedelta(hours=6)
    assert level(timedelta(hours=3), 24) == timedelta(hours=1)
    assert level(timedelta(hours=6), 5) == timedelta(hours=1)
    assert level(timedelta(minutes=15), 24) == timedelta(minutes=5)
    assert level(timedelta(minutes=4), 24) is None and level(timedelta(0), 24) is None
    with pytest.raises(ValueError):
        rollups._valid((timedelta(minutes=7), timedelta(hours=1)))


def test_summaries_count_series_within_their_error(spark):
    path = scratch.new_folder(spark, "t-summaries")
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("other").alias("name"), (F.col("id") % 20_000).cast("string").alias("key"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id)")).alias("ts"),
        F.create_map(F.lit("node"), F.lit("a"), F.when(F.col("id") % 2 == 0, "zone").otherwise("rack"), F.lit("b")).alias("labels"),
    )
    start, end = date(2024, 1, 1), date(2024, 1, 3)
    summaries.build(rows, path, "key", start, end, "labels")
    once = {r["name"]: tuple(r) for r in summaries.stats(spark, path, start, end).collect()}
    summaries.build(rows, path, "key", start, end, "labels")
    found = {r["name"]: r for r in summaries.stats(spark, path, start, end).collect()}
    assert once == {n: tuple(r) for n, r in found.items()}
    exact = {r[0]: r[1] for r in rows.groupBy("name").agg(F.count_distinct("key")).collect()}
    for name, row in found.items():
        assert abs(row["series"] - exact[name]) <= summaries.ERROR * exact[name]
        assert row["label_names"] == ["node", "rack", "zone"]
    assert found["hot"]["samples"] == 40_000
    assert not any(f.endswith("date=2024-01-02") for f in summaries.stats(spark, path, start, date(2024, 1, 2)).inputFiles())

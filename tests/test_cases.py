"""Hand-made cases and literal loops."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import labels as lb
from tidegauge.functions.timing import duration_micros, time_bucket, time_normalise
from tidegauge.operators import aggregate, alerting, anomaly, cooldown, feed, fleet, forecast, forest, report, select, series, vectors
from tidegauge.plans.ordered import Ordered, Previous, RunningLast, RunningMax, RunningSum, asof
from tidegauge.sources import ingest, tables

T0 = datetime(2024, 3, 1)
MINUTE = timedelta(minutes=1)


def points(spark, values, step=MINUTE, key="s"):
    rows = [(key, T0 + i * step, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, id long, value double")


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_pairwise_fold(spark):
    folded = aggregate.downsample_pairwise(points(spark, [10, 20, 40]), ["series"], timedelta(hours=1), ["id"]).first()
    assert (folded["value"], folded["points"]) == (27.5, 3)


def test_pairwise_fold_of_a_long_bucket(spark):
    random.seed(1)
    values = [random.uniform(-100, 100) for _ in range(5000)]
    folded = aggregate.downsample_pairwise(points(spark, values, timedelta(milliseconds=1)), ["series"], timedelta(hours=1), ["id"]).first()
    acc = values[0]
    for v in values[1:]:
        acc = (acc + v) / 2
    assert folded["value"] == pytest.approx(acc, rel=1e-12)


def test_missing_label_equals_empty(spark):
    df = spark.createDataFrame([({"a": "1"},)], "labels map<string,string>")
    assert lb.matching(df, [lb.Matcher("b", "=", "")]).count() == 1
    assert lb.matching(df, [lb.Matcher("b", "=", "x")]).count() == 0
    assert lb.matching(df, [lb.Matcher("b", "!=", "x"), lb.Matcher("a", "=~", "1|2"), lb.Matcher("a", "!~", "1.")]).count() == 1


def test_labels_hash(spark):
    df = spark.createDataFrame([({},), ({"node": "node-8", "collector": "events"},)], "labels map<string,string>")
    assert [r[0] for r in df.select(lb.labels_hash(F.col("labels"))).collect()] == ["", "b0dd85470fcdd611"]


def test_render(spark):
    df = spark.createDataFrame([({"node": "a", "mount": "/x"},)], "labels map<string,string>")
    text = lb.render(F.lit("{{ $labels.mount }} on {{node}}: {{ $value }}% {{ $labels.zone }}!"), F.col("labels"), F.lit("95"))
    assert df.select(text).first()[0] == "/x on a: 95% !"


def test_alert_states(spark):
    rows = points(spark, [70, 85, 90, 95, 60])
    breach, hold = F.col("value") > 80, F.lit(2 * MINUTE)
    states = column(alerting.timeline(rows, ["series"], ["id"], breach, hold), "state")
    assert states == ["inactive", "pending", "pending", "firing", "resolved"]
    alert = alerting.alerts(rows, ["series"], ["id"], breach, hold).first()
    assert (alert["active_at"], alert["fired_at"], alert["resolved_at"]) == (T0 + MINUTE, T0 + 3 * MINUTE, T0 + 4 * MINUTE)
    assert (alert["samples"], alert["state"], alert["value"]) == (3, "resolved", 95.0)


def test_alert_machine_equals_a_literal_loop(spark):
    random.seed(7)
    values = [random.choice([10, 90]) for _ in range(400)]
    found = alerting.alerts(points(spark, values), ["series"], ["id"], F.col("value") > 80, F.lit(3 * MINUTE))
    got = sorted((r["active_at"], r["fired_at"], r["resolved_at"], r["samples"]) for r in found.collect() if r["resolved_at"])
    want, start, fired, count = [], None, None, 0
    for i, v in enumerate(values):
        now = T0 + i * MINUTE
        if v > 80:
            if start is None:
                start, fired, count = now, None, 0
            count += 1
            if fired is None and now - start >= 3 * MINUTE:
                fired = now
        elif start is not None:
            want.append((start, fired, now, count))
            start = None
    assert sorted(got, key=str) == sorted(want, key=str)


def test_health_limits(spark):
    ages = [90, 91, 270, 271]
    beats = spark.createDataFrame([(str(a), T0 - timedelta(seconds=a)) for a in ages], "id string, last_seen timestamp_ntz")
    checked = {r["id"]: r["status"] for r in fleet.check_health(beats, T0).collect()}
    assert checked == {"90": "healthy", "91": "unhealthy", "270": "unhealthy", "271": "offline"}


@pytest.mark.parametrize("split", [False, True])
def test_ewma_equals_a_literal_loop(spark, split, request):
    if split:
        request.getfixturevalue("split_everything")
    random.seed(3)
    values = [random.gauss(50, 10) for _ in range(90)]
    rows = points(spark, values).unionByName(points(spark, values[:40], key="t"))
    states = anomaly.ewma_states(rows, ["series"], ["ts", "id"], 0.3).filter("series = 's'").orderBy("id").collect()
    mean, var = values[0], 0.0
    for i, row in enumerate(states):
        if i:
            assert (row["mean_before"], row["var_before"]) == pytest.approx((mean, var))
            mean, var = 0.3 * values[i] + 0.7 * mean, 0.3 * (values[i] - mean) ** 2 + 0.7 * var
        else:
            assert row["mean_before"] is None
        assert (row["mean_after"], row["var_after"]) == pytest.approx((mean, var))


def test_ewma_without_spread(spark):
    states = anomaly.ewma_states(points(spark, [10, 10, 10, 11]), ["series"], ["ts", "id"])
    judged = anomaly.ewma_detect(states).orderBy("id").collect()
    assert [(r["score"], r["is_anomaly"]) for r in judged] == [(0.0, False), (0.0, False), (1.0, True)]
    assert anomaly.valid_alpha(1.5) == 0.2


def test_zscore_without_spread(spark):
    model = anomaly.zscore_train(points(spark, [5] * 10), ["series"])
    scored = anomaly.zscore_detect(points(spark, [5, 6]), model, ["series"]).orderBy("id").collect()
    assert [(r["is_anomaly"], r["score"]) for r in scored] == [(False, 0.0), (True, 0.0)]
    assert anomaly.zscore_train(points(spark, [5] * 9), ["series"]).count() == 0


def test_multi_detect(spark):
    rows = [(1, 0.6, True, 0.0), (1, 0.4, False, 0.5), (2, 0.6, None, None), (2, 0.4, True, 0.7), (3, 0.6, None, None)]
    scores = spark.createDataFrame(rows, "id long, weight double, is_anomaly boolean, score double")
    got = {r["id"]: (r["score"], r["is_anomaly"]) for r in anomaly.multi_detect(scores, ["id"], 0.7).collect()}
    assert got == {1: (pytest.approx(0.8), True), 2: (pytest.approx(0.7), False)}


def test_forest_constants():
    assert [forest.expected_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert forest.expected_path(256) == 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256


def test_forest_flags_the_outlier(spark):
    random.seed(5)
    values = [random.gauss(50, 1) for _ in range(600)] + [500.0]
    rows = points(spark, values)
    steps = forest.train(forest.training_pool(rows, ["series"], ["id"]), ["series"])
    scored = forest.score(rows, steps, ["series"], ["id"]).collect()
    assert len(scored) == 601 and all(0 < r["score"] <= 1 for r in scored)
    assert max(scored, key=lambda r: r["score"])["value"] == 500.0
    assert next(r for r in scored if r["value"] == 500.0)["is_anomaly"]


def literal_tree(values, level, depth, draw):
    """The textbook recursion, as nested tuples."""
    if len(values) <= 1 or level >= depth or min(values) == max(values):
        return len(values)
    split = min(values) + draw() * (max(values) - min(values))
    left = literal_tree([v for v in values if v < split], level + 1, depth, draw)
    return split, left, literal_tree([v for v in values if v >= split], level + 1, depth, draw)


def literal_path(node, x, level=0):
    if isinstance(node, int):
        return level + forest.expected_path(node)
    split, left, right = node
    return literal_path(left if x < split else right, x, level + 1)


@pytest.mark.parametrize("seed", range(5))
def test_forest_steps_equal_walking_the_tree(seed):
    random.seed(seed)
    values = np.sort(np.array([round(random.uniform(0, 20), 1) for _ in range(200)]))
    starts, paths = forest._leaves(values, 8, np.random.default_rng(seed))
    tree = literal_tree(values.tolist(), 0, 8, np.random.default_rng(seed).random)
    for x in [-5.0, 25.0, *values, *(random.uniform(-1, 21) for _ in range(500))]:
        assert paths[np.searchsorted(starts, x, side="right") - 1] == pytest.approx(literal_path(tree, x))


def test_forest_score_equals_walking_all_trees(spark):
    """Fewer rows than a sample: every tree sees all of them, so a literal forest can be grown next to it."""
    random.seed(8)
    rows = points(spark, [round(random.gauss(0, 3), 1) for _ in range(40)])
    pool = forest.training_pool(rows, ["series"], ["id"], trees=5, sample=64)
    steps = forest.train(pool, ["series"], trees=5, sample=64)
    scored = {r["id"]: r["score"] for r in forest.score(rows, steps, ["series"], ["id"], sample=64).collect()}
    drawn = pool.orderBy("_tree", "_draw").collect()
    assert len(drawn) == 5 * 40
    rng = np.random.default_rng([0, drawn[0]["_hash"]])
    trees = [literal_tree(sorted(r["value"] for r in drawn if r["_tree"] == t), 0, 6, rng.random) for t in range(5)]
    for r in rows.collect():
        path = sum(literal_path(t, r["value"]) for t in trees) / 5
        assert scored[r["id"]] == pytest.approx(2 ** (-path / forest.expected_path(64)))


@pytest.mark.parametrize("count", [5, 40, 3000])
def test_forest_from_samples_equals_that_of_its_pool(spark, count):
    random.seed(9)
    rows = points(spark, [round(random.gauss(0, 3), 1) for _ in range(count)]).unionByName(points(spark, [1.0] * 30, key="flat"))
    pool = forest.training_pool(rows, ["series"], ["id"], trees=7, sample=64)
    want = sorted(map(tuple, forest.train(pool, ["series"], trees=7, sample=64).collect()))
    got = sorted(map(tuple, forest.fit(rows.repartition(5), ["series"], ["id"], trees=7, sample=64).collect()))
    assert got == want and ({r[0] for r in got} == {"s", "flat"} if count > 9 else {"flat"})


@pytest.mark.parametrize("split", [False, True])
def test_forest_does_not_depend_on_partitions(spark, split, request):
    random.seed(6)
    rows = points(spark, [random.uniform(0, 9) for _ in range(300)])
    once = forest.training_pool(rows.repartition(3), ["series"], ["id"], 2, 50).collect()
    assert all(sum(r["_tree"] == t for r in once) == 50 for t in range(2))
    if split:
        request.getfixturevalue("split_everything")
    twice = forest.training_pool(rows.repartition(8), ["series"], ["id"], 2, 50).collect()
    assert sorted(once) == sorted(twice) and len(once) == 100


def test_delta_round_trip_and_resets(spark):
    deltas = series.delta_encode(points(spark, [5, 7, 4]), ["series"], ["ts", "id"])
    assert column(deltas, "delta") == [5.0, 2.0, -3.0]
    assert column(series.delta_decode(deltas.drop("value"), ["series"], ["ts", "id"]), "value") == [5.0, 7.0, 4.0]
    assert column(series.counter_increase(points(spark, [90, 100, 4]), ["series"], ["ts", "id"]), "increase") == [10.0, 4.0]


def test_forecast_of_a_straight_line(spark):
    line = points(spark, [2 * i + 1 for i in range(10)], timedelta(hours=1))
    model = forecast.fit(line, ["series"], ["ts", "id"])
    row = model.first()
    assert (row["slope"], row["intercept"], row["variance"]) == (pytest.approx(2), pytest.approx(1), 0.01)
    ahead = forecast.predict(model, ["series"], 2, timedelta(hours=1)).orderBy("step").collect()
    assert ahead[0]["value"] == pytest.approx(21) and ahead[0]["ts"] == T0 + timedelta(hours=10)
    assert ahead[1]["upper"] - ahead[1]["value"] == pytest.approx(1.96 * math.sqrt(0.02))
    restarted = forecast.predict(model, ["series"], 1, timedelta(hours=1), origin="start").first()
    assert restarted["value"] == pytest.approx(3)


def test_times(spark):
    texts = ["2024-03-01T10:00:00+02:00", "1700000000", "1h30m", "-5m", "1.5s", "soon", "10"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    at = time_normalise(F.col("text"), F.lit(T0), F.lit(datetime(2000, 1, 1))).cast("timestamp_ntz")
    got = column(df.withColumn("at", at), "at")
    assert got == [
        datetime(2024, 3, 1, 8), datetime(2023, 11, 14, 22, 13, 20), T0 - timedelta(minutes=90), T0 + timedelta(minutes=5),
        T0 - timedelta(seconds=1.5), datetime(2000, 1, 1), datetime(1970, 1, 1, 0, 0, 10),
    ]
    assert column(df.withColumn("d", duration_micros(F.col("text"))), "d")[2:5] == [5_400_000_000, -300_000_000, 1_500_000]


def test_weekly_buckets_start_on_monday(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 1, 5),), (datetime(1969, 12, 28, 1),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(time_bucket(F.col("ts"), timedelta(days=7))).collect()] == [datetime(2024, 2, 26), datetime(1969, 12, 22)]


def test_texts(spark):
    sizes = [None, 0.0, 512.0, 1024.0, 1536.0, 5 * 1024.0**4]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id int, v double")
    assert column(df.withColumn("t", report.bytes_text(F.col("v"))), "t") == ["N/A", "N/A", "512 Bytes", "1 KB", "1.5 KB", "5 TB"]
    up = spark.createDataFrame([(0, None), (1, 90061.0), (2, 59.0)], "id int, v double")
    assert column(up.withColumn("t", report.uptime_text(F.col("v"))), "t") == ["N/A", "1d 1h 1m", "0d 0h 0m"]


@pytest.mark.parametrize("split", [False, True])
def test_cooldown_equals_a_greedy_loop(spark, split, request):
    if split:
        request.getfixturevalue("split_everything")
    random.seed(9)
    seconds = sorted(random.randrange(0, 3000) for _ in range(200))
    rows = [("k", T0 + timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz, id long")
    sent = [r["id"] for r in cooldown.cooled_down(df, ["key"], "at", "id", timedelta(seconds=60)).collect()]
    want, last = [], None
    for i, s in enumerate(seconds):
        if last is None or s - last >= 60:
            want.append(i)
            last = s
    assert sorted(sent) == want


@pytest.mark.parametrize("split", [False, True])
def test_scans(spark, split, request):
    if split:
        request.getfixturevalue("split_everything")
    random.seed(11)
    data = [random.choice([None, 1.0, 2.0, 5.0]) for _ in range(120)]
    rows = [("a" if i % 3 else None, i, v) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "key string, id long, value double")
    v = F.col("value")
    scans = {"before": Previous(v), "third": Previous(v, 3), "total": RunningSum(v), "last": RunningLast(v), "top": RunningMax(v),
             "past": RunningSum(F.lit(1), inclusive=False)}
    got = {r["id"]: r for r in Ordered(df, ["key"], ["id"]).scan(**scans).frame().collect()}
    for key in ("a", None):
        seen = []
        for k, i, value in rows:
            if k != key:
                continue
            known = [x for x in [*seen, value] if x is not None]
            row = got[i]
            assert row["before"] == (seen[-1] if seen else None)
            assert row["third"] == (seen[-3] if len(seen) >= 3 else None)
            assert row["total"] == (sum(known) if known else None)
            assert row["last"] == (known[-1] if known else None)
            assert row["top"] == (max(known) if known else None)
            assert row["past"] == (len(seen) or None)
            seen.append(value)


@pytest.mark.parametrize("split", [False, True])
def test_asof_equals_a_loop(spark, split, request):
    if split:
        request.getfixturevalue("split_everything")
    random.seed(13)
    left = [(random.choice("ab"), random.randrange(100), i) for i in range(80)]
    right = [(random.choice("ab"), random.randrange(100), i) for i in range(60)]
    ldf = spark.createDataFrame(left, "key string, t long, id long")
    rdf = spark.createDataFrame(right, "key string, t long, rid long")
    got = {r["id"]: r["rid"] for r in asof(ldf, rdf, ["key"], ["t", "id"], ["t", "rid"], ["rid"]).collect()}
    for key, t, i in left:
        before = [(rt, rid) for k, rt, rid in right if k == key and rt <= t]
        assert got[i] == (max(before)[1] if before else None)


@pytest.mark.parametrize("split", [False, True])
def test_top_rows_per_group(spark, split, request):
    if split:
        request.getfixturevalue("split_everything")
    df = points(spark, range(3000)).unionByName(points(spark, range(5), key="t"))
    newest = select.newest_per_group(df, ["series"], [F.col("id").desc()], 1200)
    ids = sorted((r["series"], r["id"]) for r in newest.collect())
    assert ids == [("s", i) for i in range(1800, 3000)] + [("t", i) for i in range(5)]


def test_last_write_wins(spark):
    rows = [("m", 5, "h", 1.0, 1), ("m", 5, "h", 2.0, 2), ("m", 6, "h", 3.0, 1)]
    df = spark.createDataFrame(rows, "name string, ts_ns long, labels_hash string, value double, arrival long")
    once = ingest.last_write(df, ["name", "ts_ns", "labels_hash"], ["arrival"])
    assert sorted(r["value"] for r in once.collect()) == [2.0, 3.0]
    again = ingest.last_write(once.unionByName(once), ["name", "ts_ns", "labels_hash"], ["arrival"])
    assert sorted(once.collect()) == sorted(again.collect())


def test_correlation_equals_a_loop(spark):
    random.seed(17)
    samples = points(spark, [random.uniform(0, 9) for _ in range(100)])
    events = spark.createDataFrame([("s", T0 + timedelta(seconds=90 * i), i) for i in range(30)], "series string, ts timestamp_ntz, event long")
    got = vectors.correlate(events, samples, ["series"], "event", 5 * MINUTE, ["id"]).collect()
    known = [(r["ts"], r["value"]) for r in samples.collect()]
    for row in got:
        before = [v for t, v in known if row["ts"] - 5 * MINUTE <= t <= row["ts"]]
        after = [v for t, v in known if row["ts"] <= t <= row["ts"] + 5 * MINUTE]
        assert (row["samples_before"], row["samples_after"]) == (len(before), len(after))
        assert row["mean_before"] == (pytest.approx(sum(before) / len(before)) if before else None)
        assert row["mean_after"] == (pytest.approx(sum(after) / len(after)) if after else None)


def test_stored_table_prunes_by_name_and_day(spark, tmp_path):
    rows = points(spark, range(100), timedelta(hours=1)).withColumn("name", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    tables.store(rows, str(tmp_path / "t"))
    stored = tables.load(spark, str(tmp_path / "t"))
    span = select.TimeRange(T0 + timedelta(hours=30), T0 + timedelta(hours=40))
    chosen = select.selection(stored, ["even"], [], span)
    assert sorted(r["id"] for r in chosen.collect()) == [30, 32, 34, 36, 38, 40]
    scan = chosen._jdf.queryExecution().executedPlan().toString()
    folders = scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    assert "name" in folders and "date" in folders
    assert stored.select(rows.columns).exceptAll(rows).count() == 0


def test_subscriptions_of_any_number_and_type(spark):
    rows = [("alert", T0, "n", str(i)) for i in range(20)] + [("deploy", T0, "n", "d"), ("all", T0, "n", "e")]
    messages = spark.createDataFrame(rows, "type string, ts timestamp_ntz, node_id string, data string")
    subscriptions = spark.createDataFrame([("a", "all"), ("a", "alert"), ("b", "metrics"), ("c", "alert"), ("d", "deploy")], "client string, topic string")
    few = sorted(feed.delivered(messages, subscriptions).select("client", "data").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    many = sorted(feed.delivered(messages, subscriptions).select("client", "data").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert few == many and len(few) == 22 + 20 + 1


def test_online_score_of_large_values(spark):
    rows = points(spark, [1e9 + i % 2 for i in range(40)])
    scored = anomaly.zscore_online(rows, ["series"], ["ts", "id"]).orderBy("ts").collect()
    assert scored[-1]["stddev"] == pytest.approx(0.5, rel=1e-2) and scored[-1]["mean"] == pytest.approx(1e9 + 0.5)


def test_correlation_sees_only_its_window(spark):
    """Earlier values, huge or not a number, must not reach a window that doesn't hold them."""
    values = [float("nan")] + [1e15] * 500 + [5.3]
    rows = points(spark, values, timedelta(hours=1))
    last = rows.orderBy(F.col("ts").desc()).first()
    events = spark.createDataFrame([(1, last["series"], last["ts"])], "event long, series string, ts timestamp_ntz")
    events = events.withColumn("ts", F.col("ts").cast(rows.schema["ts"].dataType))
    found = vectors.correlate(events, rows, ["series"], "event", timedelta(minutes=30), ["id"]).first()
    assert (found["samples_before"], found["mean_before"], found["samples_after"], found["mean_after"]) == (1, 5.3, 1, 5.3)


def test_default_ensemble_is_the_weighted_mean_of_its_two(spark):
    from tidegauge.operators import detectors

    random.seed(9)
    known, asked = points(spark, [random.gauss(50, 2) for _ in range(120)]), points(spark, [50.0, 90.0, 51.0])
    pair = [(detectors.Ewma(["series"], ["ts", "id"]), 0.6), (detectors.Forest(["series"], ["id"]), 0.4)]
    both = {r["id"]: r["score"] for r in anomaly.run_detectors(known, asked, pair, ["id"], 0.6).collect()}
    single = [{r["id"]: r["score"] for r in d.score(asked, d.fit(known)).select("id", "score").collect()} for d, _ in pair]
    for i, score in both.items():
        assert score == pytest.approx(0.6 * single[0][i] + 0.4 * single[1][i])


@pytest.mark.parametrize("split", [False, True])
def test_online_zscore_survives_an_outlier(spark, split, request):
    """Values near 1e9, then a zero far below them: no earlier row changes and the deviation stays exact."""
    if split:
        request.getfixturevalue("split_everything")
    values = [1e9 + i % 2 for i in range(200)] + [0.0, 1e9, 1e9]
    judged = {r["id"]: r for r in anomaly.zscore_online(points(spark, values), ["series"], ["ts", "id"]).collect()}
    assert judged.keys() == set(range(10, len(values)))
    for i, row in judged.items():
        past = np.array(values[:i], dtype=np.longdouble)
        assert row["n"] == i and row["mean"] == pytest.approx(float(past.mean()), rel=1e-12)
        assert row["stddev"] == pytest.approx(float(past.std()), rel=1e-6)
    assert judged[200]["is_anomaly"] and not judged[199]["is_anomaly"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_seasons_follow_utc_whatever_the_session_zone(spark, kind):
    stamps = [(int((T0 + i * timedelta(minutes=30) - datetime(1970, 1, 1)).total_seconds() * 1e6), i, float(i % 48 // 2)) for i in range(480)]
    base = spark.createDataFrame(stamps, "us long, id long, value double").withColumn("series", F.lit("s"))
    seasons, values = [], []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            ts = F.timestamp_micros("us") if kind == "timestamp" else F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, us / 1000000)")
            rows = base.withColumn("ts", ts if kind == "timestamp" else F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, us / 1000000)"))
            model = forecast.fit(rows, ["series"], ["ts", "id"])
            seasons.append(model.first()["season"])
            values.append(column(forecast.predict(model, ["series"], 24, timedelta(hours=1)), "value", "step"))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seasons[0] == pytest.approx(seasons[1]) and values[0] == pytest.approx(values[1])
    assert seasons[0][23] - seasons[0][0] > 20


def test_event_correlation_leaves_nulls_out(spark):
    rows = [("s", T0, 1, 4.0), ("s", T0 + MINUTE, 2, None), ("s", T0 + 3 * MINUTE, 3, 6.0), ("s", T0 + 4 * MINUTE, 4, None)]
    samples = spark.createDataFrame(rows, "series string, ts timestamp_ntz, id long, value double")
    events = spark.createDataFrame([("s", T0 + 2 * MINUTE, 9)], "series string, ts timestamp_ntz, event long")
    found = vectors.correlate(events, samples, ["series"], "event", timedelta(minutes=10), ["id"]).first()
    assert (found["samples_before"], found["mean_before"], found["samples_after"], found["mean_after"]) == (1, 4.0, 1, 6.0)


def test_ancestors_of_chains_diamonds_and_cycles(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("d", "l"), ("d", "r"), ("l", "t"), ("r", "t")]
    pairs += [("x", "y"), ("y", "z"), ("z", "x"), ("y", "c8"), ("low", "z"), ("self", "self")]
    found = {tuple(r) for r in alerting.ancestors(spark.createDataFrame(pairs, "child string, parent string")).collect()}
    want = {(f"c{i}", f"c{j}") for i in range(9) for j in range(i + 1, 10)} | {("d", "l"), ("d", "r"), ("d", "t"), ("l", "t"), ("r", "t")}
    want |= {(a, c) for a in "xyz" for c in ("c8", "c9")} | {("low", a) for a in ("x", "y", "z", "c8", "c9")}
    assert found == want


def rule_history():
    """Samples and changes of two metrics, many at the same time, and rows without a time."""
    rng = random.Random(8)
    minutes = [T0 + i * MINUTE for i in range(60)]
    samples = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice(minutes), i, rng.choice([1.0, 5.0, 9.0, None])) for i in range(300)]
    ops = ["put", "put", "put", "delete", "enable", "disable"]
    changes = [
        (rng.choice("ab"), rng.choice(["r", "s"]), rng.choice(minutes), 1000 + i, rng.choice(ops), rng.choice([">", "<", "!="]), 5.0, rng.choice([0, 60, 180]) * 1_000_000)
        for i in range(80)
    ]
    changes = [(c[0], f"{c[0]}-{c[1]}", *c[2:]) for c in changes]
    return samples + [("a", "x", None, 400, 9.0)], changes


def looped_log(samples, changes):
    """What happens, one row after the other."""
    tests = {">": lambda v: v > 5, "<": lambda v: v < 5, "!=": lambda v: v != 5}
    rules, live, log = {}, {}, []
    for row in sorted([(c[2], 0, c[3], c) for c in changes] + [(s[2], 1, s[3], s) for s in samples if s[2] is not None]):
        at, kind, _, r = row
        if kind == 0:
            name, rule, op = r[0], r[1], r[4]
            if op == "put":
                rules[rule] = [name, r[5], timedelta(microseconds=r[7]), True]
            elif op == "delete":
                rules.pop(rule, None)
            elif rule in rules:
                rules[rule][3] = op == "enable"
            if rule not in rules or not rules[rule][3]:
                for key in [k for k in live if k[1] == rule]:
                    log.append((*key, "resolved", at, live.pop(key)[0]))
            continue
        for rule, (name, operator, hold, on) in rules.items():
            if name != r[0] or not on:
                continue
            key = (name, rule, r[1])
            if r[4] is not None and tests[operator](r[4]):
                if key not in live:
                    live[key] = [at, False]
                    log += [(*key, "pending", at, at)] * (hold > timedelta(0))
                if not live[key][1] and at - live[key][0] >= hold:
                    live[key][1] = True
                    log.append((*key, "firing", at, live[key][0]))
            elif key in live:
                log.append((*key, "resolved", at, live.pop(key)[0]))
    return log


def _alert_log(spark):
    samples, changes = rule_history()
    rows = spark.createDataFrame(samples, "name string, node string, ts timestamp_ntz, id long, value double")
    changed = spark.createDataFrame(changes, "name string, rule string, ts timestamp_ntz, id long, op string, operator string, threshold double, hold_us long")
    return alerting.alert_log(rows, changed, ["node"], "id"), looped_log(samples, changes)


def test_alert_log_equals_a_loop(spark):
    log, want = _alert_log(spark)
    # An alert that fires at once was never pending, whatever hold the rule had when it opened.
    at_once = {(*r[:3], r[4]) for r in want if r[3] == "firing" and r[4] == r[5]}
    want = [r for r in want if r[3] != "pending" or (*r[:3], r[4]) not in at_once]
    assert sorted(map(tuple, log.collect()), key=str) == sorted(want, key=str) and len(want) > 50


def test_alert_log_of_split_rules_equals_a_loop(spark, split_everything):
    test_alert_log_equals_a_loop(spark)


def test_alert_log_pairs_no_samples_with_versions(spark, monkeypatch):
    """Joins are by equality only: comparing times there tries every sample with every change of its metric."""
    monkeypatch.setattr(alerting.scratch, "cut", lambda df: df)
    joins = [line for line in _alert_log(spark)[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any(sign in line for line in joins for sign in ("<", ">"))

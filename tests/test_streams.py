"""Streams fed in several files, out of order and with repeats, against batch results."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_cases import looped_log, rule_history

from tidegauge import fixtures as fx
from tidegauge.operators import alerting, anomaly, fleet, forecast
from tidegauge.streaming import machines, monitors as mo, outbox
from tidegauge.streaming.inorder import SlotBuffer
from tidegauge.sources import ingest
from tidegauge.streaming.run import ROCKSDB, drain, read_batches, read_events, settings
from tidegauge.workload.alerts import rule_feed
from tidegauge.workload.storage import batches, sessions
from tidegauge.workload.streams import late_report, samples

HOUR = timedelta(hours=1)
FILES = 4


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events in four files by arrival; arrival lags event time by up to ten hours; some rows come twice."""
    folder = tmp_path_factory.mktemp("events")
    random.seed(21)
    rows = fx.table(spark, SMALL, "events").orderBy("event_id").collect()
    arrivals = sorted((r["ts"] + timedelta(hours=random.uniform(0, 10)), i) for i, r in enumerate(rows))
    size = len(arrivals) // FILES + 1
    for n in range(FILES):
        part = [rows[i] for _, i in arrivals[n * size : (n + 1) * size]]
        part += part[:10]
        frame = spark.createDataFrame(part, fx.table(spark, SMALL, "events").schema)
        frame.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


@pytest.fixture(autouse=True)
def all_parquet(monkeypatch):
    import tidegauge.workload.streams as st

    monkeypatch.setattr(st, "read_events", lambda spark, folder, *_: read_events(spark, folder, "*.parquet"))


DELAY = timedelta(hours=12)


def final_watermark(rows):
    newest = max(r["ts"] for r in rows)
    return newest.replace(microsecond=newest.microsecond // 1000 * 1000) - DELAY


def test_ingest_stores_each_sample_once(spark, shuffled):
    stored = drain(mo.deduplicated(samples(spark, shuffled), ["event_id"], DELAY).select("event_id"), "t-ingest")
    ids = sorted(r[0] for r in stored.collect())
    assert ids == list(range(1000))


def test_alerts_equal_batch(spark, shuffled):
    errors = samples(spark, shuffled).dropDuplicates(["event_id"]).filter("name = 'error'")
    log = drain(mo.alert_transitions(errors, ["node"], "event_id", 80.0, 6 * HOUR, DELAY), "t-alerts")
    batch_rows = fx.metrics(spark, SMALL).filter("name = 'error'")
    limit = final_watermark(batch_rows.select("ts").collect())
    found = alerting.alerts(batch_rows, ["node"], ["event_id"], F.col("value") > 80, F.lit(6 * HOUR)).collect()
    want = []
    for a in found:
        want += [("pending", a["active_at"]), ("firing", a["fired_at"]), ("resolved", a["resolved_at"])]
    want = sorted((t, at) for t, at in want if at is not None and at <= limit)
    got = sorted((r["transition"], r["at"]) for r in log.withColumn("at", F.col("at").cast("timestamp_ntz")).collect())
    assert got == want and len(got) > 20


def test_ewma_equals_batch(spark, shuffled):
    rows = samples(spark, shuffled).dropDuplicates(["event_id"])
    scores = drain(mo.ewma_scores(rows, fx.KEYS, "event_id", 0.2, 3.0, DELAY), "t-ewma")
    got = {r["event_id"]: (r["mean_before"], r["score"]) for r in scores.collect()}
    batch = fx.metrics(spark, SMALL)
    limit = final_watermark(batch.select("ts").collect())
    judged = anomaly.ewma_detect(anomaly.ewma_states(batch, fx.KEYS, ["ts", "event_id"])).collect()
    want = {r["event_id"]: (pytest.approx(r["mean_before"]), pytest.approx(r["score"])) for r in judged if r["ts"] <= limit}
    assert got == want and len(got) > 800


def arrivals(spark, folder, count, lag_hours=10):
    """The events in ``count`` files, delivered up to ``lag_hours`` after they happened."""
    rng = random.Random(count)
    rows = sorted(fx.table(spark, SMALL, "events").collect(), key=lambda r: r["ts"] + timedelta(hours=rng.uniform(0, lag_hours)))
    size = -(-len(rows) // count)
    for n in range(count):
        part = rows[n * size : (n + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, fx.table(spark, SMALL, "events").schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def cut_log(frame, limit, *columns):
    """Rows up to the watermark, with times as the tables have them."""
    stamps = [f.name for f in frame.schema if f.dataType.simpleString().startswith("timestamp")]
    rows = frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}).filter(F.col("at") <= F.lit(limit)).select(*columns)
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("files", [1, 3, 12])
def test_health_log_does_not_depend_on_batches(spark, tmp_path, files):
    """All outages, those before a later beat of the same batch too."""
    log = drain(mo.health(samples(spark, arrivals(spark, tmp_path, files)), "machine", 6 * HOUR, DELAY), "t-health")
    beats = fx.heartbeats(spark, SMALL)
    limit = final_watermark(beats.select("ts").collect())
    batch = fleet.transitions(beats, 6 * HOUR, fx.TIE, limit)
    got = cut_log(log.withColumnRenamed("machine", "node"), limit, "node", "status", "at", "last_seen")
    assert got == cut_log(batch, limit, "node", "status", "at", "last_seen")
    assert {r[1] for r in got} == {"healthy", "unhealthy", "offline"} and len(got) > 1000


@pytest.mark.parametrize("files", [1, 4])
def test_rules_change_inside_a_stream(spark, tmp_path, files):
    """Six operators, own holds, rules put again, switched and deleted mid-stream: the log is that of the batch."""
    rows = samples(spark, arrivals(spark, tmp_path, files))
    log = drain(mo.rule_alerts(*rule_feed(rows), ["node"], "event_id", DELAY, lanes=3), "t-rules")
    batch_rows = fx.metrics(spark, SMALL)
    limit = final_watermark(batch_rows.select("ts").collect())
    batch = alerting.alert_log(*rule_feed(batch_rows), ["node"], "event_id")
    columns = ("name", "rule", "node", "transition", "at", "active_at")
    got = cut_log(log, limit, *columns)
    assert got == cut_log(batch, limit, *columns)
    assert {r[3] for r in got} == {"pending", "firing", "resolved"} and len(got) > 100


def test_sliding_rate_equals_windows_over_growths(spark, tmp_path):
    every, span = 6 * HOUR, 24 * HOUR
    rows = samples(spark, arrivals(spark, tmp_path, 4)).drop("value").withColumnRenamed("k", "value")
    rates = drain(mo.sliding_rate(rows, fx.KEYS, "event_id", span, every, DELAY), "t-sliding")
    counters = fx.counts_k(spark, SMALL).withColumnRenamed("k", "value").collect()
    limit = final_watermark(counters)
    last, want = {}, {}
    for r in sorted(counters, key=lambda r: (r["ts"], r["event_id"])):
        key, before = (r["name"], r["node"]), last.get((r["name"], r["node"]))
        last[key] = r["value"]
        if before is None:
            continue
        grown = r["value"] if r["value"] < before else r["value"] - before
        start = datetime(2024, 1, 1) + (r["ts"] - datetime(2024, 1, 1)) // every * every
        for n in range(1, 5):
            want[(*key, start + n * every)] = want.get((*key, start + n * every), 0) + grown
    got = {(r["name"], r["node"], r["window_end"]): r["rate"] for r in rates.withColumn("window_end", F.col("window_end").cast("timestamp_ntz")).collect()}
    assert got == {k: pytest.approx(v / 86400) for k, v in want.items() if k[2] <= limit} and len(got) > 1000


def test_outbox_of_a_killed_stream_is_that_of_the_batch(spark, tmp_path):
    """The stream dies in the middle of a batch, after its messages are written, and is started again."""
    folder = arrivals(spark, tmp_path / "in", 6)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    beats = fx.heartbeats(spark, SMALL)
    limit = final_watermark(beats.select("ts").collect())

    def start():
        notices = samples(spark, folder).withColumn("node", F.col("machine"))
        sent = outbox.cooled_down(notices, ["node"], "event_id", 18 * HOUR, DELAY)
        return outbox.deliver(sent, path, state, ["node"], ["slack", "email"])

    class Died(Exception):
        pass

    write = outbox.deliver.__globals__["micros"]
    calls = []

    def failing(column):
        calls.append(1)
        if len(calls) == 4:
            raise Died
        return write(column)

    outbox.deliver.__globals__["micros"] = failing
    try:
        with pytest.raises(Exception):
            start().awaitTermination()
    finally:
        outbox.deliver.__globals__["micros"] = write
    start().awaitTermination()
    got = sorted((r["node"], r["channel"], r["sent_at"]) for r in spark.read.parquet(path).withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz")).collect())
    want, last = [], {}
    for r in sorted(beats.collect(), key=lambda r: (r["ts"], r["event_id"])):
        if r["ts"] <= limit and (r["node"] not in last or r["ts"] - last[r["node"]] >= 18 * HOUR):
            last[r["node"]] = r["ts"]
            want += [(r["node"], c, r["ts"]) for c in ("slack", "email")]
    assert got == sorted(want) and len(got) > 200
    ids = [r[0] for r in spark.read.parquet(path).select("message_id").collect()]
    assert len(set(ids)) == len(ids)


def test_every_refit_is_a_batch_fit_of_its_window(spark, tmp_path):
    """Past 40 points the window is full and every point fits again."""
    rows = samples(spark, arrivals(spark, tmp_path, 3))
    models = drain(mo.refits(rows, ["name"], "event_id", DELAY, every=10, kept=40), "t-refit").collect()
    points = sorted(fx.metrics(spark, SMALL).select("name", "ts", "event_id", "value").collect(), key=lambda r: (r["ts"], r["event_id"]))
    limit = final_watermark(points)
    windows, at = {}, {}
    for r in points:
        held = windows.setdefault(r["name"], [])
        held.append(r)
        del held[:-40]
        if r["ts"] <= limit and len(held) % 10 == 0:
            at[(r["name"], r["ts"])] = list(held)
    got = {(r["name"], r["at"].replace(tzinfo=None)): r for r in models}
    assert got.keys() == at.keys() and len(got) > 500
    chosen = random.Random(3).sample(sorted(at), 25)
    batch = [(f"{n}|{t}", p["ts"], p["event_id"], p["value"]) for n, t in chosen for p in at[(n, t)]]
    fits = forecast.fit(spark.createDataFrame(batch, "series string, ts timestamp_ntz, id long, value double"), ["series"], ["ts", "id"])
    for fit in fits.collect():
        name, _, stamp = fit["series"].partition("|")
        model = got[(name, datetime.fromisoformat(stamp))]
        assert model["n"] == fit["n"] and model["season"] == pytest.approx(fit["season"])
        assert (model["slope"], model["intercept"], model["variance"]) == pytest.approx((fit["slope"], fit["intercept"], fit["variance"]))


class Counted(dict):
    """A map state that counts what is read."""

    reads = 0

    def getValue(self, key):
        Counted.reads += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


def test_a_timer_reads_its_own_slot_only():
    """Reads of a timer are the same whether one row or a thousand slots wait behind it."""
    reads = []
    for waiting in (0, 10, 1000):
        buffer = SlotBuffer(Counted(), Counted(), 1000, ["us", "tie"])
        rows = pd.DataFrame({"us": [1500, 1200, 1700], "tie": [1, 2, 3], "value": [1.0, 2.0, 3.0]})
        assert buffer.add(rows) == [1200]
        if waiting:
            buffer.add(pd.DataFrame({"us": 5000 + 1000 * np.arange(waiting), "tie": 0, "value": 0.0}))
        buffer.add(pd.DataFrame({"us": [1500], "tie": [0], "value": [4.0]}))
        Counted.reads = 0
        due, following = buffer.due(1200, 1600)
        assert due["value"].tolist() == [2.0, 4.0, 1.0] and following == 1700
        reads.append(Counted.reads)
        due, following = buffer.due(1700, 9999)
        assert due["value"].tolist() == [3.0] and following is None
        assert buffer.due(1700, 9999) == (None, None)
    assert len(set(reads)) == 1


def test_transitions_equal_a_loop():
    rng = np.random.default_rng(4)
    for hold in (0, 7, 30):
        for _ in range(60):
            n, k = int(rng.integers(1, 40)), 4
            series = np.sort(rng.integers(0, k, n))
            us = np.sort(rng.integers(50, 150, n))
            breach = rng.random(n) < 0.7
            active = np.where(rng.random(k) < 0.5, rng.integers(0, 50, k), -1)
            fired = (active >= 0) & (rng.random(k) < 0.5)
            us = np.concatenate([np.sort(us[series == s]) for s in range(k)])
            want, now, told = [], active.copy(), fired.copy()
            for i in range(n):
                s = series[i]
                if breach[i]:
                    if now[s] < 0:
                        now[s], told[s] = us[i], False
                        want += [(i, "pending", us[i])] * (hold > 0)
                    if not told[s] and us[i] - now[s] >= hold:
                        told[s] = True
                        want.append((i, "firing", now[s]))
                elif now[s] >= 0:
                    want.append((i, "resolved", now[s]))
                    now[s], told[s] = -1, False
            at, names, starts, open_since, announced = machines.transitions(series, us, breach, active, fired, hold)
            assert list(zip(at.tolist(), names.tolist(), starts.tolist())) == want
            assert open_since.tolist() == now.tolist() and announced.tolist() == told.tolist()


def test_late_rows_are_counted(spark, tmp_path):
    """An early slice of the events is delivered after everything else."""
    events = fx.table(spark, SMALL, "events")
    rows = events.orderBy("event_id").collect()
    for part in (rows[50:400], rows[400:700], rows[700:], rows[:50]):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    rows = samples(spark, str(tmp_path))
    assert late_report(rows, HOUR).first() == (50, 1000)
    assert late_report(rows, timedelta(days=40)).first() == (0, 1000)


def test_json_batches_become_stored_samples(spark, tmp_path):
    """Batches as JSON lines, through session check, unpacking and labels, without repeats."""
    arrived = batches(spark, SMALL)
    text = arrived.select(F.to_json(F.struct("node_id", "session_id", "batch_seq", "sent_at", "metrics")).alias("line"))
    for _ in range(2):
        text.coalesce(1).write.mode("append").text(str(tmp_path))
    ready = ingest.store_ready(read_batches(spark, str(tmp_path)), sessions(spark, SMALL), "system")
    stored = drain(mo.deduplicated(ready, ["name", "ts_ns", "unit"], timedelta(days=40)), "t-batches", ("name",))
    events = fx.table(spark, SMALL, "events").filter("user_id % 3 <> 0")
    want = events.select(F.col("event_id").cast("string"), F.concat(F.lit("node-"), F.col("user_id") % 10), "value")
    got = stored.select("unit", F.col("labels")["node"], "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r[0] for r in stored.select(F.col("labels")["collector"]).distinct().collect()} == {"system"}


def test_health_wakes_after_every_long_silence():
    """Also after a beat whose successor in the same slot comes late: the watermark may end between them."""
    hour = 3_600_000_000
    wakes = set(machines.Health("node", hour, 3).wakes(pd.DataFrame({"us": [5 * hour, 0, 5 * hour - 10, hour // 2]})))
    assert wakes == {at + n * hour + 1 for at in (hour // 2, 5 * hour) for n in (1, 3)}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def beats_of(nodes, beats, gap):
    """Beats of every node at its own millisecond."""
    start = datetime(2024, 1, 1)
    return [(b * nodes + n, start + b * gap + timedelta(milliseconds=7 * n), n, "view", 1.0, "{}") for b in range(beats) for n in range(nodes)]


def test_health_timers_do_not_grow_with_nodes(spark, tmp_path):
    """Nodes of a lane share their state and their timers, whenever their beats and silences end."""
    timers = []
    for nodes in (30, 300):
        folder, name = tmp_path / f"in-{nodes}", f"t_health_{nodes}"
        spark.createDataFrame(beats_of(nodes, 6, 20 * HOUR), EVENTS).coalesce(1).write.parquet(str(folder))
        log = mo.health(samples(spark, str(folder)), "machine", 6 * HOUR, HOUR)
        with settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
            query = log.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            query.awaitTermination()
        # The last round of beats lies past the watermark.
        found = {r["status"]: r["count"] for r in spark.table(name).groupBy("status").count().collect()}
        assert found == {"healthy": 5 * nodes, "unhealthy": 5 * nodes, "offline": 5 * nodes}
        timers.append(sum(op.customMetrics["numRegisteredTimers"] for p in query.recentProgress for op in p.stateOperators) / nodes)
    assert 0 < timers[1] < 0.5 * timers[0]


@pytest.mark.parametrize("files", [1, 7])
def test_health_of_lanes_equals_batch(spark, tmp_path, files):
    """Nodes without a name, repeated beats, one node with most of the beats."""
    rng = random.Random(12)
    start = datetime(2024, 1, 1)
    users = [None, 1, 2, 3, 4] + [5] * 10 + list(range(6, 30))
    rows = [(i, start + timedelta(minutes=rng.randrange(0, 6000)), rng.choice(users), "view", 1.0, "{}") for i in range(900)]
    rows += rows[:40]
    size = -(-len(rows) // files)
    rows.sort(key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 10)))
    for n in range(files):
        spark.createDataFrame(rows[n * size : (n + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = drain(mo.health(samples(spark, str(tmp_path / "in")), "machine", 6 * HOUR, DELAY, lanes=3), "t-lanes")
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "all" / "events.parquet"))
    beats = fx.heartbeats(spark, str(tmp_path / "all"))
    limit = final_watermark(beats.select("ts").collect())
    got = cut_log(log.withColumnRenamed("machine", "node"), limit, "node", "status", "at", "last_seen")
    assert got == cut_log(fleet.transitions(beats, 6 * HOUR, fx.TIE, limit), limit, "node", "status", "at", "last_seen")
    assert {r[0] for r in got} >= {None, "node-5"} and {r[1] for r in got} == {"healthy", "unhealthy", "offline"}


class Kept(dict):
    """A map state that counts how often it is asked or told."""

    calls = 0

    def getValue(self, key):
        Kept.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Kept.calls += 1
        self[key] = value

    def containsKey(self, key):
        Kept.calls += 1
        return key in self

    def removeKey(self, key):
        Kept.calls += 1
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


def ruled(samples, changes, pieces):
    """The log of a rule machine that gets the rows in ``pieces`` parts, and the calls of its state."""
    columns = machines.RuleTable.COLUMNS
    us = lambda at: int((at - datetime(2024, 1, 1)) / timedelta(microseconds=1))
    rows = [(us(s[2]), 1, s[3], str(s[1]), s[4], None, None, None, None, None) for s in samples if s[2] is not None]
    rows += [(us(c[2]), 0, c[3], None, None, c[1], c[4], c[5], c[6], c[7]) for c in changes]
    rows = pd.DataFrame(sorted(rows, key=lambda r: r[:3]), columns=columns)
    machine = machines.RuleTable(["name", "lane"])
    machine._rules, machine._alerts = Kept(), Kept()
    Kept.calls = 0
    cuts = np.quantile(rows["us"], np.linspace(0, 1, pieces + 1)[1:])
    parts = [part.reset_index(drop=True) for _, part in rows.groupby(np.searchsorted(cuts, rows["us"]))]
    found = [log for log in (machine.advance(part, None) for part in parts) if log is not None]
    return pd.concat(found), Kept.calls


@pytest.mark.parametrize("pieces", [1, 2, 9])
def test_rule_machine_equals_a_loop(pieces):
    """Alerts and rules that outlast a part, rules changed at the time of a sample, series and values that are missing."""
    samples, changes = rule_history()
    start = datetime(2024, 1, 1)
    for metric in "ab":
        some, ruling = [s for s in samples if s[0] == metric], [c for c in changes if c[0] == metric]
        log, _ = ruled(some, ruling, pieces)
        times = lambda us: start + timedelta(microseconds=int(us))
        got = [(metric, r.rule, r.series, r.transition, times(r.at_us), times(r.active_us)) for r in log.itertuples()]
        want = [(*r[:2], str(r[2]), *r[3:]) for r in looped_log(some, ruling)]
        assert sorted(got) == sorted(want) and len(want) > 50


def test_rule_machine_keeps_state_once_for_many_changes():
    """However often a rule changes among the rows that are due, its state is read and written once."""
    start, calls = datetime(2024, 1, 1), []
    for count in (10, 1000):
        step = timedelta(hours=1) / count
        samples = [("a", "x", start + i * step, i, float(i % 10)) for i in range(count)]
        ops = ["put", "disable", "enable", "delete"]
        changes = [("a", "r", start + i * step, 5000 + i, ops[i % 4], ">", 5.0, 0) for i in range(count - 1)] + [("a", "r", start + timedelta(hours=1), 9000, "put", "<", 50.0, 0)]
        samples.append(("a", "x", start + timedelta(hours=1), count, 1.0))
        calls.append(ruled(samples, changes, 1)[1])
    assert calls[0] == calls[1]

"""What executors hold beside the heap: Arrow batches on the way to Python, and Python workers."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import bloomlm, lookups, neardup
from tidegauge.plans import scratch

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_python(df):
    return "MapInArrow" in df._jdf.queryExecution().analyzed().toString()


def test_cut_bounds_batches_and_leaves_the_session(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    before = spark.conf.get(BATCH)
    stored = scratch.cut(rows.mapInArrow(sizes, "n bigint, size bigint"), 1 << 20).collect()
    assert sum(r.n for r in stored) == 3000 and max(r.size for r in stored) < 1.2 * (1 << 20)
    assert spark.conf.get(BATCH) == before


@pytest.mark.parametrize("limit", [None, "5m"])
def test_batches_restores_after_an_error(spark, limit):
    before = spark.conf.get(BATCH)
    try:
        if limit:
            spark.conf.set(BATCH, limit)
        held = spark.conf.get(BATCH)
        with pytest.raises(ZeroDivisionError), scratch.batches(spark, 1 << 20):
            assert spark.conf.get(BATCH) == str(1 << 20)
            raise ZeroDivisionError
        assert spark.conf.get(BATCH) == held
    finally:
        spark.conf.set(BATCH, before)


def test_near_dedup_runs_python_with_bounded_batches(spark, monkeypatch):
    """Documents that share a passage only, so that all steps run."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [(i, t) for i, t in enumerate([*texts, *(t + " end" for t in texts)])]
    cut, seen = scratch.cut, []

    def spied(df, batch_bytes=None):
        if in_python(df):
            seen.append(batch_bytes)
        return cut(df, batch_bytes)

    monkeypatch.setattr(neardup.scratch, "cut", spied)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert not in_python(found)
    assert {r.doc_id: r.component for r in found.collect()} == {i: i % 6 for i in range(12)}
    assert len(seen) >= 2 and set(seen) == {scratch.BATCH_BYTES}


def test_pipeline_stages_bound_batches(spark):
    documents = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "64m")
        corpus_pipeline.STAGES[0][1](spark, documents, "")
        assert spark.conf.get(BATCH) == str(scratch.BATCH_BYTES)
    finally:
        spark.conf.set(BATCH, before)


@pytest.mark.parametrize("key", ["id", "concat('k', id)", "encode(concat('k', id), 'utf-8')", "date_add(DATE'2024-01-01', int(id))", "timestamp_seconds(id)"])
def test_heavy_keys_need_no_python_workers(spark, key):
    rows = spark.range(400).selectExpr("IF(id % 2 = 0, 0, id) AS id").selectExpr(f"{key} AS k")
    heavy = lookups.heavy_keys(rows, "k", 20)
    assert heavy.dtypes == rows.dtypes
    assert heavy.collect() == rows.groupBy("k").count().where("count > 100").select("k").collect()
    assert "RDD" not in heavy._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [bloomlm.MODEL_BYTES, 200])
def test_language_model_bounds_batches_and_returns_its_broadcasts(spark, monkeypatch, limit):
    texts = spark.createDataFrame([(i, f"a b c{i} d e") for i in range(20)], "doc_id bigint, text string").repartition(4)
    cut, gone, shared = scratch.cut, Broadcast.destroy, bloomlm._shared
    stored, made, destroyed = [], [], []

    def spied(df, batch_bytes=None):
        stored.append(batch_bytes)
        return cut(df, batch_bytes)

    def sharing(*args):
        out = shared(*args)
        made.extend(out[c] for c in ("vocabulary", "counts", "filter"))
        return out

    monkeypatch.setattr(bloomlm.scratch, "cut", spied)
    monkeypatch.setattr(bloomlm, "_shared", sharing)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *args: (destroyed.append(self), gone(self, *args)))
    found = bloomlm.scored(texts, bloomlm.train(texts), limit=limit)
    assert stored and set(stored) == {scratch.BATCH_BYTES}
    assert made and list(map(id, made)) == list(map(id, destroyed))
    assert (len(made) > 3) == (limit == 200)
    assert [tuple(r) for r in found.select("doc_id", "n_tokens", "n_known").orderBy("doc_id").collect()] == [(i, 6, 6) for i in range(20)]


@pytest.mark.parametrize("parts", [2, 64, 1024])
def test_language_model_counts_are_handed_out_in_small_batches(monkeypatch, parts):
    """A task's gathered pairs are added up range by range: no batch holds more than a share of them."""

    class Texts:
        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(bloomlm, "GATHERED", 60_000)
    shift = 64 - (parts - 1).bit_length()
    texts = pa.array([" ".join(f"w{(i * 31 + j * j) % 5003}" for j in range(400)) for i in range(400)] + [None, ""])
    batches = [pa.RecordBatch.from_arrays([texts[a : a + 50]], ["text"]) for a in range(0, len(texts), 50)]
    out = list(bloomlm._counted(Texts(), shift)(iter(batches)))

    found = {1: Counter(), 2: Counter()}
    for row in (r for b in out for r in b.to_pylist()):
        keys = bloomlm._short(row["keys"]) if row["kind"] == 2 and shift >= 48 else np.frombuffer(row["keys"], np.uint64)
        if row["kind"] == 1 or shift < 48:
            assert set((keys >> np.uint64(shift)).tolist()) == {row["part"]}
        for k, n in zip(keys.tolist(), np.frombuffer(row["counts"], "<u4").tolist()):
            found[row["kind"]][k] += n
    tokens = bloomlm.Tokens(texts)
    pairs = tokens.pairs & np.uint64(2**48 - 1) if shift >= 48 else tokens.pairs
    assert found[2] == Counter(pairs.tolist())
    assert found[1] == Counter(tokens.distinct[tokens.codes].tolist()) + Counter({int(bloomlm._BEGIN): len(texts)})
    sizes = [sum(len(r) for r in b.column("counts").to_pylist()) // 4 for b in out]
    assert max(sizes) < (0.55 if parts == 2 else 0.1) * (bloomlm.GATHERED + 20_050)

"""Registered queries against SQL, and the pipeline against its stages in plain Python."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
from comparison import oracle_connection, oracle_rows, spark_rows
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from tidegauge.llm import queries as llm

from helpers_llm import SMALL


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("key", sorted(llm.ORACLES))
def test_query_agrees_with_sql(spark, connection, key):
    df = llm.QUERIES[key](spark, SMALL)
    names, want = oracle_rows(connection, llm.ORACLES[key])
    assert sorted(df.columns) == names
    assert spark_rows(df) == want


def test_all_are_registered():
    assert {int(k[2:].split("_")[0]) for k in entry_points.queries() if re.match(r"op\d+_", k)} == set(range(1, 14))
    assert "pipeline" in entry_points.queries()


def test_pipeline_agrees_with_plain_python(spark):
    """Every stage again on the driver: SQL for rules and groups, literal search, the library's own tokens."""
    rows = {r.doc_id: r.text for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids").withColumnRenamed("ids", "text").collect()}
    connection = oracle_connection(SMALL)
    good = {r[0] for r in connection.execute(f"SELECT doc_id FROM ({llm.ORACLES['op6_quality_rules']}) WHERE kept").fetchall()}
    connection.execute("CREATE TABLE kept_documents AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", [sorted(good)])
    connection.execute("DROP VIEW documents")
    connection.execute("CREATE VIEW documents AS SELECT * FROM kept_documents")
    first = {r[0] for r in connection.execute(f"SELECT doc_id FROM ({llm.ORACLES['op8_minhash_near_dedup']}) WHERE kept").fetchall()}
    dirty = {r[0] for r in connection.execute(f"SELECT doc_id FROM ({llm.ORACLES['op1_benchmark_decontamination']}) WHERE contaminated").fetchall()}
    assert set(rows) == first - dirty
    texts = dict(connection.execute("SELECT doc_id, text FROM documents").fetchall())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc in rows:
        shown = library.decode(rows[doc], skip_special_tokens=False)
        assert not re.search("[0-9a-f]{24,}", shown)
        if "[SECRET]" not in shown:
            assert shown == texts[doc]
            assert rows[doc] == library.encode(texts[doc], add_special_tokens=False).ids
        else:
            pieces = shown.split("[SECRET]")
            assert texts[doc].startswith(pieces[0]) and texts[doc].endswith(pieces[-1])

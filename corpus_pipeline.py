"""A training corpus in five stages, each one of the library's operators applied to all that the stage before kept.

quality: documents that the current rule policy rejects go.  near_dedup: of
each group of near duplicates the document with the smallest id stays.
decontaminate: documents that hold a benchmark window go.  secrets: secrets in
the text are masked.  tokens: every text as token ids and back.

A stage's rows may be made after it has returned, so a stage leaves the session
with small Arrow batches; ``run`` puts the session back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import bpe, decontaminate, neardup, rules, secretscan
from tidegauge.plans import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redacted(docs, length="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of the text decoded from them."""
    return bpe.encoded(docs, BYTE_BPE)


def _bounded(stage: Stage) -> Stage:
    """The stage, with Arrow batches bounded: an executor holds several for each task, beside a heap that the first stage fills."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality", _bounded(quality)),
    ("near_dedup", _bounded(near_dedup)),
    ("decontaminate", _bounded(decontamination)),
    ("secrets", _bounded(secrets)),
    ("tokens", _bounded(tokens)),
]

#: Byte-pair encoding and learnt formats cannot be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.batches(spark):
        for _, stage in STAGES:
            docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs

"""Where intermediate tables live.

Executors come and go, so nothing intermediate may sit on one machine: the
folder is the one the session names in ``spark.checkpoint.dir``.  A temporary
folder is used only when that setting is absent and everything runs in one
process, as in tests; on a cluster the missing setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Enough rows to work on at a time; Spark's own limit of 64 MB is held several times by a task and its Python worker.
BATCH_BYTES = 4 << 20


def root(spark: SparkSession) -> str:
    folder = spark.conf.get(_CONF, None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{_CONF} must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tidegauge-")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{root(spark)}/{purpose}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """From now on the session's jobs give Python its rows in Arrow batches of about ``limit`` bytes (or one row)."""
    spark.conf.set(_BATCH, str(limit))


@contextmanager
def batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """``bound_batches`` for the jobs that start within; afterwards the session is as before."""
    before = spark.conf.get(_BATCH, None)
    bound_batches(spark, limit)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def cut(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Store the rows as a table in the shared folder and go on from there.

    Later jobs read the stored rows, pruned to the columns they need, and
    nothing before them is computed again, whatever executors are lost.
    ``batch_bytes`` bounds the Arrow batches of the Python steps before the cut.
    """
    path = new_folder(df.sparkSession, "cut")
    with batches(df.sparkSession, batch_bytes) if batch_bytes else nullcontext():
        df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

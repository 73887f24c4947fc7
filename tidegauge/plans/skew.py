"""Finding the few keys that hold too many rows for one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_CONF = "spark.tidegauge.rowsPerTask"
DEFAULT_ROWS = 2_000_000
# A stored row rarely takes less than this many bytes, and few operators turn
# one input row into more than FAN_OUT rows, so inputs smaller than
# rows * BYTES_PER_ROW / FAN_OUT are not worth a counting job.  This decides
# only whether to look for hot keys; results do not depend on it.
BYTES_PER_ROW = 16
FAN_OUT = 4


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_CONF, str(DEFAULT_ROWS)))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the tables the plan reads (no job is run)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on every key."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


@dataclass(frozen=True)
class Hot:
    """Hot keys with their row counts (column ``_n``), all their rows, and the rows one task should take."""

    table: DataFrame
    rows: int
    per_task: int

    @property
    def pieces(self) -> int:
        return max(2, -(-self.rows // self.per_task))


def hot_keys(df: DataFrame, keys: list[str]) -> Hot | None:
    """Keys with more rows than one task should take, if there are any.

    A task should take the configured number of rows, or an average shuffle
    partition if that is more, so there are never more hot keys (nor pieces of
    them) than shuffle partitions: the list is small by construction.  The
    counting job ships one partial count per key and map task, never the rows.
    """
    spark = df.sparkSession
    limit = rows_per_task(spark)
    if input_bytes(df) <= limit * BYTES_PER_ROW // FAN_OUT:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n").alias("top"), F.sum("_n").alias("total")).first()
    if top["top"] is None or top["top"] <= limit:
        return None
    per_task = max(limit, top["total"] // int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = counts.filter(F.col("_n") > per_task).collect()
    if not hot:
        return None
    return Hot(spark.createDataFrame(hot, counts.schema), sum(r["_n"] for r in hot), per_task)

"""Tables built from specs held by the driver (rules, channels, texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Such tables hold a few columns of short text; this many rows are some MB.
_BROADCAST_ROWS = 20_000
# More rows than this are better shipped as data than as literals in the plan.
_LITERAL_ROWS = 500


def spec_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The rows as a table, marked for broadcast while the list is short.

    Short lists become literals, whose size Catalyst knows.
    """
    if not rows or len(rows) > _LITERAL_ROWS:
        table = spark.createDataFrame(rows, schema)
        return F.broadcast(table) if len(rows) <= _BROADCAST_ROWS else table
    fields = StructType.fromDDL(schema).fields
    literals = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*literals))))

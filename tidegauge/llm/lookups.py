"""Joins to a table of one row per key that stay even when a third of the rows share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more rows than this, and more than an average shuffle partition holds, is heavy.
HEAVY_ROWS = 1000


def free_name(name: str, taken: list[str]) -> str:
    """The name, with more underscores in front if a column has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def heavy_keys(rows: DataFrame, key: str, least: int = HEAVY_ROWS) -> DataFrame | None:
    """The keys that hold more than an average shuffle partition of the rows, a broadcast column ``key``; None if there are none.

    There are fewer of them than shuffle partitions, whatever the rows.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    spark = rows.sparkSession
    top = counts.agg(F.max("_n").alias("top"), F.sum("_n").alias("total")).first()
    limit = max(least, (top["total"] or 0) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    if (top["top"] or 0) <= limit:
        return None
    # As an Arrow table: Python rows would be unpacked by workers of another daemon on every executor.
    found = counts.where(F.col("_n") > limit).select(key)
    return F.broadcast(spark.createDataFrame(found.toArrow(), found.schema))


def looked_up(rows: DataFrame, key: str, table: DataFrame, how: str = "inner", least: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, which is unique in ``table``; ``how`` is inner or left.

    Rows of heavy keys stay where they are and meet a broadcast of those keys'
    rows of the table; with ``left``, so do rows without a key, which match nothing.
    """
    heavy = heavy_keys(rows, key, least)
    keyed = rows.where(F.col(key).isNotNull())
    if heavy is None:
        out = keyed.join(table, key, how)
    else:
        few = F.broadcast(table.join(heavy, key, "left_semi"))
        out = keyed.join(heavy, key, "left_anti").join(table, key, how)
        out = out.unionByName(keyed.join(heavy, key, "left_semi").join(few, key, how).select(*out.columns))
    if how == "left":
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != key]
        out = out.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, *rest))
    return out

"""Fleet report: latest metrics per node in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Size units (1024 apart) and disk bands.
UNITS = ("Bytes", "KB", "MB", "GB", "TB")
DISK_BANDS = ((90, "red"), (80, "yellow"))


def latest_by_name(samples: DataFrame, node: str, names: dict[str, str], tie: list[str]) -> DataFrame:
    """One row per node with the latest value of each named metric, from one aggregation."""
    at = F.struct("ts", *tie)
    picks = [
        F.max_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, at)).alias(column)
        for column, name in names.items()
    ]
    return samples.groupBy(node).agg(F.max("ts").alias("last_seen"), *picks)


def uptime_text(seconds: Column) -> Column:
    """``Xd Yh Zm``, or N/A without a value."""
    days = F.floor(seconds / 86400)
    hours = F.floor(F.pmod(seconds, F.lit(86400)) / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    text = F.concat(days, F.lit("d "), hours, F.lit("h "), minutes, F.lit("m"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "N/A").otherwise(text)


def bytes_text(size: Column) -> Column:
    """Largest 1024 unit that keeps the number at least one, at most two decimals, or N/A without a value."""
    steps = [F.when(size >= 1024.0**i, F.struct((size / 1024.0**i).alias("n"), F.lit(u).alias("u"))) for i, u in enumerate(UNITS)]
    scaled = F.coalesce(*reversed(steps), F.struct(size.alias("n"), F.lit(UNITS[0]).alias("u")))
    rounded = F.format_string("%.2f", F.floor(scaled["n"] * 100 + 0.5) / 100)
    text = F.concat(F.regexp_replace(rounded, r"\.?0+$", ""), F.lit(" "), scaled["u"])
    return F.when(F.coalesce(size, F.lit(0.0)) == 0, "N/A").otherwise(text)


def band(percent: Column) -> Column:
    limits = [F.when(percent >= limit, colour) for limit, colour in DISK_BANDS]
    return F.when(percent.isNotNull(), F.coalesce(*limits, F.lit("green")))

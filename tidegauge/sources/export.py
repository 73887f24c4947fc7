"""Writing samples out: archive, interchange files, text exposition."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

from tidegauge.operators.select import in_range
from tidegauge.sources.tables import drop_days, load, store

# Text formats would cut times to milliseconds.
_TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
FORMATS = ("parquet", "json", "csv", "orc")


def archive(samples: DataFrame, start, end, path: str, codec: str = "zstd") -> DataFrame:
    """Store a time range (start inclusive, end exclusive) in a table of its own, and read it back."""
    store(in_range(samples, start, end, open_end=True), path, codec)
    return load(samples.sparkSession, path).select(*samples.columns)


def _rows_by_folder(samples: DataFrame) -> list[tuple]:
    """(name, date, rows) of a stored table; the counts come from file footers."""
    return sorted(map(tuple, samples.groupBy("name", "date").agg(F.count(F.lit(1)).alias("n")).collect()))


def move_to_archive(spark: SparkSession, table: str, start: date, end: date, path: str, codec: str = "zstd") -> DataFrame:
    """Move whole days (start inclusive, end exclusive) of a stored table into an archive table.

    The archive is read again and its rows per metric and day are held against
    those of the source; only then do the days leave the hot table.  One row:
    the number of rows that moved.
    """
    days = (F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end))
    chosen = load(spark, table).filter(days)
    expected = _rows_by_folder(chosen)
    if expected:
        store(chosen.drop("date"), path, codec)
        if _rows_by_folder(load(spark, path)) != expected:
            raise ValueError(f"the archive {path} does not hold what {table} has; nothing was removed")
        drop_days(spark, table, start, end)
    return spark.range(1).select(F.lit(sum(n for *_, n in expected)).cast("bigint").alias("moved"))


def export(samples: DataFrame, path: str, form: str) -> DataFrame:
    """Write in one of ``FORMATS`` and read the copy back with the same schema.

    CSV has no maps; there they are JSON texts.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    options = _TEXT_TIMES if form in ("csv", "json") else {}
    options = {**options, "header": True, "escape": '"'} if form == "csv" else options
    maps = {f.name: f.dataType for f in samples.schema if isinstance(f.dataType, MapType)} if form == "csv" else {}
    flat = samples.withColumns({name: F.to_json(name) for name in maps})
    flat.write.mode("error").options(**options).format(form).save(path)
    copy = samples.sparkSession.read.schema(flat.schema).options(**options).format(form).load(path)
    return copy.withColumns({name: F.from_json(name, kind) for name, kind in maps.items()})


def exposition(samples: DataFrame, label_names: list[str], value: Column, millis: Column) -> DataFrame:
    """``name{k="v",…} value millis`` text lines, labels in key order."""
    pairs = [F.concat(F.lit(f'{n}="'), _escaped(F.col(n)), F.lit('"')) for n in sorted(label_names)]
    inside = F.concat_ws(",", *pairs)
    line = F.concat(F.col("name"), F.lit("{"), inside, F.lit("} "), value.cast("string"), F.lit(" "), millis.cast("string"))
    return samples.select(line.alias("line"))


# Characters a label value escapes in the text format.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"))


def _escaped(value: Column) -> Column:
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), _ESCAPES, value)

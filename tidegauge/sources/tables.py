"""The sample table: Parquet by metric name and day.

Name and time range are what every query gives, so they are the folders;
``node`` and ``collector`` are plain columns because filters on map entries do
not reach the scan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions.timing import utc_date


def store(samples: DataFrame, path: str, codec: str = "zstd", mode: str = "error") -> None:
    """Write samples into folders by name and day.

    Rows are range-partitioned by folder and a row hash: few files per folder,
    and a metric or day with most of the rows is spread over as many tasks as
    its share asks for.
    """
    plain = [c for c, kind in samples.dtypes if not kind.startswith("map")]
    dated = samples.withColumn("date", utc_date(F.col("ts"), dict(samples.dtypes)["ts"]))
    spread = dated.repartitionByRange("name", "date", F.xxhash64(*plain))
    spread.write.mode(mode).partitionBy("name", "date").option("compression", codec).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored samples; ``date`` stays as a column so that time ranges prune folders."""
    stored = spark.read.parquet(path)
    return stored.withColumn("name", F.col("name").cast("string"))


def drop_days(spark: SparkSession, path: str, start: date | None, end: date) -> None:
    """Remove the folders of whole days (start inclusive, end exclusive) of a stored table.

    The driver lists folders, never rows, and asks the file system that holds
    the table, so the path may be any that Spark can write.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in files.listStatus(root):
        if not name.isDirectory():
            continue
        for day in files.listStatus(name.getPath()):
            kind, _, value = day.getPath().getName().partition("=")
            if kind == "date" and value < end.isoformat() and (start is None or value >= start.isoformat()):
                files.delete(day.getPath(), True)


def delete_expired(spark: SparkSession, path: str, before: date) -> DataFrame:
    """Remove all days before ``before`` from a stored table; one row with the number of samples that went."""
    gone = load(spark, path).filter(F.col("date") < F.lit(before)).count()
    if gone:
        drop_days(spark, path, None, before)
    return spark.range(1).select(F.lit(gone).cast("bigint").alias("removed"))

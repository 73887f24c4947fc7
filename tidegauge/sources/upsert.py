"""Writing rows into a stored table where they replace those of the same key.

A table lies in folders by some columns that its key determines.  Only folders
that new rows fall into are read, merged and written again; the others are not
touched.  The merged folders are staged first, whole, and then swapped in, so a
run that dies in between is finished by running it again with the same staging
folder: nothing that a swap needs is read from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.sources.ingest import last_write

FOLDERS = ["name", "date"]


def bucket(key: Column, count: int) -> Column:
    """A folder number for tables whose key has no natural folders."""
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def upsert(rows: DataFrame, path: str, key: list[str], arrival: list[str], staging: str, folders: list[str] = FOLDERS, codec: str = "zstd") -> None:
    """Merge ``rows`` into the table at ``path``; of equal keys the last arrival stays.

    ``rows`` have the table's columns, ``arrival`` among them, and ``folders``
    are functions of the key.  The table is made if it is not there.  Doing it
    twice, or in pieces, is the same as doing it once.
    """
    spark = rows.sparkSession
    if not exists(spark, f"{staging}/_SUCCESS"):
        _stage(rows, path, key, arrival, staging, folders, codec)
    merged = spark.read.schema(rows.schema).parquet(staging)
    # Only the folders in the staged rows are replaced.
    _spread(merged, folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(*folders).parquet(path)


def _stage(rows: DataFrame, path: str, key: list[str], arrival: list[str], staging: str, folders: list[str], codec: str) -> None:
    spark = rows.sparkSession
    both = rows
    if exists(spark, path):
        stored = spark.read.schema(rows.schema).parquet(path)
        # One row per folder; the join leaves folders that no row falls into unread.
        touched = rows.select(*folders).distinct()
        both = stored.join(touched, folders, "left_semi").select(*rows.columns).unionByName(rows)
    merged = last_write(both, key, arrival).select(*rows.columns)
    merged.write.mode("overwrite").option("compression", codec).parquet(staging)


def _spread(rows: DataFrame, folders: list[str]) -> DataFrame:
    """Few files a folder, and many tasks for a folder with most of the rows."""
    plain = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    return rows.repartitionByRange(*folders, F.xxhash64(*plain))

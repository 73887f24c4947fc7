"""Reading event files as a stream and running a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Condition

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidegauge import schema
from tidegauge.plans import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _state_settings() -> dict[str, str]:
    """State in RocksDB; its number of partitions is the session's, and the checkpoint keeps it."""
    return {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}


class ProgressTotals(StreamingQueryListener):
    """Late and seen rows of the streams that run inside the block, added up as each batch reports them.

    Spark keeps only the most recent reports of a query; the sums here are of
    all of them.
    """

    def __init__(self, spark: SparkSession):
        self.late = self.seen = 0
        self._spark, self._running, self._ended = spark, 0, Condition()

    def onQueryStarted(self, event) -> None:
        with self._ended:
            self._running += 1

    def onQueryProgress(self, event) -> None:
        self.seen += event.progress.numInputRows
        self.late += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._running -= 1
            self._ended.notify_all()

    def __enter__(self) -> "ProgressTotals":
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        # Reports arrive after the query has ended.
        with self._ended:
            self._ended.wait_for(lambda: self._running == 0, timeout=60)
        self._spark.streams.removeListener(self)


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; event time becomes a TIMESTAMP, which watermarks need."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def read_batches(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Agent batches, one JSON document per line, as a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.readStream.schema(schema.METRIC_BATCH).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def drain(stream: DataFrame, purpose: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Run an append stream over everything available into a Parquet table and return the table."""
    spark = stream.sparkSession
    out = scratch.new_folder(spark, purpose)
    with settings(spark, _state_settings()):
        query = (
            stream.writeStream.outputMode("append")
            .option("checkpointLocation", scratch.new_folder(spark, f"{purpose}-state"))
            .partitionBy(*partition_by)
            .format("parquet")
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, purpose: str) -> tuple[DataFrame, StreamingQuery]:
    """Run an update stream; every micro-batch replaces its own folder, so a retry writes nothing twice."""
    spark = stream.sparkSession
    out = scratch.new_folder(spark, purpose)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, _state_settings()):
        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", scratch.new_folder(spark, f"{purpose}-state"))
            .foreachBatch(store)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(fields + ", batch int").parquet(out), query

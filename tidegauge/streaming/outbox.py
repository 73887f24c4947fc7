"""Notifications of a stream: a cooldown per key, and a sink that a replayed batch fills only once."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.timing import as_micros, micros
from tidegauge.streaming.inorder import SLOT, Folded, run_in_order
from tidegauge.streaming.run import _state_settings, settings


def cooldown(span_us: int):
    """Of rows in order, the first and then each that is a span after the one before it that was sent."""

    def fold(state, rows: pd.DataFrame):
        us = rows["us"].to_numpy()
        last, at, sent = None if state is None else state[0], 0, []
        while True:
            at = at if last is None else max(at, int(np.searchsorted(us, last + span_us)))
            if at >= len(us):
                break
            sent.append(at)
            last, at = int(us[at]), at + 1
        return (last,), pd.DataFrame({"sent_us": us[sent], "value": rows["value"].to_numpy()[sent]})

    return fold


def cooled_down(notices: DataFrame, keys: list[str], tie: str, span: timedelta, delay: timedelta | None = None, slot: timedelta = SLOT) -> DataFrame:
    """(keys, sent_at, value) of the notices (keys, ``ts``, tie, ``value``) that the cooldown lets through.

    The key's next notice goes out a ``span`` after its last one or later.
    ``delay`` sets the watermark; None means that ``notices`` come with one, as
    the output of another machine does.
    """
    timed = notices if delay is None else notices.withWatermark("ts", f"{as_micros(delay)} microseconds")
    rows = timed.select(*keys, "ts", micros(F.col("ts")).alias("us"), F.col(tie).cast("bigint").alias("tie"), F.col("value").cast("double").alias("value"))
    machine = Folded(keys, "last bigint", cooldown(as_micros(span)), slot)
    sent = run_in_order(rows, keys, machine, "sent_us bigint, value double")
    return sent.select(*keys, F.timestamp_micros("sent_us").alias("sent_at"), "value")


def deliver(notices: DataFrame, path: str, checkpoint: str, keys: list[str], channels: list[str], available_now: bool = True) -> StreamingQuery:
    """Write a message per notice and channel below ``path``; what is read there is what is to be sent.

    Each micro-batch owns a folder, which it replaces.  A batch that is run
    again after a failure has the same number and the same notices, so it fills
    the same folder with the same messages; ``message_id`` names a notice and
    channel, for receivers that want to check.
    """

    def send(batch: DataFrame, number: int) -> None:
        each = batch.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (*keys, "channel")]
        message = F.sha2(F.concat_ws("\n", *parts, micros(F.col("sent_at")).cast("string")), 256)
        each.withColumn("message_id", message).write.mode("overwrite").parquet(f"{path}/batch={number}")

    with settings(notices.sparkSession, _state_settings()):
        writer = notices.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(send)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Minimum distance between notifications of one key.

A notification goes out if the last one *sent* lies at least the cooldown back,
which is a recursion.  Two notifications at least one cooldown apart with
nothing in between cannot influence each other, so the candidates fall into
independent runs; short runs are folded in order.  A run too long for one task
is solved by pointer jumping instead: every candidate knows the next one that
could be sent after it, and the chain from the first is found in a logarithmic
number of joins on unique ids.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.timing import as_micros, micros
from tidegauge.plans import scratch, skew
from tidegauge.plans.fold import folded
from tidegauge.plans.ordered import Ordered, Previous, RunningSum, asof


def cooled_down(candidates: DataFrame, keys: list[str], at: str, ident: str, gap: timedelta) -> DataFrame:
    """The candidates that are sent.  ``ident`` is unique; ties in time go by it."""
    width = as_micros(gap)
    slim = candidates.select(*keys, F.col(ident).alias("_id"), micros(F.col(at)).alias("_us"))
    free = F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= width)
    runs = (
        Ordered(slim, keys, ["_us", "_id"])
        .scan(_before=Previous(F.col("_us")))
        .scan(_run=RunningSum(F.when(free, 1).otherwise(0)))
        .frame()
        .drop("_before")
    )
    run = [*keys, "_run"]
    hot = skew.hot_keys(runs, run)
    if hot is None:
        sent = _fold(runs, run, width)
    else:
        table = F.broadcast(hot.table.select(*run))
        match = skew.same(runs, table, run)
        short = _fold(runs.join(table, match, "left_anti"), run, width)
        sent = short.unionByName(_jump(runs.join(table, match, "left_semi"), run, width))
    return candidates.join(sent.withColumnRenamed("_id", ident), ident, "left_semi")


def _fold(runs: DataFrame, run: list[str], width: int) -> DataFrame:
    def step(last, rows: pd.DataFrame):
        times = rows["_us"].to_numpy()
        picked, i = [], 0 if last is None else int(np.searchsorted(times, last + width))
        while i < len(times):
            picked.append(i)
            last = int(times[i])
            i = int(np.searchsorted(times, last + width))
        return last, rows.iloc[picked][["_id"]]

    ident = runs.schema["_id"].dataType.simpleString()
    return folded(runs.select(*run, "_us", "_id"), run, ["_us", "_id"], step, f"_id {ident}")


def _jump(runs: DataFrame, run: list[str], width: int) -> DataFrame:
    # Looking forward in time is looking back along negated times.
    wanted = runs.select(*run, "_id", (-(F.col("_us") + width)).alias("_at"))
    offered = runs.select(*run, (-F.col("_us")).alias("_at"), F.struct((-F.col("_us")).alias("u"), "_id").alias("_next"))
    # Among equal times the smallest id is the one that is sent.
    first = offered.groupBy(*run, "_at").agg(F.min("_next").alias("_next"))
    hops = asof(wanted, first, run, ["_at", "_id"], ["_at"], ["_next"])
    hop = scratch.cut(hops.select("_id", F.col("_next._id").alias("_to")).filter(F.col("_to").isNotNull()))
    heads = runs.groupBy(*run).agg(F.min(F.struct("_us", "_id")).alias("_h")).select(F.col("_h._id").alias("_id"))
    reached = scratch.cut(heads)
    while True:
        more = reached.join(hop, "_id").select(F.col("_to").alias("_id"))
        grown = scratch.cut(reached.unionByName(more).distinct())
        if grown.count() == reached.count():
            return grown
        reached = grown
        there = hop.select(F.col("_id").alias("_to"), F.col("_to").alias("_far"))
        hop = scratch.cut(hop.join(there, "_to").select("_id", F.col("_far").alias("_to")))

"""Statistical detectors per series: z-score, exponentially weighted average, ensembles.

Every detector is a pair of frame functions (fit, score), so series are spread
over the cluster by Spark; ``Detector`` is also the interface for detectors
that users bring.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.plans.fold import folded
from tidegauge.plans.groups import attach
from tidegauge.plans.ordered import BLOCK, Ordered, RunningMoments, split_hot

# Training minimum and detector settings.
MIN_SAMPLES = 10
EWMA_ALPHA = 0.2
EWMA_LIMIT = 3.0
ENSEMBLE_WEIGHTS = {"ewma": 0.6, "forest": 0.4}


def zscore_train(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation per series with enough samples."""
    stats = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev")
    )
    return stats.filter(F.col("n") >= MIN_SAMPLES)


def _zscore(limit: float) -> tuple[Column, Column]:
    """Anomaly flag and score from columns ``value``, ``mean`` and ``stddev``.

    A series without spread flags any other value but scores it 0.
    """
    off, spread = F.col("value") - F.col("mean"), F.col("stddev")
    score = F.when(spread == 0, F.lit(0.0)).otherwise(F.abs(off / F.nullif(spread, F.lit(0.0))) / F.lit(limit))
    return F.when(spread == 0, off != 0).otherwise(score > 1), score


def zscore_detect(samples: DataFrame, model: DataFrame, keys: list[str], limit: float = 3.0) -> DataFrame:
    """Score every sample against its series' model; series without a model are left out."""
    flag, score = _zscore(limit)
    return attach(samples, model, keys).withColumns({"is_anomaly": flag, "score": score})


def zscore_online(samples: DataFrame, keys: list[str], order: list[str], limit: float = 3.0) -> DataFrame:
    """Score each sample against all earlier ones of its series, once there are enough."""
    past = (
        Ordered(samples, keys, order)
        .scan(_past=RunningMoments(F.col("value"), inclusive=False))
        .filter(F.col("_past.n") >= MIN_SAMPLES)
        .frame()
    )
    flag, score = _zscore(limit)
    spread = F.sqrt(F.col("_past.m2") / F.col("_past.n"))
    known = past.withColumns({"n": F.col("_past.n"), "mean": F.col("_past.mean"), "stddev": spread}).drop("_past")
    return known.withColumns({"is_anomaly": flag, "score": score})


def valid_alpha(alpha: float) -> float:
    return alpha if 0 < alpha < 1 else EWMA_ALPHA


_STATE = ["mean_before", "var_before", "mean_after", "var_after"]


def ewma_states(samples: DataFrame, keys: list[str], order: list[str], alpha: float = EWMA_ALPHA) -> DataFrame:
    """Weighted mean and variance before and after every sample.

    mean' = a x + (1 - a) mean, var' = a (x - mean)^2 + (1 - a) var, starting
    with the first value and variance 0; its own "before" is null.

    Ordinary series are folded in order.  A series too long for one task is
    folded in blocks: the state at the end of a block is an explicit function
    of the state at its start (linear in the mean, quadratic for the variance),
    so one summary row per block gives every block its exact starting state.
    """
    a = valid_alpha(alpha)
    slim = samples.select(*keys, *order, "value")
    whole, blocks = split_hot(slim, keys, [F.col(c) for c in order])
    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    columns = [*keys, *order, "value"]
    out_schema = ", ".join([f"{c} {types[c]}" for c in columns] + [f"{c} double" for c in _STATE])
    step = _ewma_step(a, columns)
    result = folded(whole, keys, order, step, out_schema)
    if blocks is None:
        return result

    block_keys = [*keys, BLOCK]
    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    summary_schema = f"{key_types}, {BLOCK} int, " + ", ".join(f"{c} double" for c in _SUMMARY)
    summaries = folded(
        blocks, block_keys, order, _ewma_summary(a), summary_schema,
        finish=lambda key, state: dict(zip([*block_keys, *_SUMMARY], [*key, *state])),
    )
    carried = summaries.groupBy(*keys).applyInPandas(_ewma_chain(block_keys), f"{key_types}, {BLOCK} int, _m double, _v double")
    joined = blocks.join(carried, block_keys)
    started = folded(joined, block_keys, order, step, out_schema, lambda row: None if np.isnan(row["_m"]) else (row["_m"], row["_v"]))
    return result.unionByName(started)


def _ewma_step(a: float, columns: list[str]):
    def step(state, rows: pd.DataFrame):
        x = rows["value"].to_numpy(dtype=float)
        fresh = state is None
        mean, var = (x[0], 0.0) if fresh else state
        means = _decayed(mean, x, a)
        variances = _decayed(var, (x - means[:-1]) ** 2, a)
        out = rows[columns].copy()
        out["mean_before"], out["var_before"] = means[:-1], variances[:-1]
        out["mean_after"], out["var_after"] = means[1:], variances[1:]
        if fresh:
            out.iloc[0, out.columns.get_indexer(["mean_before", "var_before"])] = np.nan
        return (means[-1], variances[-1]), out

    return step


def _decayed(start: float, x: np.ndarray, a: float) -> np.ndarray:
    """start, then a x + (1 - a) previous for every x."""
    return pd.Series(np.concatenate([[start], x])).ewm(alpha=a, adjust=False).mean().to_numpy()


# A stretch of rows as a function of the state it starts with.  With everything
# measured from the stretch's first value, (M, V) becomes m + p M for the mean
# and a - 2 b M + c M^2 + p V for the variance; measuring from a value of the
# series itself keeps these differences free of cancellation.
_SUMMARY = ["first", "p", "m", "a", "b", "c"]


def _ewma_summary(alpha: float):
    q = 1 - alpha

    def step(state, rows: pd.DataFrame):
        raw = rows["value"].to_numpy(dtype=float)
        first = raw[0] if state is None else state[0]
        x = raw - first
        means = _decayed(0.0, x, alpha)
        off = x - means[:-1]
        last = alpha * q ** (len(x) - 1)
        p2, m2, a2 = q ** len(x), means[-1], _decayed(0.0, off**2, alpha)[-1]
        b2, c2 = last * off.sum(), last * (q ** np.arange(len(x))).sum()
        if state is None:
            return (first, p2, m2, a2, b2, c2), None
        _, p1, m1, a1, b1, c1 = state
        a = a2 - 2 * b2 * m1 + c2 * m1**2 + p2 * a1
        b = b2 * p1 - c2 * m1 * p1 + p2 * b1
        return (first, p1 * p2, m2 + p2 * m1, a, b, c2 * p1**2 + p2 * c1), None

    return step


def _ewma_chain(block_keys: list[str]):
    """Starting state of every block from the summaries of the blocks before it (one row each)."""

    def chain(summaries: pd.DataFrame) -> pd.DataFrame:
        ordered = summaries.sort_values(BLOCK)
        starts, state = [], None
        for first, p, m, a, b, c in ordered[_SUMMARY].to_numpy():
            starts.append((np.nan, np.nan) if state is None else state)
            mean, var = (0.0, 0.0) if state is None else (state[0] - first, state[1])
            state = first + m + p * mean, max(0.0, a - 2 * b * mean + c * mean**2 + p * var)
        out = ordered[block_keys].copy()
        out["_m"], out["_v"] = zip(*starts)
        return out

    return chain


def ewma_train(states: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Final state per series."""
    final = F.max_by(F.struct("mean_after", "var_after"), F.struct(*order))
    return states.groupBy(*keys).agg(final.alias("_f"), F.count(F.lit(1)).alias("n")).select(
        *keys, "n", F.col("_f.mean_after").alias("mean"), F.col("_f.var_after").alias("variance")
    )


def ewma_bounds(model: DataFrame, limit: float = EWMA_LIMIT) -> DataFrame:
    spread = F.sqrt("variance")
    return model.withColumns(
        {"stddev": spread, "lower": F.col("mean") - limit * spread, "upper": F.col("mean") + limit * spread}
    )


def ewma_detect(states: DataFrame, limit: float = EWMA_LIMIT) -> DataFrame:
    """Judge each sample by the state before it; a series' first sample cannot be judged.

    Without spread the score is 1 for any other value and 0 for the same.
    """
    value, mean, spread = F.col("value"), F.col("mean_before"), F.sqrt("var_before")
    judged = states.filter(mean.isNotNull())
    outside = (value > mean + limit * spread) | (value < mean - limit * spread)
    score = F.when(spread > 0, F.abs(value - mean) / (limit * F.nullif(spread, F.lit(0.0))))
    flat = F.when(value != mean, F.lit(1.0)).otherwise(F.lit(0.0))
    return judged.withColumns({"is_anomaly": outside, "score": F.coalesce(score, flat)})


def multi_detect(scores: DataFrame, ident: list[str], threshold: float) -> DataFrame:
    """Weighted mean of detector scores per sample.

    ``scores`` is long: ident, detector, weight, is_anomaly, score.  A detector
    without a score is left out of the mean, one that flags with score 0 counts
    as 1.
    """
    score = F.when(F.col("is_anomaly") & (F.col("score") == 0), 1.0).otherwise(F.col("score"))
    weight = F.when(F.col("score").isNotNull(), F.col("weight"))
    combined = scores.groupBy(*ident).agg(
        F.try_divide(F.sum(score * weight), F.sum(weight)).alias("score"), F.count(weight).alias("detectors")
    )
    return combined.filter(F.col("score").isNotNull()).withColumn("is_anomaly", F.col("score") > threshold)


class Detector(Protocol):
    """What a user-supplied detector offers; both steps are frame to frame."""

    name: str

    def fit(self, samples: DataFrame) -> DataFrame: ...

    def score(self, samples: DataFrame, model: DataFrame) -> DataFrame:
        """Every sample's ident with ``is_anomaly`` and ``score`` (null if it cannot tell)."""
        ...


def run_detectors(
    training: DataFrame, samples: DataFrame, detectors: list[tuple[Detector, float]], ident: list[str], threshold: float
) -> DataFrame:
    """Fit every detector, score the samples and combine by weight."""
    scored = []
    for detector, weight in detectors:
        result = detector.score(samples, detector.fit(training)).select(*ident, "is_anomaly", "score")
        scored.append(result.withColumns({"detector": F.lit(detector.name), "weight": F.lit(float(weight))}))
    return multi_detect(reduce(lambda a, b: a.unionByName(b), scored), ident, threshold)

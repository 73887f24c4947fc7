"""Isolation forest on single values.

In one dimension a tree is a step function of the value: its leaves are
intervals with a path length each.  Averaging a series' trees gives one step
function, kept as a table of (series, from_value, path).  Scoring is then an
as-of lookup of each value among the steps of its series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.operators.anomaly import MIN_SAMPLES
from tidegauge.operators.select import newest_per_group
from tidegauge.plans.groups import attach, top_n
from tidegauge.plans.ordered import asof

# Forest shape, anomaly limit, rows kept for retraining per sample row.
TREES = 100
SAMPLE = 256
LIMIT = 0.6
KEPT_SAMPLES = 10
_EULER = 0.5772156649
# Rows that go on to a tree's draw, per row it takes, and the range of its hashes.
MARGIN = 2
_RANGE = 1 << 40


def expected_path(n: int) -> float:
    """Average path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + _EULER) - 2 * (n - 1) / n


def retained(samples: DataFrame, keys: list[str], order: list[str], sample: int = SAMPLE) -> DataFrame:
    """The most recent rows a forest keeps for its next training."""
    return newest_per_group(samples, keys, [F.col(c).desc() for c in order], sample * KEPT_SAMPLES)


def _candidates(samples: DataFrame, keys: list[str], ident: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """Rows that any tree may draw, once each, with the hashes of those trees as ``hash * trees + tree``.

    The draw depends on seed and data only, not on partitions, retries or the
    length of the series.  Rows whose hash is too large to be among a tree's
    smallest are never shuffled: of n rows those below ``MARGIN * sample / n``
    of the range go on, twice as many as are needed (fewer than ``sample`` of
    them would be 14 standard deviations off).
    """
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hashed = attach(samples.select(*keys, "value", F.xxhash64(F.lit(seed), *keys, *ident).alias("_row")), counts, keys)
    limit = F.lit(float(MARGIN * sample * _RANGE)) / F.col("_n")
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("_row", t), F.lit(_RANGE)) * trees + t)
    kept = F.filter(draws, lambda d: F.floor(d / F.lit(trees)) < limit)
    return hashed.select(*keys, "value", "_row", kept.alias("_draws")).filter(F.size("_draws") > 0)


def training_pool(
    samples: DataFrame, keys: list[str], ident: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 0
) -> DataFrame:
    """Each tree's own ``sample`` rows of each series: those with the smallest hashes of identity and tree."""
    rows = _candidates(samples, keys, ident, trees, sample, seed).withColumn("_d", F.explode("_draws"))
    drawn = rows.select(*keys, "value", "_row", (F.col("_d") % trees).cast("int").alias("_tree"), F.floor(F.col("_d") / F.lit(trees)).alias("_hash"))
    return top_n(drawn, [*keys, "_tree"], [F.col("_hash"), F.col("_row"), F.col("value")], sample, "_draw").drop("_row")


def train(pool: DataFrame, keys: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """Steps of the averaged forest per series: (keys, from_value, path), the first step from -infinity.

    A group is at most ``trees * sample`` rows.
    """

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_tree", "_draw"])
        return _steps(rows, keys, rows["value"].to_numpy(dtype=float), rows["_tree"].to_numpy(), int(rows["_hash"].iloc[0]), trees, sample, seed)

    return pool.select(*keys, "value", "_tree", "_hash", "_draw").groupBy(*keys).applyInPandas(grow, _step_schema(pool, keys))


def fit(samples: DataFrame, keys: list[str], ident: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """The same steps straight from the samples: a row is shuffled once, and each tree takes its rows where they meet.

    A group is at most ``MARGIN * trees * sample`` rows and draws.
    """
    rows = _candidates(samples, keys, ident, trees, sample, seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        each = group["_draws"].str.len().to_numpy()
        draws = np.concatenate(group["_draws"].to_numpy())
        at = np.repeat(np.arange(len(group)), each)
        tree, hashes = draws % trees, draws // trees
        value = group["value"].to_numpy(dtype=float)
        order = np.lexsort((value[at], group["_row"].to_numpy()[at], hashes, tree))
        tree = tree[order]
        place = np.arange(len(order)) - np.searchsorted(tree, tree)
        taken = order[place < sample]
        return _steps(group, keys, value[at[taken]], tree[place < sample], int(hashes[order[0]]), trees, sample, seed)

    return rows.groupBy(*keys).applyInPandas(grow, _step_schema(rows, keys))


def _step_schema(rows: DataFrame, keys: list[str]) -> str:
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join([f"{k} {fields[k]}" for k in keys] + ["from_value double", "path double"])


def _steps(group: pd.DataFrame, keys: list[str], value: np.ndarray, tree: np.ndarray, first_hash: int, trees: int, sample: int, seed: int) -> pd.DataFrame:
    """One series' averaged step function out of its drawn values, sorted by tree."""
    bounds = np.flatnonzero(np.diff(tree, prepend=-1, append=trees))
    if bounds[1] - bounds[0] < MIN_SAMPLES:
        return pd.DataFrame(columns=[*keys, "from_value", "path"])
    depth = math.ceil(math.log2(sample))
    # The first hash differs between series and seeds; it seeds the splits.
    random = np.random.default_rng([seed, first_hash])
    starts, changes = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        at, path = _leaves(np.sort(value[a:b]), depth, random)
        starts.append(at)
        changes.append(np.diff(path, prepend=0.0))
    starts, changes = np.concatenate(starts), np.concatenate(changes)
    points, where = np.unique(starts, return_inverse=True)
    paths = np.cumsum(np.bincount(where, weights=changes)) / trees
    out = pd.DataFrame({"from_value": points, "path": paths})
    for key in keys:
        out[key] = group[key].iloc[0]
    return out


def _leaves(values: np.ndarray, depth: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Leaf intervals, left to right, of one random tree over sorted values."""
    starts, paths = [], []
    pending = [(-math.inf, 0, len(values), 0)]
    while pending:
        low, first, end, level = pending.pop()
        smallest, largest = values[first], values[end - 1]
        if end - first <= 1 or level >= depth or smallest == largest:
            starts.append(low)
            paths.append(level + expected_path(end - first))
            continue
        split = smallest + random.random() * (largest - smallest)
        middle = first + int(np.searchsorted(values[first:end], split, side="left"))
        if middle == first:
            pending.append((low, first, end, level + 1))
            continue
        pending.append((split, middle, end, level + 1))
        pending.append((low, first, middle, level + 1))
    return np.array(starts), np.array(paths)


def forest_score(path: Column, sample: int = SAMPLE) -> Column:
    """2^(-path / c); c is that of the configured sample size even for shorter series."""
    return F.pow(F.lit(2.0), -path / F.lit(expected_path(sample)))


def score(samples: DataFrame, steps: DataFrame, keys: list[str], ident: list[str], sample: int = SAMPLE) -> DataFrame:
    """Score and flag every sample of a trained series."""
    found = asof(samples, steps, keys, ["value", *ident], ["from_value"], ["path"])
    scored = found.filter(F.col("path").isNotNull()).withColumn("score", forest_score(F.col("path"), sample))
    return scored.withColumn("is_anomaly", F.col("score") > LIMIT)

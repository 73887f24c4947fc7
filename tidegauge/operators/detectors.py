"""Detectors in the pluggable form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.operators import anomaly, forest
from tidegauge.plans.groups import attach


class ZScore:
    name = "zscore"

    def __init__(self, keys: list[str], limit: float = 3.0):
        self._keys, self._limit = keys, limit

    def fit(self, samples: DataFrame) -> DataFrame:
        return anomaly.zscore_train(samples, self._keys)

    def score(self, samples: DataFrame, model: DataFrame) -> DataFrame:
        return anomaly.zscore_detect(samples, model, self._keys, self._limit)


class SeenRange:
    """Flags values outside the range seen in training."""

    name = "seen_range"

    def __init__(self, keys: list[str]):
        self._keys = keys

    def fit(self, samples: DataFrame) -> DataFrame:
        return samples.groupBy(*self._keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))

    def score(self, samples: DataFrame, model: DataFrame) -> DataFrame:
        inside = F.col("value").between(F.col("low"), F.col("high"))
        return attach(samples, model, self._keys).withColumns(
            {"is_anomaly": ~inside, "score": F.when(inside, 0.0).otherwise(1.0)}
        )


class Ewma:
    """Judges samples by the state at the end of training, without updating it."""

    name = "ewma"

    def __init__(self, keys: list[str], order: list[str], alpha: float = anomaly.EWMA_ALPHA, limit: float = anomaly.EWMA_LIMIT):
        self._keys, self._order, self._alpha, self._limit = keys, order, alpha, limit

    def fit(self, samples: DataFrame) -> DataFrame:
        states = anomaly.ewma_states(samples, self._keys, self._order, self._alpha)
        return anomaly.ewma_train(states, self._keys, self._order)

    def score(self, samples: DataFrame, model: DataFrame) -> DataFrame:
        fixed = model.select(*self._keys, F.col("mean").alias("mean_before"), F.col("variance").alias("var_before"))
        return anomaly.ewma_detect(attach(samples, fixed, self._keys), self._limit)


class Forest:
    name = "forest"

    def __init__(self, keys: list[str], ident: list[str], seed: int = 0):
        self._keys, self._ident, self._seed = keys, ident, seed

    def fit(self, samples: DataFrame) -> DataFrame:
        return forest.fit(samples, self._keys, self._ident, seed=self._seed)

    def score(self, samples: DataFrame, model: DataFrame) -> DataFrame:
        return forest.score(samples, model, self._keys, self._ident)

"""Top rows per group and per-key lookups that stay even when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.plans import skew

_FAN_IN = 64


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows per group, numbered in column ``rank``; the order must be total.

    Groups too long for one task are cut in rounds: by salt first, then salts
    are merged 64 at a time until one is left, every round keeping at most
    ``n`` rows per salt.
    """
    hot = skew.hot_keys(df, group)
    if hot is None:
        return _cut(df, group, order, n, rank)
    sized = hot.table.withColumn("_pieces", F.ceil(F.col("_n") / hot.per_task)).drop("_n")
    match = skew.same(df, sized, group)
    salt = F.pmod(F.xxhash64(*[df[c] for c in df.columns]), sized["_pieces"]).alias("_salt")
    salted = df.join(F.broadcast(sized), match, "inner").select(*[df[c] for c in df.columns], salt)
    pieces = sized.agg(F.max("_pieces")).first()[0]
    while pieces > 1:
        salted = _cut(salted, [*group, "_salt"], order, n, rank).drop(rank)
        salted = salted.withColumn("_salt", F.floor(F.col("_salt") / _FAN_IN))
        pieces = -(-pieces // _FAN_IN)
    rest = df.join(F.broadcast(sized.select(*group)), match, "left_anti")
    return _cut(rest, group, order, n, rank).unionByName(_cut(salted.drop("_salt"), group, order, n, rank))


def _cut(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.filter(F.col(rank) <= n)


def attach(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Join every row with its key's single model row.

    Rows of hot keys meet a broadcast of just those keys' model rows (there are
    never more hot keys than shuffle partitions) and stay where they are; the
    others are joined as Spark sees fit.
    """
    hot = skew.hot_keys(rows, keys)
    if hot is None:
        return rows.join(model, keys)
    named = F.broadcast(hot.table.select(*keys))
    hot_model = F.broadcast(model.join(named, skew.same(model, named, keys), "left_semi"))
    match = skew.same(rows, named, keys)
    usual = rows.join(named, match, "left_anti").join(model, keys)
    return usual.unionByName(rows.join(hot_model, keys))

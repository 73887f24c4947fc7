"""Ordered scans (previous row, running sums, last seen value) per series.

A window over a whole series puts that series into one task.  Most series are
small and that is the cheapest plan, so it stays the plan for them.  Series
with more rows than a task should take are range-partitioned on
(keys, order) instead, which spreads one series over many even blocks; each
block is scanned on its own, every block hands one summary row to a second,
tiny window over blocks, and the carried values are joined back.  Results are
the same on both paths.

``order`` must be total within the keys (end it with a unique column), or the
scan is as undefined as any SQL window over ties.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.plans import scratch, skew

BLOCK = "_block"
_LAST = "_is_last"
_ROW = "_row_in_block"


@dataclass(frozen=True)
class Previous:
    """Value ``offset`` rows earlier, null where there is none."""

    expr: Column
    offset: int = 1


@dataclass(frozen=True)
class RunningSum:
    """Sum from the first row up to this one (up to the one before, if not inclusive)."""

    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunningLast:
    """Most recent non-null value up to this row."""

    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunningMax:
    """Largest value up to this row."""

    expr: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunningMoments:
    """Count, mean and sum of squared distances from it, (n, mean, m2), up to this row (up to the one before, if not inclusive).

    Nulls do not count.  Parts are merged by their means, never by sums of
    squares, so values far from zero or a later outlier blur nothing.
    """

    expr: Column
    inclusive: bool = True


Scan = Previous | RunningSum | RunningLast | RunningMax | RunningMoments


def split_hot(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot keys cut into even blocks (column ``BLOCK``).

    Blocks are range partitions on (keys, order), so block numbers grow with
    the order.  They are stored before use: everything downstream must see the
    same cut.
    """
    hot = skew.hot_keys(df, keys)
    if hot is None:
        return df, None
    keys_only = F.broadcast(hot.table.select(*keys))
    match = skew.same(df, keys_only, keys)
    blocks = (
        df.join(keys_only, match, "left_semi")
        .repartitionByRange(hot.pieces, *[F.col(k) for k in keys], *order)
        .withColumn(BLOCK, F.spark_partition_id())
    )
    return df.join(keys_only, match, "left_anti"), scratch.cut(blocks)


class Ordered:
    """A frame with a per-key row order on which scans can be stacked.

    ``scan`` adds ordered columns, ``derive`` adds row-wise columns that later
    scans may use, ``frame`` returns the result.  All stacked scans share one
    shuffle and one sort.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list):
        self._keys = list(keys)
        # Ascending plain columns can be compared as a struct.
        self._position = F.struct(*order) if all(isinstance(c, str) for c in order) else None
        self._order = [F.col(c) if isinstance(c, str) else c for c in order]
        self._whole, self._blocks = split_hot(df, self._keys, self._order)

    def derive(self, **columns: Column) -> "Ordered":
        return self._each(lambda df: df.withColumns(columns))

    def scan(self, **scans: Scan) -> "Ordered":
        window = Window.partitionBy(*self._keys).orderBy(*self._order)
        self._whole = self._whole.withColumns({n: _within(s, window) for n, s in scans.items()})
        if self._blocks is not None:
            self._blocks = self._blockwise(scans)
        return self

    def filter(self, condition: Column) -> "Ordered":
        return self._each(lambda df: df.filter(condition))

    def frame(self) -> DataFrame:
        if self._blocks is None:
            return self._whole
        return self._whole.unionByName(self._blocks.drop(BLOCK))

    def _each(self, change: Callable[[DataFrame], DataFrame]) -> "Ordered":
        self._whole = change(self._whole)
        if self._blocks is not None:
            self._blocks = change(self._blocks)
        return self

    def _blockwise(self, scans: dict[str, Scan]) -> DataFrame:
        block = Window.partitionBy(*self._keys, BLOCK).orderBy(*self._order)
        columns = {_ROW: F.row_number().over(block), **{n: _within(s, block) for n, s in scans.items()}}
        inside = self._blocks.withColumns(columns)

        across = Window.partitionBy(*self._keys).orderBy(BLOCK)
        carried = self._summaries(scans, block).select(
            *[F.col(k).alias(f"_k_{k}") for k in self._keys],
            F.col(BLOCK).alias("_k_block"),
            *[_carry(s, F.col(f"_out_{n}"), across).alias(f"_in_{n}") for n, s in scans.items()],
        )
        match = F.col(BLOCK) == F.col("_k_block")
        for key in self._keys:
            match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
        # Blocks are contiguous, so there are at most hot keys + blocks carried rows.
        joined = inside.join(F.broadcast(carried), match, "inner")
        merged = {n: _merge(s, F.col(n), F.col(f"_in_{n}"), F.col(_ROW)) for n, s in scans.items()}
        return joined.withColumns(merged).select(*self._blocks.columns, *scans)

    def _summaries(self, scans: dict[str, Scan], block) -> DataFrame:
        """One row per key and block with what the block hands on."""
        totals = {n: _block_total(s, self._position) for n, s in scans.items()}
        if all(total is not None for total in totals.values()):
            aggregates = [total.alias(f"_out_{n}") for n, total in totals.items()]
            return self._blocks.groupBy(*self._keys, BLOCK).agg(*aggregates)
        columns = {f"_out_{n}": _handed_on(s, block) for n, s in scans.items()}
        last = F.lead(F.lit(1)).over(block).isNull()
        return self._blocks.withColumns({_LAST: last, **columns}).filter(_LAST)


def _moments(over: Callable[[Column], Column], expr: Column) -> Column:
    n = over(F.count(expr))
    mean, variance = (F.coalesce(over(f(expr)), F.lit(0.0)) for f in (F.avg, F.var_pop))
    return F.struct(n.alias("n"), mean.alias("mean"), (variance * n).alias("m2"))


def _joined(a: Column, b: Column) -> Column:
    """Moments of two parts together."""
    n, off = a["n"] + b["n"], b["mean"] - a["mean"]
    share = F.coalesce(F.try_divide(b["n"].cast("double"), n.cast("double")), F.lit(0.0))
    return F.struct(n.alias("n"), (a["mean"] + off * share).alias("mean"), (a["m2"] + b["m2"] + off * off * share * a["n"]).alias("m2"))


_NO_MOMENTS = "named_struct('n', 0L, 'mean', 0D, 'm2', 0D)"


def _upto(window, inclusive: bool):
    return window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def _within(scan: Scan, window) -> Column:
    match scan:
        case Previous(expr, offset):
            return F.lag(expr, offset).over(window)
        case RunningSum(expr, inclusive):
            return F.sum(expr).over(_upto(window, inclusive))
        case RunningLast(expr, inclusive):
            return F.last(expr, ignorenulls=True).over(_upto(window, inclusive))
        case RunningMax(expr, inclusive):
            return F.max(expr).over(_upto(window, inclusive))
        case RunningMoments(expr, inclusive):
            return _moments(lambda c: c.over(_upto(window, inclusive)), expr)


def _block_total(scan: Scan, position: Column | None) -> Column | None:
    """The same as ``_handed_on`` as an aggregate, which needs no sorted block; None if there is none."""
    match scan:
        case RunningSum(expr):
            return F.sum(expr)
        case RunningMax(expr):
            return F.max(expr)
        case RunningMoments(expr):
            return _moments(lambda c: c, expr)
        case RunningLast(expr) if position is not None:
            return F.max_by(expr, F.when(expr.isNotNull(), position))
        case Previous(expr, 1) if position is not None:
            return F.array(F.max_by(F.struct(expr.alias("v")), position))
    return None


def _handed_on(scan: Scan, window) -> Column:
    """What the last row of a block knows about the whole block."""
    match scan:
        case Previous(expr, offset):
            tail = window.rowsBetween(1 - offset, 0)
            return F.collect_list(F.struct(expr.alias("v"))).over(tail)
        case RunningSum(expr):
            return F.sum(expr).over(_upto(window, True))
        case RunningLast(expr):
            return F.last(expr, ignorenulls=True).over(_upto(window, True))
        case RunningMax(expr):
            return F.max(expr).over(_upto(window, True))
        case RunningMoments(expr):
            return _moments(lambda c: c.over(_upto(window, True)), expr)


def _carry(scan: Scan, out: Column, across) -> Column:
    """Combine the summaries of all earlier blocks of the key."""
    match scan:
        case Previous(_, offset):
            return F.flatten(F.collect_list(out).over(across.rowsBetween(-offset, -1)))
        case RunningSum():
            return F.sum(out).over(_upto(across, False))
        case RunningLast():
            return F.last(out, ignorenulls=True).over(_upto(across, False))
        case RunningMax():
            return F.max(out).over(_upto(across, False))
        case RunningMoments():
            return F.aggregate(F.collect_list(out).over(_upto(across, False)), F.expr(_NO_MOMENTS), _joined)


def _merge(scan: Scan, inside: Column, carried: Column, row: Column) -> Column:
    match scan:
        case Previous(_, offset):
            earlier = F.get(carried, F.size(carried) - offset + row - 1)["v"]
            return F.when(row > offset, inside).otherwise(earlier)
        case RunningSum():
            return F.when(carried.isNull(), inside).otherwise(carried + F.coalesce(inside, F.lit(0)))
        case RunningLast():
            return F.coalesce(inside, carried)
        case RunningMax():
            return F.greatest(inside, carried)
        case RunningMoments():
            return _joined(carried, inside)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_order: list[str],
    right_order: list[str],
    payload: list[str],
    right_first: bool = True,
    largest: bool = False,
) -> DataFrame:
    """Attach to each left row the payload of the latest right row at or before it.

    With ``largest`` it is the greatest payload of all those rows instead.

    ``left_order`` and ``right_order`` name columns of equal types, compared in
    turn; the first is the point in time.  Both inputs are stacked and scanned
    once, so nothing is paired up and a hot key is split like any other scan.
    """
    point = F.col(left_order[0])
    marked = left.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        point.alias("_at"),
        F.lit(1 if right_first else 0).alias("_side"),
        F.struct(*[F.col(c) for c in left_order[1:]], F.lit(0).alias("_z")).alias("_tie_left"),
        F.lit(None).cast(_struct_type(right, right_order[1:])).alias("_tie_right"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(_payload_type(right, payload)).alias("_right"),
    )
    other = right.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(right_order[0]).alias("_at"),
        F.lit(0 if right_first else 1).alias("_side"),
        F.lit(None).cast(_struct_type(left, left_order[1:])).alias("_tie_left"),
        F.struct(*[F.col(c) for c in right_order[1:]], F.lit(0).alias("_z")).alias("_tie_right"),
        F.lit(None).cast(left.schema).alias("_left"),
        F.struct(*payload).alias("_right"),
    )
    names = [f"_k{i}" for i in range(len(keys))]
    scanned = (
        Ordered(marked.unionByName(other), names, ["_at", "_side", "_tie_right", "_tie_left"])
        .scan(_seen=RunningMax(F.col("_right")) if largest else RunningLast(F.col("_right")))
        .frame()
    )
    return scanned.filter(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col("_seen")[c].alias(c) for c in payload]
    )


def covered(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Add ``covered_until``: the latest end of the intervals of the same key that began at or before ``at``.

    A point lies in some interval exactly when that end is not before it, so
    overlap tests need no pairing of points with intervals.
    """
    slim = intervals.select(*keys, F.col(start).alias("_start"), F.col(end).alias("covered_until"))
    return asof(points, slim, keys, [at], ["_start"], ["covered_until"], largest=True)


def _struct_type(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns, F.lit(0).alias("_z")).alias("s")).schema["s"].dataType


def _payload_type(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType

"""Per-series time arithmetic: deltas, rates, percentages, top lists."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.functions.timing import as_micros, micros, seconds_between, time_bucket
from tidegauge.plans.groups import top_n
from tidegauge.plans.ordered import Ordered, Previous, RunningSum


def delta_encode(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first value of a series, then differences."""
    seen = Ordered(samples, keys, order).scan(_before=Previous(F.col("value"))).frame()
    return seen.withColumn("delta", F.col("value") - F.coalesce("_before", F.lit(0.0))).drop("_before")


def delta_decode(deltas: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running sum of deltas gives the values back."""
    return Ordered(deltas, keys, order).scan(value=RunningSum(F.col("delta"))).frame()


def counter_increase(counters: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Growth since the previous sample; after a reset the counter's new value is the growth.

    The first sample of a series has no growth and is left out.
    """
    seen = Ordered(counters, keys, order).scan(_v=Previous(F.col("value")), _t=Previous(F.col("ts"))).frame()
    change = F.col("value") - F.col("_v")
    return (
        seen.filter(F.col("_t").isNotNull())
        .withColumn("increase", F.when(change < 0, F.col("value")).otherwise(change))
        .withColumn("seconds", seconds_between(F.col("ts"), F.col("_t")))
        .drop("_v", "_t")
    )


def counter_rate(counters: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Growth per second of really elapsed time."""
    grown = counter_increase(counters, keys, order)
    return grown.withColumn("rate", F.try_divide(F.col("increase"), F.col("seconds")))


def increase_window(counters: DataFrame, keys: list[str], order: list[str], span: timedelta, every: timedelta) -> DataFrame:
    """Growth over a look-back ``span`` ending at each multiple of ``every``.

    ``span`` must be a multiple of ``every``.  Growth is first summed into
    panes one ``every`` wide; a window is a sum over the panes of its span.
    Rows are added only for windows that end where there is no pane, so a series
    with samples in every pane is not multiplied.
    """
    if as_micros(span) % as_micros(every):
        raise ValueError("span must be a multiple of every")
    copies = as_micros(span) // as_micros(every)
    panes = (
        counter_increase(counters, keys, order)
        .withColumn("_pane", time_bucket(F.col("ts"), every))
        .groupBy(*keys, "_pane")
        .agg(F.sum("increase").alias("_grown"), F.count(F.lit(1)).alias("_n"))
    )
    pane, width = micros(F.col("_pane")), F.lit(as_micros(every))
    following = F.lead(pane).over(Window.partitionBy(*keys).orderBy("_pane"))
    empty = F.least(F.coalesce((following - pane) / width, F.lit(copies)).cast("int") - 1, F.lit(copies - 1))
    ends = (
        panes.withColumn("_empty", empty)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_empty"))))
        .withColumns({"_at": pane + width * F.col("_i"), "window_end": F.col("_pane") + F.lit(every) * (F.col("_i") + 1)})
    )
    covered = Window.partitionBy(*keys).orderBy("_at").rangeBetween(as_micros(every) - as_micros(span), 0)
    own = F.col("_i") == 0
    return ends.select(
        *keys,
        "window_end",
        F.sum(F.when(own, F.col("_grown"))).over(covered).alias("increase"),
        F.sum(F.when(own, F.col("_n"))).over(covered).alias("samples"),
        (F.col("window_end") - F.lit(span)).alias("window_start"),
    )


def rate_window(counters: DataFrame, keys: list[str], order: list[str], span: timedelta, every: timedelta) -> DataFrame:
    """Per-second growth over the look-back span, without extrapolation to its edges."""
    grown = increase_window(counters, keys, order, span, every)
    return grown.withColumn("rate", F.col("increase") / F.lit(as_micros(span) / 1e6))


# The ten time states whose sum is total CPU time.
CPU_STATES = ("user", "system", "nice", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice")
REPORTED_STATES = ("user", "system", "idle", "iowait")


def cpu_percent(times: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Share of each reported state in the CPU time that passed since the previous sample."""
    present = [s for s in CPU_STATES if s in times.columns]
    total = sum((F.col(s) for s in present[1:]), F.col(present[0]))
    scans = {f"_{s}": Previous(F.col(s)) for s in REPORTED_STATES}
    wanted = times.select(*keys, *order, *REPORTED_STATES, total.alias("_total"))
    seen = Ordered(wanted, keys, order).scan(_before=Previous(F.col("_total")), **scans).frame()
    passed = F.col("_total") - F.col("_before")
    shares = [(100 * (F.col(s) - F.col(f"_{s}")) / passed).alias(f"{s}_percent") for s in REPORTED_STATES]
    return seen.filter(passed > 0).select(*keys, *order, *shares)


def rate_of_change(samples: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Change per second against the sample ``rows`` earlier."""
    seen = Ordered(samples, keys, order).scan(_v=Previous(F.col("value"), rows), _t=Previous(F.col("ts"), rows)).frame()
    change = F.try_divide(F.col("value") - F.col("_v"), seconds_between(F.col("ts"), F.col("_t")))
    return seen.filter(F.col("_t").isNotNull()).withColumn("change_per_second", change).drop("_v", "_t")


def top_k(points: DataFrame, k: int, tie: list[str]) -> DataFrame:
    """The k largest values of every step, ranked."""
    order = [F.col("value").desc(), *[F.col(c) for c in tie]]
    return top_n(points, ["bucket"], order, k, "rank")

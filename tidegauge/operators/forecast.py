"""Linear trend plus hour-of-day pattern per series.

The whole model comes from one aggregation: per series and hour of day the
count, means, variances and covariance of (index, value) are enough to derive
the least-squares line, the hourly residual means and the residual variance.
After the map side that is at most 24 rows per series and task, however long
the series is.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.timing import utc_hour
from tidegauge.operators.select import newest_per_group
from tidegauge.plans.ordered import Ordered, RunningSum

# Least points, variance floor, interval width, points kept.
MIN_POINTS = 10
MIN_VARIANCE = 0.01
Z_95 = 1.96
KEPT_POINTS = 1000


def recent(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The points an updated model is refitted on."""
    return newest_per_group(points, keys, [F.col(c).desc() for c in order], KEPT_POINTS)


def fit(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """slope, intercept, season (24 hourly values summing to zero), variance, n, last_ts per series."""
    indexed = Ordered(points, keys, order).scan(_i=RunningSum(F.lit(1))).frame().withColumn("x", F.col("_i") - 1.0)
    x, y = F.col("x"), F.col("value")
    hourly = indexed.groupBy(*keys, utc_hour(F.col("ts"), dict(points.dtypes)["ts"]).alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"),
        F.covar_pop(x, y).alias("cxy"),
        F.max("ts").alias("last_ts"),
    )
    # From here on there are at most 24 rows per series.
    series = Window.partitionBy(*keys)
    n, slope, intercept = F.col("n"), F.col("slope"), F.col("intercept")

    def total(term: Column) -> Column:
        return F.sum(term).over(series)

    means = hourly.withColumns({"rows": total(n), "mean_x": total(n * F.col("mx")), "mean_y": total(n * F.col("my"))})
    means = means.withColumns({c: F.col(c) / F.col("rows") for c in ("mean_x", "mean_y")})
    dx, dy = F.col("mx") - F.col("mean_x"), F.col("my") - F.col("mean_y")
    # Within-hour plus between-hour parts of the total variance and covariance.
    spread = means.withColumns({"sxx": total(n * (F.col("vx") + dx * dx)), "sxy": total(n * (F.col("cxy") + dx * dy))})
    line = spread.withColumn("slope", F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)))
    line = line.withColumn("intercept", F.col("mean_y") - slope * F.col("mean_x"))
    left = F.col("my") - intercept - slope * F.col("mx")
    inside = n * (F.col("vy") - 2 * slope * F.col("cxy") + slope * slope * F.col("vx"))
    hours = {f"h{i}": F.coalesce(F.max(F.when(F.col("h") == i, F.col("left"))), F.lit(0.0)) for i in range(24)}
    model = line.withColumn("left", left).groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.max("last_ts").alias("last_ts"),
        F.first("slope").alias("slope"),
        F.first("intercept").alias("intercept"),
        (F.sum("left") / 24.0).alias("centre"),
        (F.sum(inside) / F.sum(n)).alias("inside"),
        *[value.alias(name) for name, value in hours.items()],
    )
    centre = F.col("centre")
    return model.filter(n >= MIN_POINTS).select(
        *keys,
        "n",
        "last_ts",
        "slope",
        "intercept",
        F.array(*[F.col(h) - centre for h in hours]).alias("season"),
        # What is left of each hour's residual mean after the season is the centre itself.
        F.greatest(F.col("inside") + centre * centre, F.lit(MIN_VARIANCE)).alias("variance"),
    )


def predict(model: DataFrame, keys: list[str], periods: int, interval: timedelta, origin: str = "end") -> DataFrame:
    """Next ``periods`` values with 95 % bounds.

    The line continues after the last point; ``origin='start'`` evaluates it at
    1, 2, … instead.
    """
    h = F.col("step")
    x = h if origin == "start" else F.col("n") - 1 + h
    ahead = model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    timed = ahead.withColumn("ts", F.col("last_ts") + F.lit(interval) * h)
    value = F.col("intercept") + F.col("slope") * x + F.get(F.col("season"), utc_hour(F.col("ts"), dict(timed.dtypes)["ts"]))
    margin = F.lit(Z_95) * F.sqrt(F.col("variance") * h)
    return timed.select(
        *keys, "step", "ts", value.alias("value"), (value - margin).alias("lower"), (value + margin).alias("upper")
    )

"""Anomaly detection and forecasting."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidegauge import fixtures as fx
from tidegauge.operators import anomaly as an, detectors, forecast as fc, forest as fo
from tidegauge.workload.registry import METRICS, q6, query

ORDER = ["ts", "event_id"]
LIMIT = 2.0


def q6cols(df, *columns):
    return df.withColumns({c: fx.comparable(F.col(c)) for c in columns})


ZMODEL = f"{METRICS}, z AS (SELECT name, node, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS stddev FROM m GROUP BY 1, 2 HAVING count(*) >= 10)"


@query(f"WITH {ZMODEL} SELECT name, node, n, {q6('mean')} AS mean, {q6('stddev')} AS stddev FROM z")
def zscore_train(spark, folder):
    return q6cols(an.zscore_train(fx.metrics(spark, folder), fx.KEYS), "mean", "stddev")


@query(
    f"""WITH {ZMODEL} SELECT event_id, CASE WHEN stddev = 0 THEN value <> mean ELSE abs((value - mean) / stddev) > 2 END AS is_anomaly,
    {q6("CASE WHEN stddev = 0 THEN 0 ELSE abs((value - mean) / stddev) / 2 END")} AS score FROM m JOIN z USING (name, node)"""
)
def zscore_detect(spark, folder):
    samples = fx.metrics(spark, folder)
    scored = an.zscore_detect(samples, an.zscore_train(samples, fx.KEYS), fx.KEYS, LIMIT)
    return q6cols(scored.select("event_id", "is_anomaly", "score"), "score")


@query(
    f"""WITH {METRICS}, p AS (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS stddev FROM m
      WINDOW w AS (PARTITION BY name, node ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, n, abs((value - mean) / stddev) > 2 AS is_anomaly, {q6("abs((value - mean) / stddev) / 2")} AS score FROM p WHERE n >= 10"""
)
def zscore_online(spark, folder):
    scored = an.zscore_online(fx.metrics(spark, folder), fx.KEYS, ORDER, LIMIT)
    return q6cols(scored.select("event_id", "n", "is_anomaly", "score"), "score")


EWMA = f"""RECURSIVE {METRICS}, o AS (SELECT name, node, event_id, ts, value, row_number() OVER (PARTITION BY name, node ORDER BY ts, event_id) AS r FROM m),
  ew AS (SELECT name, node, event_id, r, value, CAST(NULL AS DOUBLE) AS mean_before, CAST(NULL AS DOUBLE) AS var_before,
      value AS mean_after, CAST(0 AS DOUBLE) AS var_after FROM o WHERE r = 1
    UNION ALL SELECT o.name, o.node, o.event_id, o.r, o.value, ew.mean_after, ew.var_after, 0.2 * o.value + 0.8 * ew.mean_after,
      0.2 * (o.value - ew.mean_after) * (o.value - ew.mean_after) + 0.8 * ew.var_after
    FROM ew JOIN o ON o.name = ew.name AND o.node = ew.node AND o.r = ew.r + 1)"""


def _states(spark, folder):
    return an.ewma_states(fx.metrics(spark, folder), fx.KEYS, ORDER)


@query(f"WITH {EWMA} SELECT name, node, max(r) AS n, {q6('arg_max(mean_after, r)')} AS mean, {q6('arg_max(var_after, r)')} AS variance FROM ew GROUP BY 1, 2")
def ewma_train(spark, folder):
    return q6cols(an.ewma_train(_states(spark, folder), fx.KEYS, ORDER), "mean", "variance")


@query(
    f"""WITH {EWMA} SELECT event_id, {q6("mean_before")} AS mean_before, {q6("CASE WHEN var_before > 0 THEN abs(value - mean_before) / (3 * sqrt(var_before)) WHEN value <> mean_before THEN 1 ELSE 0 END")} AS score,
    value > mean_before + 3 * sqrt(var_before) OR value < mean_before - 3 * sqrt(var_before) AS is_anomaly FROM ew WHERE mean_before IS NOT NULL"""
)
def ewma_detect(spark, folder):
    judged = an.ewma_detect(_states(spark, folder))
    return q6cols(judged.select("event_id", "mean_before", "score", "is_anomaly"), "mean_before", "score")


@query(
    f"""WITH {EWMA}, f AS (SELECT name, node, arg_max(mean_after, r) AS mean, sqrt(arg_max(var_after, r)) AS sd FROM ew GROUP BY 1, 2)
    SELECT name, node, {q6("mean")} AS mean, {q6("sd")} AS stddev, {q6("mean - 3 * sd")} AS lower, {q6("mean + 3 * sd")} AS upper FROM f"""
)
def ewma_bounds(spark, folder):
    bounds = an.ewma_bounds(an.ewma_train(_states(spark, folder), fx.KEYS, ORDER))
    return q6cols(bounds.select("name", "node", "mean", "stddev", "lower", "upper"), "mean", "stddev", "lower", "upper")


def _forest(samples):
    return fo.fit(samples, fx.KEYS, fx.TIE)


@query()
def iforest_train(spark, folder):
    return _forest(fx.metrics(spark, folder))


@query()
def iforest_score(spark, folder):
    samples = fx.metrics(spark, folder)
    slim = samples.select(*fx.KEYS, "event_id", "value")
    return fo.score(slim, _forest(samples), fx.KEYS, fx.TIE).select("event_id", "score", "is_anomaly")


@query(
    f"""WITH {METRICS} SELECT event_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS r FROM m)
    WHERE r <= 2560"""
)
def iforest_update(spark, folder):
    return fo.retained(fx.metrics(spark, folder).select("event_id", "name", "ts", "value"), ["name"], ORDER).drop("ts")


@query(
    f"""WITH {ZMODEL}, d AS (
      SELECT event_id, 0.6 AS weight, abs((value - mean) / stddev) / 2 AS score, abs((value - mean) / stddev) > 2 AS flag FROM m JOIN z USING (name, node)
      UNION ALL SELECT event_id, 0.4, CASE WHEN usr <> 'user-7' THEN 0 END, value > 200 FROM m),
    s AS (SELECT event_id, weight, CASE WHEN flag AND score = 0 THEN 1 ELSE score END AS score FROM d WHERE score IS NOT NULL)
    SELECT event_id, {q6("sum(score * weight) / sum(weight)")} AS score, sum(score * weight) / sum(weight) > 0.5 AS is_anomaly, count(*) AS detectors FROM s GROUP BY 1"""
)
def multi_detect(spark, folder):
    """A z-score with weight 0.6 and a plain limit with 0.4 that cannot judge one user's samples."""
    samples = fx.metrics(spark, folder)
    zscore = an.zscore_detect(samples, an.zscore_train(samples, fx.KEYS), fx.KEYS, LIMIT).withColumn("weight", F.lit(0.6))
    plain = samples.withColumns(
        {"score": F.when(F.col("usr") != "user-7", F.lit(0.0)), "is_anomaly": F.col("value") > 200, "weight": F.lit(0.4)}
    )
    columns = ["event_id", "weight", "score", "is_anomaly"]
    return q6cols(an.multi_detect(zscore.select(columns).unionByName(plain.select(columns)), ["event_id"], 0.5), "score")


@query(
    f"""WITH {ZMODEL}, x AS (SELECT name, min(value) AS low, max(value) AS high FROM m WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1),
    zt AS (SELECT name, node, avg(value) AS mean, stddev_pop(value) AS stddev FROM m WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2 HAVING count(*) >= 10),
    t AS (SELECT * FROM m WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'),
    s AS (SELECT event_id, 0.7 AS weight, abs((value - mean) / stddev) / 2 AS score FROM t JOIN zt USING (name, node)
      UNION ALL SELECT event_id, 0.3, CASE WHEN value < low OR value > high THEN 1 ELSE 0 END FROM t JOIN x USING (name))
    SELECT event_id, {q6("sum(score * weight) / sum(weight)")} AS score, sum(score * weight) / sum(weight) > 1 AS is_anomaly, count(*) AS detectors FROM s GROUP BY 1"""
)
def detector_plugin(spark, folder):
    samples = fx.metrics(spark, folder)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    chosen = [(detectors.ZScore(fx.KEYS, LIMIT), 0.7), (detectors.SeenRange(["name"]), 0.3)]
    combined = an.run_detectors(samples.filter(F.col("ts") < cut), samples.filter(F.col("ts") >= cut), chosen, ["event_id"], 1.0)
    return q6cols(combined, "score")


@query()
def default_ensemble(spark, folder):
    """The weighted average and the forest at their default weights, trained before the cut and asked after it."""
    samples = fx.metrics(spark, folder)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    pair = {"ewma": detectors.Ewma(fx.KEYS, ORDER), "forest": detectors.Forest(fx.KEYS, fx.TIE)}
    chosen = [(pair[name], weight) for name, weight in an.ENSEMBLE_WEIGHTS.items()]
    return an.run_detectors(samples.filter(F.col("ts") < cut), samples.filter(F.col("ts") >= cut), chosen, ["event_id"], fo.LIMIT)


MODEL = f"""{METRICS}, ix AS (SELECT *, row_number() OVER (PARTITION BY name, node ORDER BY ts, event_id) - 1 AS x FROM m),
  tr AS (SELECT name, node, count(*) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, max(ts) AS last_ts FROM ix GROUP BY 1, 2 HAVING count(*) >= 10),
  rs AS (SELECT ix.name, ix.node, hour(ts) AS h, ts, value - intercept - slope * x AS res FROM ix JOIN tr USING (name, node)),
  hm AS (SELECT name, node, h, avg(res) AS res FROM rs GROUP BY 1, 2, 3),
  grid AS (SELECT name, node, unnest(range(0, 24)) AS h FROM tr),
  se AS (SELECT name, node, g.h, coalesce(hm.res, 0) - avg(coalesce(hm.res, 0)) OVER (PARTITION BY name, node) AS season FROM grid g LEFT JOIN hm USING (name, node, h)),
  va AS (SELECT rs.name, rs.node, greatest(avg((res - season) * (res - season)), 0.01) AS variance FROM rs JOIN se USING (name, node, h) GROUP BY 1, 2)"""


def _model(spark, folder):
    return fc.fit(fx.metrics(spark, folder), fx.KEYS, ORDER)


@query(f"WITH {MODEL} SELECT name, node, n, {q6('slope')} AS slope, {q6('intercept')} AS intercept FROM tr")
def fc_trend(spark, folder):
    return q6cols(_model(spark, folder).select("name", "node", "n", "slope", "intercept"), "slope", "intercept")


@query(f"WITH {MODEL} SELECT name, node, CAST(h AS BIGINT) AS hour, {q6('season')} AS season FROM se")
def fc_seasonality(spark, folder):
    rows = _model(spark, folder).select("name", "node", F.posexplode("season").alias("hour", "season"))
    return q6cols(rows.withColumn("hour", F.col("hour").cast("bigint")), "season")


@query(f"WITH {MODEL} SELECT name, node, {q6('variance')} AS variance FROM va")
def fc_variance(spark, folder):
    return q6cols(_model(spark, folder).select("name", "node", "variance"), "variance")


PREDICT = f"""{MODEL}, ah AS (SELECT name, node, n, slope, intercept, CAST(step AS BIGINT) AS step, last_ts + step * INTERVAL 1 HOUR AS ts
    FROM (SELECT *, unnest(range(1, 25)) AS step FROM tr)),
  pr AS (SELECT ah.name, ah.node, step, ah.ts, intercept + slope * (n - 1 + step) + season AS value, 1.96 * sqrt(variance * step) AS margin
    FROM ah JOIN se ON se.name = ah.name AND se.node = ah.node AND se.h = hour(ah.ts) JOIN va ON va.name = ah.name AND va.node = ah.node)"""


@query(f"WITH {PREDICT} SELECT name, node, step, ts, {q6('value')} AS value, {q6('value - margin')} AS lower, {q6('value + margin')} AS upper FROM pr")
def fc_predict(spark, folder):
    ahead = fc.predict(_model(spark, folder), fx.KEYS, 24, timedelta(hours=1))
    return q6cols(ahead.withColumn("step", F.col("step").cast("bigint")), "value", "lower", "upper")


@query(
    f"""WITH {METRICS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS r FROM m) WHERE r <= 1000),
    ix AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) - 1 AS x FROM l)
    SELECT name, count(*) AS n, {q6("regr_slope(value, x)")} AS slope, {q6("regr_intercept(value, x)")} AS intercept FROM ix GROUP BY 1"""
)
def fc_update(spark, folder):
    kept = fc.recent(fx.metrics(spark, folder), ["name"], ORDER)
    return q6cols(fc.fit(kept, ["name"], ORDER).select("name", "n", "slope", "intercept"), "slope", "intercept")

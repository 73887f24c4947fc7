"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
Every result is written in full to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from tidegauge import fixtures as fx  # noqa: E402
from tidegauge.operators import aggregate, alerting, anomaly, forecast, series, vectors  # noqa: E402
from tidegauge.workload import QUERIES  # noqa: E402

# Registered queries timed next to the line item ones.
HEADLINES = (
    "range_query downsample_pairwise downsample_avg counter_rate rate_window cpu_percent topk annotation_overlay event_correlation "
    "alert_resolve ruleset_system alert_cooldown health_check session_timeout metric_upsert json_decode zscore_detect zscore_online "
    "ewma_detect iforest_train iforest_score fc_predict compact_range stream_downsample stream_alerts"
).split()

KEYS, TIE = ["name", "node"], ["l_orderkey", "l_linenumber"]
ORDER = ["ts", *TIE]
MONTH = timedelta(days=28)


def line_item_queries():
    """The series operators over ``lineitem`` taken as samples."""
    return {
        "li_pairwise": lambda s: aggregate.downsample_pairwise(s, KEYS, MONTH, TIE),
        "li_mean": lambda s: aggregate.downsample_mean(s, KEYS, MONTH),
        "li_delta": lambda s: series.delta_encode(s, KEYS, ORDER),
        "li_rate": lambda s: series.counter_rate(s, KEYS, ORDER),
        "li_alerts": lambda s: alerting.alerts(s, KEYS, TIE, F.col("value") > 50_000, F.lit(timedelta(days=30))),
        "li_ewma": lambda s: anomaly.ewma_detect(anomaly.ewma_states(s, KEYS, ORDER)),
        "li_zscore": lambda s: anomaly.zscore_detect(s, anomaly.zscore_train(s, KEYS), KEYS),
        "li_forecast": lambda s: forecast.predict(forecast.fit(s, KEYS, ORDER), KEYS, 24, timedelta(hours=1)),
        "li_scale": lambda s: aggregate.minmax_scale(s, KEYS),
        "li_paired": lambda s: vectors.paired(s, ["A", "N", "R"], ["node"], MONTH, TIE),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    fx.metrics(spark, folder).write.format("noop").mode("overwrite").save()

    runs = {name: lambda q=QUERIES[name]: q(spark, folder) for name in HEADLINES}
    runs |= {name: lambda q=q: q(fx.line_items(spark, folder)) for name, q in line_item_queries().items()}
    seconds = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {"metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec"}
    print(json.dumps({**result, "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

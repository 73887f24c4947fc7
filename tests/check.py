"""Run registered queries against their SQL: python tests/check.py FOLDER [key ...]

ROWS_PER_TASK=100 makes almost every series count as hot, to check the split plans.
"""

import os
import signal
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))

from comparison import oracle_connection, oracle_rows, spark_rows
from pyspark.sql import SparkSession

import __spark_entry__ as entry_points


def _too_long(*_):
    raise TimeoutError("query took too long")


def main(folder, keys):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE", "8"))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("ROWS_PER_TASK"):
        spark.conf.set("spark.tidegauge.rowsPerTask", os.environ["ROWS_PER_TASK"])
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    signal.signal(signal.SIGALRM, _too_long)
    for key in keys or queries:
        start = time.time()
        signal.alarm(int(os.environ.get("LIMIT", "90")))
        try:
            df = queries[key](spark, folder)
            got = spark_rows(df)
            took = time.time() - start
            if key not in oracles:
                print(f"rows {key} {len(got)} {took:.2f}s", flush=True)
                continue
            names, want = oracle_rows(oracle_connection(folder), oracles[key])
            if sorted(df.columns) != names:
                bad += 1
                print(f"BAD  {key} columns {sorted(df.columns)} vs {names}", flush=True)
            elif got != want:
                bad += 1
                extra, missing = set(got) - set(want), set(want) - set(got)
                print(f"BAD  {key} {len(got)} vs {len(want)} only-spark {sorted(extra)[:3]} only-sql {sorted(missing)[:3]}", flush=True)
            else:
                print(f"ok   {key} {len(got)} {took:.2f}s", flush=True)
        except Exception as error:  # report and go on
            bad += 1
            print(f"BAD  {key} {str(error)[:700]}", flush=True)
            if keys:
                traceback.print_exc()
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_everything(spark):
    """Settings under which almost every key counts as too long for one task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.tidegauge.rowsPerTask", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    yield
    spark.conf.unset("spark.tidegauge.rowsPerTask")
    spark.conf.set("spark.sql.shuffle.partitions", before)

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """Named arrays to an indexed frame."""
    def make(arrays, col="close", **more):
        rows = []
        for name, xs in arrays.items():
            for i, x in enumerate(xs):
                rows.append((name, "1d", i, len(xs), None if x is None or x != x else float(x)))
        return spark.createDataFrame(rows, f"ticker string, timeframe string, idx long, n long, {col} double")
    return make


@pytest.fixture
def values():
    """Column of one series, in index order."""
    def get(df, col="filtered", ticker=None):
        rows = df.where(df.ticker == ticker) if ticker else df
        return [r[0] for r in rows.orderBy("ticker", "idx").select(col).collect()]
    return get

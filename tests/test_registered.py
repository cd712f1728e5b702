"""A part of the registered queries against their SQL (tools/compare.py runs all)."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare

SF = "/root/testdata/sf0.001"
PART = ["flagship", "bars_60m", "bars_calendar", "valid_close", "calendar_flag", "data_health", "fingerprint", "merge_bars", "filter_gaussian",
        "filter_kalman", "filter_savgol", "trigger", "trades", "masked_trades", "xcorr_lag", "walk_forward", "stream_bars", "stream_signal"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", PART)
def test_query(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    res = compare(got, duck.execute(oracle_sql()[name]).df())
    assert res.startswith("ok"), res


def test_entry(spark):
    assert entry(spark).count() == 5
    assert set(oracle_sql()) <= set(queries())

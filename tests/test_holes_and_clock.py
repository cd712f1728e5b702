"""Missing values give one answer at every chunk size; clocks don't follow the session's zone."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebars.functions.scalars import clock_micros, julian_day, start_of
from tidebars.operators import quality as Q
from tidebars.operators.extensions import dema
from tidebars.operators.filters import apply_filter
from tidebars.operators.lowess import lowess
from tidebars.operators.metrics import xcorr_lag
from tidebars.sources.bars import bar_start
from tidebars.streaming import live as L

FILTERS = [("sma", {"window": 11}), ("ema", {"span": 5}), ("ema", {"span": 100}), ("wma", {"window": 11}), ("alma", {"window": 21}), ("kalman", {}),
           ("butterworth", {"cutoff": 0.15}), ("gaussian", {"sigma": 2.0}), ("median", {"window": 5})]


def walk(n=1200, seed=3):
    return np.cumsum(np.random.RandomState(seed).randn(n)) + 50


@pytest.mark.parametrize("holes", ["one", "most", "run"])
@pytest.mark.parametrize("fid,params", FILTERS)
def test_chunks_agree_with_whole_series(series, values, fid, params, holes):
    x = walk()
    if holes == "one":
        x[700] = np.nan
    elif holes == "most":
        x[np.arange(len(x)) % 15 != 0] = np.nan
    else:
        x[200:500] = np.nan
    df = series({"a": x})
    whole, cut = values(apply_filter(df, fid, params, chunk_rows=None)), values(apply_filter(df, fid, params, chunk_rows=128))
    assert [v is None for v in whole] == [v is None for v in cut]
    assert np.allclose([v for v in whole if v is not None], [v for v in cut if v is not None], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("span", [2, 5, 100, 5000])
@pytest.mark.parametrize("chunk_rows", [None, 64])
def test_ema_with_holes_is_the_pandas_mean(series, values, span, chunk_rows):
    x = walk(3000)
    x[np.arange(3000) % 15 != 4] = np.nan
    want = pd.Series(x).ewm(span=span, adjust=False).mean()
    got = pd.Series(values(apply_filter(series({"a": x}), "ema", {"span": span}, chunk_rows=chunk_rows)), dtype=float)
    assert np.allclose(want, got, rtol=1e-9, equal_nan=True)
    twice = want.ewm(span=span, adjust=False).mean()
    got = pd.Series(values(dema(series({"a": x}), span, chunk_rows=chunk_rows), "dema"), dtype=float)
    if span < 5000:
        assert np.allclose(2 * want - twice, got, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("passes", [0, 3])
def test_lowess_leaves_missing_rows_out_at_every_length(series, values, passes):
    x = walk(1500)
    x[[0, 700, 701, 1499]] = np.nan
    p = {"frac": 0.05, "passes": passes}
    short, long = (values(lowess(series({"a": x}), params=p, short_rows=s)) for s in (4096, 100))
    seen = values(lowess(series({"a": x[~np.isnan(x)]}), params=p))
    for got in (short, long):
        assert [v is None or v != v for v in got] == list(np.isnan(x))
        assert np.allclose([v for v in got if v is not None and v == v], seen, rtol=1e-6)


def test_lag_leaves_missing_rows_out(spark):
    x = walk(400)
    rows = [("a", "1d", i, 400, float(x[i]) if i != 200 else None, float(x[i - 3]) if i >= 3 else None) for i in range(400)]
    rows += [("b", "1d", i, 2, 1.0, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "ticker string, timeframe string, idx long, n long, noisy double, filtered double")
    assert {r.ticker: r.lag for r in xcorr_lag(df).collect()} == {"a": 3, "b": 0}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Shanghai"])
def test_clock_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stamps = [dt.datetime(2024, 3, 10, 2, 30, 15, 250000), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 3, 10), dt.datetime(1969, 12, 31, 23, 59, 59, 1)]
        df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp_ntz")
        units = ["minute", "hour", "day", "week", "month", "quarter", "year"]
        text = lambda c: c.cast("string")
        rows = df.select(clock_micros(F.col("ts")).alias("m"), julian_day(F.col("ts")).alias("j"), text(bar_start(F.col("ts"), "15m")).alias("q"),
                         *[text(start_of(u, F.col("ts"))).alias(u) for u in units]).collect()
        for t, r in zip(stamps, rows):
            assert r["m"] == (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            assert r["hour"] == t.strftime("%Y-%m-%d %H:00:00") and r["day"] == t.strftime("%Y-%m-%d 00:00:00")
            assert r["week"] == (t - dt.timedelta(days=t.weekday())).strftime("%Y-%m-%d 00:00:00") and r["month"] == t.strftime("%Y-%m-01 00:00:00")
            assert r["q"] == t.replace(minute=t.minute // 15 * 15).strftime("%Y-%m-%d %H:%M:00")
        hours = [dt.datetime(2024, 3, 9) + dt.timedelta(hours=h) for h in range(72)] + [dt.datetime(2024, 11, 2) + dt.timedelta(hours=h) for h in range(72)]
        bars = spark.createDataFrame([("a", "60m", t, 1.0) for t in hours], "ticker string, timeframe string, ts timestamp_ntz, close double")
        assert Q.gap_count(bars).first()["gaps"] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_merge_without_arrival_is_the_same_each_time(spark):
    schema = "ticker string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    t = dt.datetime(2024, 1, 1)
    batch = [("a", "1d", t, float(k), 9.0, 0.0, float(k), 1.0) for k in range(50)]
    got = {Q.merge_bars(spark.createDataFrame([], schema), spark.createDataFrame(batch[::s], schema).repartition(7)).first()["close"] for s in (1, -1)}
    assert got == {0.0}


def test_late_day_rewrites_its_week_and_spoils_no_other(spark, tmp_path):
    schema = "ticker string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    day = lambda t: ("a", "1d", t, 1.0, 1.0, 1.0, 1.0, 1.0)
    days = [dt.datetime(2024, 10, 1) + dt.timedelta(days=k) for k in range(184)]
    late = dt.datetime(2024, 11, 13)
    sink, path = L.rollup_sink(str(tmp_path / "t")), str(tmp_path / "t")
    sink(spark.createDataFrame([day(t) for t in days if t != late], schema), 0)
    sink(spark.createDataFrame([day(late)], schema), 1)
    stored = L.read_partitioned(spark, f"{path}/bars")
    for tf, start in (("1wk", lambda t: t - dt.timedelta(days=t.weekday())), ("1mo", lambda t: t.replace(day=1))):
        want = {}
        for t in days:
            want[start(t)] = want.get(start(t), 0) + 1.0
        assert {r["ts"]: r["volume"] for r in stored.where(F.col("timeframe") == tf).collect()} == want

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import align as A
from tidebars.operators import extensions as E
from tidebars.operators import metrics as M
from tidebars.operators import spectrum as SP


def stamped(spark, rows, schema):
    return spark.createDataFrame(rows, schema.replace("ts timestamp_ntz", "ts string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def levels(spark):
    day = stamped(spark, [("a", "1d", i, f"2024-01-0{i + 1} 00:00:00", 100.0 + 5 * i, 100.0) for i in range(3)],
                  "ticker string, timeframe string, idx long, ts timestamp_ntz, long_pnl double, short_pnl double")
    hours = ["2024-01-01 09:30", "2024-01-01 10:30", "2024-01-02 09:30", "2024-01-02 10:30", "2024-01-03 09:30"]
    low = stamped(spark, [("a", "60m", i, h) for i, h in enumerate(hours)], "ticker string, timeframe string, idx long, ts timestamp_ntz")
    return day, low


def test_forward_fill(spark):
    day, low = levels(spark)
    got = [r.aligned_long for r in A.align_pnl(low, day).orderBy("idx").collect()]
    assert got == [100, 100, 105, 105, 110]
    closed = [r.aligned_long for r in A.align_pnl(low, day, mode="closed").orderBy("idx").collect()]
    assert closed == [None, None, 100, 100, 105]
    assert [r.aligned_long for r in A.align_pnl(low, day.where("false")).collect()] == [None] * 5


def test_markers(spark):
    day, low = levels(spark)
    trades = spark.createDataFrame([("a", "1d", 1, "long", 1, 2, 5.0, "take_profit"), ("a", "1d", 2, "short", 0, 9, 1.0, "eod")],
                                   "ticker string, timeframe string, id int, type string, entry_idx long, exit_idx long, return_pct double, exit_reason string")
    m = A.events_to_bars(trades, day, A.align_pnl(low, day)).collect()
    assert {(r.kind, r.bar_idx, r.pnl) for r in m} == {("entry", 1, 100.0), ("exit", 3, 105.0)}


@pytest.mark.parametrize("chunk_rows", [None, 8])
def test_masks_and_aligned_curve(spark, chunk_rows):
    marks = [("a", "1d", "long", "entry", 10), ("a", "1d", "long", "exit", 10), ("a", "1d", "long", "exit", 30), ("a", "1d", "short", "entry", 30)]
    markers = spark.createDataFrame(marks, "ticker string, timeframe string, side string, kind string, bar_idx long")
    n = 40
    rng = np.random.RandomState(0)
    long, short = 100 + np.cumsum(rng.rand(n)), 100 - np.cumsum(rng.rand(n))
    bars = spark.createDataFrame([("a", "1d", i, n, float(long[i]), float(short[i])) for i in range(n)],
                                 "ticker string, timeframe string, idx long, n long, long_pnl double, short_pnl double")
    counts = spark.createDataFrame([("a", "1d", n)], "ticker string, timeframe string, n long")
    holds = A.next_exit(markers, counts, chunk_rows=chunk_rows)
    assert {(r.side, r.entry_bar, r.exit_bar) for r in holds.collect()} == {("long", 10, 30), ("short", 30, 39)}
    masks = A.holding_masks(bars, holds, chunk_rows=chunk_rows).cache()
    assert [r.idx for r in masks.where("long_mask").orderBy("idx").collect()] == list(range(10, 31))
    assert [r.idx for r in masks.where("short_mask").orderBy("idx").collect()] == list(range(30, 40))
    got = A.aligned_equity(masks, chunk_rows=chunk_rows).orderBy("idx").collect()
    want = [100.0]
    for i in range(1, n):
        want.append(want[-1] * long[i] / long[i - 1] if 10 <= i <= 30 else want[-1])
    assert np.allclose([r.long_filtered for r in got], want)
    trades = spark.createDataFrame([("a", "1d", 1, "long", 5, 12, "take_profit"), ("a", "1d", 2, "long", 31, 35, "eod"), ("a", "1d", 3, "short", 25, 39, "eod")],
                                   "ticker string, timeframe string, id int, type string, entry_idx long, exit_idx long, exit_reason string")
    hit = {r.id: (r.entry_masked, r.exit_masked) for r in A.masked_trades(trades, masks, chunk_rows=chunk_rows).collect()}
    assert hit == {1: (False, True), 3: (False, False)}


def test_asof_with_one_hot_key(spark):
    rng = np.random.RandomState(1)
    left = [("hot" if i % 3 else "cold", int(v)) for i, v in enumerate(rng.randint(0, 2000, 400))]
    right = [("hot" if i % 2 else "cold", int(v)) for i, v in enumerate(rng.choice(2000, 150, replace=False))]
    l_df = spark.createDataFrame(left, "k string, t long")
    r_df = spark.createDataFrame([(k, t, t * 10) for k, t in right], "k string, t long, v long")
    for exclusive in (False, True):
        got = sorted((r.k, r.t, r.v if r.v is not None else -1) for r in A.asof_backward(
            l_df, r_df, ["k"], "t", ["v"], F.floor(F.col("t") / 100), exclusive).collect())
        want = sorted((k, t, max((s * 10 for j, s in right if j == k and (s < t if exclusive else s <= t)), default=-1)) for k, t in left)
        assert got == want


def triple(spark, clean, noisy, filtered):
    n = len(clean)
    rows = [("a", "1d", i, n, *(None if x is None else float(x) for x in (clean[i], noisy[i], filtered[i]))) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, timeframe string, idx long, n long, clean double, noisy double, filtered double")


def test_error_metrics(spark):
    x = np.sin(np.arange(100) / 7)
    noisy = x + np.random.RandomState(2).randn(100) * 0.3
    m = M.error_metrics(triple(spark, x, noisy, x)).first()
    assert (m.mse, m.rmse, m.mae, m.snr_imp) == (0, 0, 0, 99)
    m = M.error_metrics(triple(spark, x, noisy, x + 1)).first()
    assert m.mse == pytest.approx(1) and m.rmse == pytest.approx(1) and m.mae == pytest.approx(1)
    m = M.error_metrics(triple(spark, x[:3], noisy[:3], [x[0], None, None])).first()
    assert m.mse is None and m.snr_imp is None


@pytest.mark.parametrize("shift", [0, 3, -5])
def test_lag_over_blocks(spark, shift):
    x = np.random.RandomState(3).randn(300)
    f = np.roll(x, shift)
    got = M.xcorr_lag(triple(spark, x, x, f), block=64).first().lag
    c = np.correlate(f - f.mean(), x - x.mean(), "full")
    assert got == np.argmax(c) - 299
    assert M.xcorr_lag(triple(spark, x, x, f), max_lag=10).first().lag == shift


def test_ranking(spark):
    rows = [("x", "s1", 1.0, 5.0), ("x", "s2", 3.0, 5.0), ("y", "s1", 2.0, 9.0), ("y", "s2", 2.0, 9.0), ("z", "s1", 4.0, 1.0), ("z", "s2", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "filter string, series string, mse double, snr_imp double")
    r = M.rank_filters(df, {"mse": False, "snr_imp": True}).orderBy("rank").collect()
    assert [x["filter"] for x in r] == ["y", "x", "z"] and r[0].composite == pytest.approx(1.0)
    best = {x.series: x["filter"] for x in M.best_filter(df, ["series"]).collect()}
    assert best == {"s1": "x", "s2": "y"}
    flat = M.minmax(df, {"mse": False}).where("filter = 'z'").first()
    assert flat.mse_norm == 0
    assert M.minmax(df.where("series = 's1' and filter = 'x'"), {"mse": True}).first().mse_norm == 1


def test_frequency_response(spark, series):
    x = np.random.RandomState(4).randn(64)
    y = np.convolve(x, np.ones(5) / 5, "same")
    df = series({"a": x}).join(series({"a": y}, "filtered"), ["ticker", "timeframe", "idx", "n"])
    got = [r.response for r in M.freq_response(df).orderBy("bin").collect()]
    assert np.allclose(got, np.abs(np.fft.rfft(y)) / (np.abs(np.fft.rfft(x)) + 1e-15))


@pytest.mark.parametrize("n", [1, 2, 30, 31, 49, 97, 128, 210])
def test_spectrum_in_two_steps(spark, n):
    """Lengths that split into blocks of 16, primes and others that don't."""
    rng = np.random.RandomState(n)
    x, y = rng.randn(n), rng.randn(n)
    rows = spark.createDataFrame([("a", i, n, float(x[i]), float(y[i])) for i in range(n)], "ticker string, idx long, n long, x double, y double").repartition(3)
    got = SP.spectrum(rows, ["ticker"], ["x", "y"], block=16).orderBy("bin").collect()
    assert [r["bin"] for r in got] == list(range(n))
    for v, want in (("x", np.fft.fft(x)), ("y", np.fft.fft(y))):
        assert np.allclose([complex(r[f"{v}_re"], r[f"{v}_im"]) for r in got], want)


def test_transform_rows_are_linear(spark, monkeypatch):
    made = []
    own = SP._step

    def counted(rows, *more, **options):
        out = own(rows, *more, **options)
        made.append((rows, out))
        return out

    monkeypatch.setattr(SP, "_step", counted)
    x = np.random.RandomState(1).randn(1000)
    assert M.xcorr_lag(triple(spark, x, x, np.roll(x, 2)), block=128).first().lag == 2
    # padded to 2,048 rows; a step has that many at most, however many lags there are
    assert len(made) == 4 and all(out.count() <= 2048 for _, out in made)


def test_impulse_lag(series):
    df = series({"a": np.zeros(400)})
    lag = lambda f, p: M.impulse_lag(df, f, p).first().lag
    assert lag("sma", {"window": 11}) == 5 and lag("gaussian", {"sigma": 2}) == 0
    assert lag("ema", {"alpha": 0.2}) == pytest.approx(4.0)
    assert lag("alma", {"window": 21}) == pytest.approx(15.99441, abs=1e-5)


def test_trend_and_cycle(series, values):
    y = np.cumsum(np.random.RandomState(5).randn(400))
    d = np.diff(np.eye(400), 2, axis=0)
    want = np.linalg.solve(np.eye(400) + 100 * d.T @ d, y)
    for chunk_rows in (None, 120):
        assert np.allclose(values(E.hp_filter(series({"a": y}), 100.0, chunk_rows=chunk_rows), "trend"), want, atol=1e-8)
    assert values(E.hp_filter(series({"a": [1.0, 2.0]}), 100.0), "trend") == [1.0, 2.0]


def test_bootstrap_is_repeatable(series):
    df = series({"a": np.arange(30.0)}).withColumn("filtered", F.col("close")).withColumn("residual", F.col("close") * 100)
    one = sorted(map(tuple, E.bootstrap(df, 5).collect()))
    assert one == sorted(map(tuple, E.bootstrap(df.repartition(7), 5).collect()))
    assert len(one) == 150 and len({r[-1] for r in one}) > 30


def test_samples(spark):
    a = spark.createDataFrame([("k", float(v)) for v in range(100)], "g string, x double")
    b = spark.createDataFrame([("k", float(v)) for v in range(50, 150)], "g string, x double")
    assert M.ks(a, b, "x", ["g"]).first().ks == pytest.approx(0.5)
    assert M.ks(a, a, "x", ["g"]).first().ks == 0
    assert M.psi(a, a, F.floor(F.col("x") / 10), ["g"]).first().psi == pytest.approx(0)
    assert M.psi(a, b, F.floor(F.col("x") / 10), ["g"]).first().psi > 0.25


def test_walk_forward_windows(spark):
    df = spark.sql("select 'a' ticker, '1d' timeframe, explode(sequence(timestamp_ntz'2020-01-01', timestamp_ntz'2021-03-31', interval 1 day)) ts")
    w = E.walk_forward(df)
    assert w.count() == 7
    rows = E.window_rows(df, w)
    part = {r.part: r["count"] for r in rows.where("train_start = timestamp_ntz'2020-01-01'").groupBy("part").count().collect()}
    assert part == {"train": 182, "test": 92}

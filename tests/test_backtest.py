import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import backtest as T
from tidebars.plans.analysis import Settings, analyse, sweep_summary, trade


def signal_frame(spark, data):
    rows = []
    for t, (price, sig) in data.items():
        for i, (p, s) in enumerate(zip(price, sig)):
            rows.append((t, "1d", i, len(price), None if np.isnan(p) else float(p), int(s)))
    return spark.createDataFrame(rows, "ticker string, timeframe string, idx long, n long, filtered double, sig int")


def brute(price, sig, stop, n_ext):
    """Pairs, vertex fits, trades and curves by plain loops."""
    n = len(price)
    ok = lambda i: not np.isnan(price[i]) and price[i] > 0
    starts, last = [], 0
    for i, s in enumerate(sig):
        if s != 0 and s != last:
            starts.append(i)
            last = s
    trades, cap = [], {"long": 100.0, "short": 100.0}
    curves = {k: np.full(n, 100.0) for k in cap}
    for s, e in zip(starts, starts[1:]):
        if e - s < 3:
            continue
        d = np.arange(s, e + 1) - e
        seg = price[s:e + 1]
        a = np.sum(d ** 2 * (seg - seg[-1])) / np.sum(d ** 4.0)
        if np.isnan(a):
            continue
        up = a * (n_ext - 1) ** 2 + price[e] > price[e]
        side = "long" if sig[e] == 1 and up else "short" if sig[e] == -1 and not up else None
        if side is None or not ok(e):
            continue
        out = None
        for i in range(e + 1, n):
            if not ok(i):
                continue
            pred = a * (i - e) ** 2 + price[e]
            if i <= e + n_ext and pred > 0:
                if (price[i] < pred * (1 - stop / 100)) if side == "long" else (price[i] > pred * (1 + stop / 100)):
                    out = (i, "stop_loss")
                    break
            if sig[i] == (-1 if side == "long" else 1):
                out = (i, "take_profit")
                break
        if out is None:
            if n - 1 <= e:
                continue
            out = (n - 1, "eod")
        x, why = out
        if not ok(x):
            continue
        sign = 1 if side == "long" else -1
        mark = price[e]
        for i in range(e, n):
            if i <= x:
                mark = price[i] if ok(i) else mark
                curves[side][i] = cap[side] * (1 + sign * (mark - price[e]) / price[e])
        cap[side] *= 1 + sign * (price[x] - price[e]) / price[e]
        curves[side][x + 1:] = cap[side]
        trades.append((side, e, x, why))
    return trades, curves


def check(spark, data, stop=2.0, n_ext=8, chunk_rows=None):
    s = Settings(stop_loss_pct=stop, n_ext=n_ext, chunk_rows=chunk_rows)
    a = trade(signal_frame(spark, data), s)
    got = {}
    for r in a.trades.orderBy("entry_idx").collect():
        got.setdefault(r.ticker, []).append((r.type, r.entry_idx, r.exit_idx, r.exit_reason))
    eq = a.equity.orderBy("idx").collect()
    for t, (price, sig) in data.items():
        want, curves = brute(np.asarray(price, float), sig, stop, n_ext)
        assert got.get(t, []) == want, t
        rows = [r for r in eq if r.ticker == t]
        assert np.allclose([r.long_pnl for r in rows], curves["long"]), t
        assert np.allclose([r.short_pnl for r in rows], curves["short"]), t
    return a


def random_case(seed, n=160, holes=0.0):
    rng = np.random.RandomState(seed)
    price = 100 * np.exp(np.cumsum(rng.randn(n) * 0.02))
    price[rng.rand(n) < holes] = np.nan
    sig = np.repeat(rng.choice([-1, 0, 0, 1], n // 4 + 1), 4)[:n]
    return price, sig


@pytest.mark.parametrize("chunk_rows", [None, 32])
def test_random_series_against_loops(spark, chunk_rows):
    data = {f"s{i}": random_case(i) for i in range(8)}
    a = check(spark, data, chunk_rows=chunk_rows)
    assert a.trades.count() > 10
    summary = {r.ticker: r for r in a.summary.collect()}
    for t, (price, sig) in data.items():
        trades, curves = brute(price, sig, 2.0, 8)
        assert summary[t].trades == len(trades)
        for side in ("long", "short"):
            peak = np.maximum.accumulate(curves[side])
            assert abs(summary[t][f"{side}_drawdown"] - np.min((curves[side] - peak) / peak * 100)) < 1e-9
            assert abs(summary[t][f"{side}_return"] - (curves[side][-1] - 100)) < 1e-8


def test_long_short_and_empty(spark):
    t = np.arange(120.0)
    up = 100 + 0.02 * t * t
    sig = np.zeros(120, dtype=int)
    sig[50:70], sig[70:] = -1, 1
    flat = (np.full(50, 100.0), np.zeros(50, dtype=int))
    a = check(spark, {"up": (up, sig), "flat": flat, "down": (150 - 0.005 * t * t, -sig)}, n_ext=10)
    by = {r.ticker: r for r in a.summary.collect()}
    assert by["flat"].trades == 0 and by["flat"].long_return == 0 and by["flat"].short_return == 0


def test_stop_inside_protection(spark):
    price = np.concatenate([100 + 0.05 * (np.arange(71) - 40.0) ** 2, 100 + 0.05 * 900 - 3 * np.arange(1, 40)])
    sig = np.zeros(len(price), dtype=int)
    sig[40:60], sig[70:] = -1, 1
    price[60:71] = price[60] + np.arange(11) * 0.1
    a = check(spark, {"x": (price, sig)}, n_ext=10)
    for r in a.trades.where("exit_reason = 'stop_loss'").collect():
        assert r.exit_idx <= r.entry_idx + 10


def test_negative_capital_keeps_compounding(spark):
    rows = [("a", "1d", i, "short", i * 10, i * 10 + 5, 1.0, 1.0, r, "eod") for i, r in enumerate([-150.0, 50.0], 1)]
    df = spark.createDataFrame(rows, "ticker string, timeframe string, id int, type string, entry_idx long, exit_idx long, entry_price double, exit_price double, return_pct double, exit_reason string")
    got = T.capital(df).orderBy("id").collect()
    assert [round(r.capital_after, 9) for r in got] == [-50.0, -75.0]


def test_costs_rolling_atr(spark, series):
    rows = [("a", "1d", i, "long", i, i + 1, 1.0, 1.0, float(r), "eod") for i, r in enumerate([1, -2, 3, 4, -5, 6], 1)]
    df = spark.createDataFrame(rows, "ticker string, timeframe string, id int, type string, entry_idx long, exit_idx long, entry_price double, exit_price double, return_pct double, exit_reason string")
    assert T.with_costs(df, 10).orderBy("id").first().return_pct == pytest.approx(0.9)
    for chunk_rows in (None, 2):
        got = T.rolling_perf(df, 3, chunk_rows=chunk_rows).orderBy("id").collect()
        assert got[-1].win_rate == pytest.approx(2 / 3) and got[-1].window_trades == 3
        assert got[-1].sharpe == pytest.approx(np.mean([4, -5, 6]) / np.std([4, -5, 6], ddof=1))
    bars = series({"a": [10, 12, 11, 13]}).withColumn("high", F.col("close") + 1).withColumn("low", F.col("close") - 1)
    got = [r.atr for r in T.atr(bars, 2).orderBy("idx").collect()]
    assert got[0] is None and np.allclose(got[1:], [2.5, 2.5, 2.5])


def test_sweep_equals_single_runs(spark, series):
    rng = np.random.RandomState(9)
    n = 150
    rows = [(t, "60m", i, float(p)) for t in "ab" for i, p in enumerate(100 + np.cumsum(rng.randn(n)))]
    bars = spark.createDataFrame(rows, "ticker string, timeframe string, i int, close double").selectExpr(
        "ticker", "timeframe", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,i) as ts", "close")
    base = Settings("sma", {"window": 5}, span=20)
    sets = [{"param_id": 1, "k_eps": 0.1}, {"param_id": 2, "k_eps": 0.4, "stop_loss_pct": 0.5}, {"param_id": 3, "filter_params": {"window": 9}, "n_ext": 3},
            {"param_id": 4, "fit_mode": "poly2", "span": 30}]
    got = {(r.ticker, r.param_id): r for r in sweep_summary(bars, sets, base=base).collect()}
    from dataclasses import replace
    for s in sets:
        one = replace(base, **{k: v for k, v in s.items() if k != "param_id"})
        for r in analyse(bars, one).summary.collect():
            g = got[(r.ticker, s["param_id"])]
            assert g.trades == r.trades and g.wins == r.wins and g.long_return == pytest.approx(r.long_return)

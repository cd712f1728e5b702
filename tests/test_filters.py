import math

import numpy as np
import pandas as pd
import pytest

from tidebars.functions import taps as K
from tidebars.operators.filters import REGISTRY, FilterSpec, apply_filter, dual_filter, register_filter
from tidebars.operators.lowess import lowess, median_per_series
from tidebars.schema import KEYS

CASES = [("sma", {"window": 11}), ("ema", {"span": 10}), ("wma", {"window": 11}), ("alma", {"window": 21}), ("savgol", {"window": 21}),
         ("kalman", {}), ("butterworth", {}), ("gaussian", {"sigma": 3.0}), ("median", {"window": 5}), ("lowess", {"frac": 0.1})]


def noisy_sine():
    rng = np.random.RandomState(42)
    clean = np.sin(np.arange(200) / 5)
    return clean, clean + 0.1 * rng.randn(200)


@pytest.mark.parametrize("fid,params", CASES)
def test_constant_is_kept(series, values, fid, params):
    got = np.array(values(apply_filter(series({"a": [1.0] * 100}), fid, params)))
    assert len(got) == 100
    if fid == "kalman":
        assert np.allclose(got[-20:], 1, atol=1e-3)
    else:
        assert np.allclose(got[20:-20], 1, atol=1e-6)


@pytest.mark.parametrize("fid,params", CASES)
def test_chunks_change_nothing(series, values, fid, params):
    rng = np.random.RandomState(1)
    df = series({"a": np.cumsum(rng.randn(300)), "b": np.cumsum(rng.randn(37)), "c": [5.0]})
    whole = values(apply_filter(df, fid, params))
    cut = lowess(df, KEYS, "close", "filtered", params, short_rows=8) if fid == "lowess" else apply_filter(df, fid, params, chunk_rows=64)
    cut = values(cut)
    assert len(whole) == len(cut) == 338
    for a, b in zip(whole, cut):
        assert (a is None) == (b is None)
        assert a is None or abs(a - b) < 1e-9


@pytest.mark.parametrize("fid,params,gain", [
    ("sma", {"window": 9}, 1 / 9), ("wma", {"window": 7}, sum(k * k for k in range(1, 8)) / 28**2),
    ("savgol", {"window": 15, "order": 2}, K.savgol_matrix(15, 2)[7, 7]), ("ema", {"alpha": 0.25}, 0.25 / 1.75),
    ("gaussian", {"sigma": 1.5}, sum(v * v for v in K.gaussian_taps(1.5, 6).values()))])
def test_variance_of_white_noise(series, values, fid, params, gain):
    """What is left of white noise is the sum of the squared weights."""
    x = np.random.RandomState(77).standard_normal(20_000)
    got = np.array(values(apply_filter(series({"a": x}), fid, params)))[50:-50]
    assert np.var(got) / np.var(x) == pytest.approx(gain, rel=0.06)


def test_edges_of_means(series, values):
    five = series({"a": [5.0] * 5})
    assert np.allclose(values(apply_filter(five, "sma", {"window": 3})), [10 / 3, 5, 5, 5, 10 / 3])
    ramp = series({"a": np.arange(10.0)})
    got = values(apply_filter(ramp, "sma", {"window": 3}, edge="nan"))
    assert got[0] is None and got[-1] is None and np.allclose(got[1:-1], np.arange(1, 9))
    assert abs(values(apply_filter(ramp, "wma", {"window": 3}))[1] - 4 / 6) < 1e-12
    got = values(apply_filter(ramp, "wma", {"window": 3, "direction": "newest"}, edge="nan"))
    assert got[0] is None and np.allclose(got[1:3], [8 / 6, 14 / 6])


def test_even_window_grows(series, values):
    df = series({"a": np.arange(20.0)})
    assert values(apply_filter(df, "sma", {"window": 4})) == values(apply_filter(df, "sma", {"window": 5}))


@pytest.mark.parametrize("window", [2, 4, 7])
def test_even_windows_on_request(series, values, window):
    x = np.random.RandomState(8).randn(30)
    for fid, kernel in (("sma", np.ones(window) / window), ("wma", np.arange(window, 0, -1) / (window * (window + 1) / 2))):
        got = values(apply_filter(series({"a": x}), fid, {"window": window, "keep_even": True, "direction": "newest"}))
        assert np.allclose(got, np.convolve(x, kernel, mode="same")), fid


def test_median_cases(series, values):
    assert values(apply_filter(series({"a": [1, 100, 2, 1, 2]}), "median", {"window": 3}))[1] == 2
    assert values(apply_filter(series({"a": [0, 0, 0, 100, 0, 0, 0]}), "median", {"window": 3}, edge="nan"))[3] == 0
    assert values(apply_filter(series({"a": [1, 1, 1, 5, 5, 5, 5]}), "median", {"window": 3}))[3] == 5


@pytest.mark.parametrize("fid", ["sma", "wma", "alma", "median"])
def test_window_of_one_is_identity(series, values, fid):
    x = [3.0, 1.0, 4.0, 1.0]
    assert np.allclose(values(apply_filter(series({"a": x}), fid, {"window": 1})), x)


@pytest.mark.parametrize("fid,params", CASES)
def test_all_missing(series, values, fid, params):
    assert values(apply_filter(series({"a": [None] * 60}), fid, params)) == [None] * 60


def test_savgol_window_too_long_is_null(series, values):
    assert values(apply_filter(series({"a": [1.0] * 7}), "savgol", {"window": 11, "order": 2})) == [None] * 7


def test_savgol_keeps_polynomials_to_the_ends(series, values):
    x = [0.5 * i * i - 3 * i + 2 for i in range(40)]
    assert np.allclose(values(apply_filter(series({"a": x}), "savgol", {"window": 9, "order": 2})), x, atol=1e-8)


def test_ema_with_holes_matches_pandas(series, values):
    rng = np.random.RandomState(3)
    x = np.cumsum(rng.randn(400))
    x[rng.rand(400) < 0.3] = np.nan
    want = pd.Series(x).ewm(span=5, adjust=False).mean()
    got = np.array([np.nan if v is None else v for v in values(apply_filter(series({"a": x}), "ema", {"span": 5}))])
    assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("span", [1, 2, 3, 100])
def test_ema_spans(series, values, span):
    x = np.random.RandomState(4).randn(500)
    want = pd.Series(x).ewm(span=span, adjust=False).mean()
    assert np.allclose(values(apply_filter(series({"a": x}), "ema", {"span": span}, chunk_rows=200)), want)


@pytest.mark.parametrize("model", ["piecewise", "diagonal", "continuous"])
def test_kalman_against_matrices(series, values, model):
    x = np.cumsum(np.random.RandomState(5).randn(80))
    q, r, step = 0.05, 0.7, np.array([[1.0, 1.0], [0.0, 1.0]])
    noise = q * {"piecewise": np.array([[.25, .5], [.5, 1]]), "diagonal": np.eye(2), "continuous": np.array([[1 / 3, .5], [.5, 1]])}[model]
    state, cov, want = np.array([x[0], 0.0]), np.eye(2) * (1.0 if model == "continuous" else 0.1), []
    for i, z in enumerate(x):
        if i == 0 and model != "piecewise":
            want.append(z)
            continue
        state, cov = step @ state, step @ cov @ step.T + noise
        g = cov[:, :1] / (cov[0, 0] + r)
        state = state + g[:, 0] * (z - state[0])
        cov = (np.eye(2) - g @ np.array([[1.0, 0.0]])) @ cov
        want.append(state[0])
    got = values(apply_filter(series({"a": x}), "kalman", {"Q": q, "R": r, "model": model}))
    assert np.allclose(got, want, atol=1e-10)


@pytest.mark.parametrize("order", range(1, 9))
def test_butterworth_gain(order):
    """Half power at the cutoff, unit gain at zero."""
    sections = K.butterworth_sections(order, 0.3)
    def gain(f):
        z = np.exp(-1j * math.pi * f)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))
    assert abs(gain(0.3) - math.sqrt(0.5)) < 1e-9
    assert abs(gain(0.0) - 1) < 1e-9
    assert gain(0.9) < gain(0.3)


def test_butterworth_short_series_is_null(series, values):
    assert values(apply_filter(series({"a": [1.0] * 15}), "butterworth", {"order": 4, "cutoff": 0.1})) == [None] * 15


def test_gaussian_reflects_more_than_once(series, values):
    x = [1.0, 2.0, 4.0]
    ext = np.pad(x, 12, mode="symmetric")
    k = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
    want = [np.dot(ext[i:i + 25], k / k.sum()) for i in range(3)]
    assert np.allclose(values(apply_filter(series({"a": x}), "gaussian", {"sigma": 3.0})), want)


def test_lowess_of_a_line_is_the_line(series, values):
    x = [2.0 * i + 1 for i in range(60)]
    assert np.allclose(values(apply_filter(series({"a": x}), "lowess", {"frac": 0.2})), x, atol=1e-8)


def test_exact_median(spark):
    rng = np.random.RandomState(6)
    rows = [("a", "1d", float(v)) for v in rng.randint(0, 50, 501)] + [("b", "1d", float(v)) for v in rng.randn(300)]
    df = spark.createDataFrame(rows, "ticker string, timeframe string, x double")
    got = {r.ticker: r.m for r in median_per_series(df, KEYS, "x", "m").collect()}
    for k in "ab":
        assert abs(got[k] - np.median([v for t, _, v in rows if t == k])) < 1e-12


def test_unknown_filter_and_second_filter(series, values):
    df = series({"a": [1.0, 2.0, 3.0, 4.0]})
    assert values(apply_filter(df, "nothing")) == [None] * 4
    both = dual_filter(df, ("sma", {"window": 1}), ("nothing", {}))
    assert values(both) == [1.0, 2.0, 3.0, 4.0] and values(both, "filtered2") == [None] * 4


def test_user_filter(series, values):
    register_filter(FilterSpec("double", "Twice the value", "grouped", lambda p: lambda idx, n, x: 2 * x, lambda p, e: (0, 0, 0)))
    try:
        assert values(apply_filter(series({"a": [1.0, 2.0]}), "double")) == [2.0, 4.0]
    finally:
        REGISTRY.pop("double")

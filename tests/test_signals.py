import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import fits as P
from tidebars.operators import signals as G
from tidebars.operators.derive import derivatives, drawdown, gradient, roughness


def brute(v, a, span, k, floor):
    """Row by row, as the rule is written down."""
    n = len(v)
    if n < span:
        return None
    al = 2 / (span + 1)
    mu, var, s, out = v[0], 0.0, 0, []
    for i in range(n):
        if i:
            mu = al * v[i] + (1 - al) * mu
            var = al * (v[i] - mu) ** 2 + (1 - al) * var
        band = k * max(np.sqrt(var), floor) if not np.isnan(var) and not np.isnan(mu) else np.nan
        up, down = a[i] > band, a[i] < -band
        if s == 0:
            s = 1 if up and v[i] > 0 else -1 if down and v[i] < 0 else 0
        elif (s == 1 and down) or (s == -1 and up):
            s = 0
        out.append(s)
    return out


def frame(spark, data):
    rows = [(t, "1d", i, len(v), *(None if np.isnan(x) else float(x) for x in (v[i], a[i]))) for t, (v, a) in data.items() for i in range(len(v))]
    return spark.createDataFrame(rows, "ticker string, timeframe string, idx long, n long, v double, a double")


def signs(df, ticker):
    return [r.sig for r in df.where(F.col("ticker") == ticker).orderBy("idx").collect()]


@pytest.mark.parametrize("chunk_rows", [None, 16, 70])
def test_trigger_against_loop(spark, chunk_rows):
    rng = np.random.RandomState(0)
    data = {}
    for i, (size, scale) in enumerate([(300, 0.2), (300, 0.05), (250, 1.0), (61, 0.3), (60, 0.3), (30, 1.0)]):
        v = rng.randn(size)
        a = np.round(rng.randn(size) * scale, 6)
        if i == 1:
            a[rng.rand(size) < 0.4] = 0.0
        data[f"s{i}"] = (v, a)
    v, a = rng.randn(300), rng.randn(300)
    v[170] = np.nan
    a[20:30] = np.nan
    data["hole"] = (v, a)
    v = rng.randn(100)
    v[0] = np.nan
    data["dead"] = (v, rng.randn(100))
    got = G.schmitt(frame(spark, data), 60, 0.15, 0.05, chunk_rows=chunk_rows).cache()
    for t, (v, a) in data.items():
        want = brute(v, a, 60, 0.15, 0.05)
        assert signs(got, t) == (want if want is not None else [None] * len(v)), t


def test_all_short_sequences_of_pushes(spark):
    """Every sequence of five kinds of rows up to length six, in one go."""
    import itertools

    kinds = [(0.0, 0.5), (1.0, 0.5), (1.0, -0.5), (-1.0, -0.5), (-1.0, 0.5)]
    data = {}
    for seq in itertools.product(range(5), repeat=6):
        if sum(seq) % 7 == 0:
            data["".join(map(str, seq))] = (np.array([kinds[k][1] for k in seq]), np.array([kinds[k][0] for k in seq]))
    df = frame(spark, data)
    for chunk_rows in (None, 2):
        got = {}
        for r in G.schmitt(df, 3, 0.1, 0.05, chunk_rows=chunk_rows).orderBy("ticker", "idx").collect():
            got.setdefault(r.ticker, []).append(r.sig)
        for t, (v, a) in data.items():
            assert got[t] == brute(v, a, 3, 0.1, 0.05), (t, chunk_rows)


def test_named_cases(spark):
    n = 200
    data = {
        "zone": (np.full(n, 0.5), np.zeros(n)), "long": (np.full(n, 0.5), np.full(n, 0.3)), "short": (np.full(n, -0.5), np.full(n, -0.3)),
        "keep": (np.full(300, 0.5), np.concatenate([np.full(100, 0.3), np.linspace(0.3, -0.0005, 100), np.full(100, -0.3)])),
    }
    got = G.schmitt(frame(spark, data), 60).cache()
    assert set(signs(got, "zone")) == {0}
    assert signs(got, "long") == [1] * n and signs(got, "short") == [-1] * n
    keep = signs(got, "keep")
    assert keep[199] == 1 and keep[-1] == 0
    assert got.agg(F.min("eps")).first()[0] >= 0.0075 - 1e-12


def with_sig(spark, data):
    rows = [(t, "1d", i, len(s), int(x), float(i)) for t, s in data.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "ticker string, timeframe string, idx long, n long, sig int, filtered double")


def test_pairs_and_runs(spark):
    def line(n, *spans):
        s = np.zeros(n, dtype=int)
        for lo, hi, v in spans:
            s[lo:hi + 1] = v
        return s
    data = {"alt": line(100, (10, 29, 1), (50, 69, -1), (80, 89, 1)), "merge": line(45, (5, 14, 1), (19, 24, 1), (30, 39, -1)),
            "next": line(40, (10, 19, 1), (20, 29, -1)), "one": line(30, (5, 9, 1)), "none": line(30), "tiny": np.array([1, -1])}
    df = with_sig(spark, data)
    for chunk_rows in (None, 7):
        pairs = {}
        for r in G.find_pairs(df, chunk_rows=chunk_rows).orderBy("start_idx").collect():
            pairs.setdefault(r.ticker, []).append((r.start_idx, r.end_idx))
        assert pairs == {"alt": [(10, 50), (50, 80)], "merge": [(5, 30)], "next": [(10, 20)]}
    runs = sorted((r.start_idx, r.end_idx, r.value) for r in G.runs(df, chunk_rows=7).where("ticker = 'merge'").collect())
    assert runs == [(5, 14, 1), (19, 24, 1), (30, 39, -1)]
    dur = [r.dur for r in G.state_duration(df, chunk_rows=7).where("ticker = 'next'").orderBy("idx").collect()]
    assert dur == [*range(1, 11), *range(1, 11), *range(1, 11), *range(1, 11)]


def rows_of(spark, y, start, end):
    n = len(y)
    sig = np.zeros(n, dtype=int)
    sig[start], sig[end] = 1, -1
    data = [("a", "1d", i, n, int(sig[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "ticker string, timeframe string, idx long, n long, sig int, filtered double")
    pairs = G.find_pairs(df, x="filtered")
    return df, pairs, P.segment_rows(df, pairs)


def test_fits(spark):
    x = np.arange(20.0)
    _, _, rows = rows_of(spark, 2 * x * x + 3 * x + 1, 0, 19)
    f = P.fit_pairs(rows, "poly2").first()
    assert np.allclose([f.a, f.b, f.c], [2, 3, 1], atol=1e-8)
    x = np.arange(30.0)
    df, pairs, rows = rows_of(spark, 100 - 0.5 * (x - 29) ** 2, 0, 29)
    fit = P.fit_pairs(rows)
    f = fit.first()
    assert abs(f.a + 0.5) < 1e-12 and f.x0 == 29 and f.b == 0 and f.c == 100
    assert P.attach_fit(pairs, fit).count() == 1
    fitted = [r.y_fit for r in P.fitted(rows, fit).orderBy("idx").collect()]
    assert np.allclose(fitted, 100 - 0.5 * (x - 29) ** 2)
    ahead = P.extrapolate(fit, 4).orderBy("idx").collect()
    assert [r.idx for r in ahead] == [29, 30, 31, 32] and abs(ahead[-1].y_pred - (100 - 4.5)) < 1e-9
    assert P.direction(fit, 4).first().up is False
    assert P.direction(fit, 1).first().up is None
    x = np.arange(60.0)
    _, _, rows = rows_of(spark, 0.3 * (x - 45) ** 2 + 7, 20, 45)
    assert abs(P.fit_pairs(rows).first().a - 0.3) < 1e-9
    _, _, rows = rows_of(spark, x, 10, 12)
    assert P.fit_pairs(rows).count() == 0


def test_gradient_and_friends(series, values):
    x = np.cumsum(np.random.RandomState(2).randn(90))
    df = series({"a": x}, "filtered")
    for chunk_rows in (None, 20):
        d = derivatives(df, chunk_rows=chunk_rows).cache()
        v = np.gradient(x)
        assert np.allclose(values(d, "v"), v) and np.allclose(values(d, "a"), np.gradient(v))
        s = np.concatenate([[x[0]], x[:-1]])
        assert np.allclose(values(gradient(df, shift=1, chunk_rows=chunk_rows), "v"), np.gradient(s))
        peak = np.maximum.accumulate(x + 50)
        got = values(drawdown(df.withColumn("p", F.col("filtered") + 50), "p", chunk_rows=chunk_rows), "drawdown_pct")
        assert np.allclose(got, (x + 50 - peak) / peak * 100)
        assert abs(roughness(df, chunk_rows=chunk_rows).first().roughness - np.sum(np.diff(x, 2) ** 2)) < 1e-9


@pytest.mark.parametrize("chunks,group", [(1, 256), (300, 8), (10_000, 256)])
def test_states_through_a_tree_of_maps(spark, chunks, group):
    rng = np.random.RandomState(chunks)
    maps = rng.randint(-1, 2, (chunks, 3))
    maps[rng.rand(chunks) < 0.7] = [-1, 0, 1]
    rows = [("a", c, *map(int, m), c > chunks // 2) for c, m in enumerate(maps)] + [("b", 0, 1, 1, 1, False)]
    df = spark.createDataFrame(rows, "ticker string, chunk long, `_m-1` int, _m0 int, _m1 int, _stuck boolean").repartition(4)
    got = {r["chunk"]: (r["_came"], r["_stuck"]) for r in G._entered_with(df, ["ticker"], group).where("ticker = 'a'").collect()}
    state = 0
    for c, m in enumerate(maps):
        assert got[c] == (state, c > chunks // 2)
        state = int(m[state + 1])
    assert len(got) == chunks

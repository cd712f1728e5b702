import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm.nearest import _product, _tile, nearest, quantised


def brute(ids, x, asks, k=5):
    x = np.asarray(x, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(asks):
        s = unit @ unit[i]
        out[ids[i]] = sorted(((-round(float(v), 12), int(j)) for j, v in zip(ids, s) if j != ids[i]))[:k]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24))
    x[50:120] = x[50]  # many equal vectors
    x[200] *= 1e-200
    x[201] *= 1e200
    x[210] = x[211] + 1e-9
    ids = rng.permutation(10_000)[:300]
    rows = [(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x)]
    bad = [(20_000, None, 1), (20_050, [0.0] * 24, 1), (20_100, [float("nan")] + [1.0] * 23, 1), (20_150, [None] + [1.0] * 23, 1), (20_200, [float("inf")] * 24, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows + bad + rows[:3], "window_id long, closes array<double>, rank int").repartition(4)
    got = {}
    for r in nearest(df, F.col("window_id") % 3 == 0, block_rows=block, query_rows=block).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((-round(r["score"], 12), r["found"]))
        assert r["rank"] == len(got[r["query"]])
    assert got == brute(ids, x, ids % 3 == 0)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "window_id long, closes array<float>")
    assert [(r["query"], r["found"]) for r in nearest(df, F.col("window_id") == 0).collect()] == [(0, 1)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(2)
    for d in (3, 64, 2000):
        a, b = rng.normal(size=(40, d)) * rng.lognormal(0, 2, (40, d)), rng.normal(size=(50, d))
        (a8, s, e), (b8, t, f) = quantised(a), quantised(b)
        exact = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        assert (np.abs(_product(a8, b8) * (s[:, None] * t) - exact) <= e[:, None] * (1 + f) + f).all()
    assert len(_tile(np.arange(40), a, np.arange(50) + 99, b, 5)[0]) == 200

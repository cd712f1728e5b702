"""Locally weighted linear regression on evenly spaced rows.

The regression at a row needs five weighted sums over its ``k`` nearest rows.
The sums are additive, so they are computed per (target block, source block)
pair and added up: no task holds more than two blocks, however long the series
or the neighbourhood. Short series run in one grouped call.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.scalars import known
from tidebars.operators.series import seen_only
from tidebars.schema import KEYS

BLOCK = 1024
SHORT = 4096


def neighbours(n, frac: float, rule: str):
    """Rows per neighbourhood; works on numbers and on columns."""
    if rule == "round":
        return max(2, int(np.floor(frac * n + 0.5)))
    return max(1, int(frac * n + 1e-10))


def _neighbours_col(n: Column, frac: float, rule: str) -> Column:
    if rule == "round":
        return F.greatest(F.lit(2), F.floor(n * F.lit(frac) + 0.5)).cast("long")
    return F.greatest(F.lit(1), F.floor(n * F.lit(frac) + 1e-10)).cast("long")


def _tricube(target: np.ndarray, source: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and weight of the sources (one row of them per target)."""
    radius = np.maximum(target - left, left + k - 1 - target)[:, None]
    d = source - target[:, None]
    away = np.abs(d)
    u = away / np.maximum(radius, 1e-300)
    w = 1.0 - u * u * u
    w = np.where(away > 0.999 * radius, 0.0, np.where(away <= 0.001 * radius, 1.0, w * w * w))
    return d, np.where((source >= left[:, None]) & (source <= left[:, None] + k - 1), w, 0.0)


def _first_row(target: np.ndarray, n: int, k: int) -> np.ndarray:
    return np.clip(np.ceil(target - k / 2), 0, n - k)


def _sums(target: np.ndarray, source: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """S0, S1, S2, T0, T1 of every target row over one block of source rows."""
    d, w = _tricube(target, source[None, :], _first_row(target, n, k), k)
    wd = w * d
    wy = weight * y
    return np.stack([w @ weight, wd @ weight, (wd * d) @ weight, w @ wy, wd @ wy])


def _solve(s, y):
    """Value of the local line at the row itself."""
    s0, s1, s2, t0, t1 = s
    det = s0 * s2 - s1 * s1
    with np.errstate(divide="ignore", invalid="ignore"):
        line = np.where(det > 1e-12 * s0 * s0, (s2 * t0 - s1 * t1) / det, t0 / s0)
    return np.where(s0 > 0, line, y)


def _bisquare(y, fit):
    r = np.abs(y - fit)
    m = np.median(r)
    r = np.where(r > 0, 1.0, 0.0) if m == 0 else r / (6.0 * m)
    r = np.where(r >= 0.999, 1.0, np.where(r <= 0.001, 0.0, r))
    return (1 - r * r) ** 2


# Weights of a whole series are kept between the passes up to this many cells.
KEEP_CELLS = 4_000_000


def _neighbour_blocks(n: int, k: int):
    """Per block of target rows: first row of each neighbourhood and the weights
    times the distance to the power of 0, 1 and 2."""
    for lo in range(0, n, BLOCK):
        target = np.arange(lo, min(n, lo + BLOCK), dtype=float)
        left = _first_row(target, n, k)
        d, w = _tricube(target, left[:, None] + np.arange(k), left, k)
        wd = w * d
        yield lo, left.astype(int), w, wd, wd * d


def _fit_short(y: np.ndarray, frac: float, passes: int, rule: str) -> np.ndarray:
    out = np.full(len(y), np.nan)
    seen = ~np.isnan(y)
    v = y[seen]
    n = len(v)
    if n == 0:
        return out
    k = min(neighbours(n, frac, rule), n)
    blocks = list(_neighbour_blocks(n, k)) if n * k <= KEEP_CELLS else None
    weight, fit = np.ones(n), v
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    for turn in range(passes + 1):
        if turn:
            weight = _bisquare(v, fit)
        near_w = np.lib.stride_tricks.sliding_window_view(weight, k)
        near_y = np.lib.stride_tricks.sliding_window_view(weight * v, k)
        parts = []
        for lo, left, w, wd, wdd in blocks or _neighbour_blocks(n, k):
            a, b = near_w[left], near_y[left]
            parts.append(_solve((dot(w, a), dot(wd, a), dot(wdd, a), dot(w, b), dot(wd, b)), v[lo:lo + len(left)]))
        fit = np.concatenate(parts)
    out[seen] = fit
    return out


def _short(df, keys, x, out, frac, passes, rule):
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pdf.assign(**{out: _fit_short(pdf[x].to_numpy(dtype=float), frac, passes, rule)})

    return df.groupBy(*keys).applyInPandas(per_series, schema)


def median_per_series(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median without sorting a series in one task: equal values are
    counted together, an approximate pass brackets the middle, and only the
    values inside the bracket are ranked."""
    keys = list(keys)
    tally = df.where(known(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    frame = df.where(known(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"),
        F.percentile_approx(value, F.array(F.lit(0.4999), F.lit(0.5001)), 100_000).alias("_q"),
    )
    placed = tally.join(frame, keys)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    below = placed.where(F.col(value) < lo).groupBy(*keys).agg(F.sum("_c").alias("_below"))
    rank = Window.partitionBy(*keys).orderBy(value)
    middle = (
        placed.where((F.col(value) >= lo) & (F.col(value) <= hi))
        .join(below, keys, "left")
        .withColumn("_upto", F.coalesce("_below", F.lit(0)) + F.sum("_c").over(rank))
        .withColumn("_from", F.col("_upto") - F.col("_c"))
    )
    a, b = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda r: F.when((F.col("_from") <= r) & (r < F.col("_upto")), F.col(value))
    return middle.groupBy(*keys).agg(((F.max(holds(a)) + F.max(holds(b))) / 2).alias(out))


def _long_pass(df, keys, x, out, frac, rule):
    """One regression pass; ``_w`` holds the row weights."""
    keys = list(keys)
    df = df.withColumn("_k", F.least(_neighbours_col(F.col("n"), frac, rule), F.col("n")))
    source = df.select(*keys, "idx", "n", "_k", F.col(x).alias("_y"), "_w").withColumn(
        "_from", F.expr(f"idx div {BLOCK}"))
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_from") * BLOCK - F.col("_k")) / BLOCK))
    high = F.least(F.expr(f"(n - 1) div {BLOCK}"), F.floor((F.col("_from") * BLOCK + BLOCK - 1 + F.col("_k")) / BLOCK))
    pairs = source.withColumn("_to", F.explode(F.sequence(low, high)))
    key_fields = [f for f in df.schema.fields if f.name in keys]
    sums = ["_s0", "_s1", "_s2", "_t0", "_t1"]
    schema = T.StructType([*key_fields, T.StructField("idx", T.LongType()),
                           *[T.StructField(s, T.DoubleType()) for s in sums]])

    def per_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k, to = int(pdf["n"].iloc[0]), int(pdf["_k"].iloc[0]), int(pdf["_to"].iloc[0])
        target = np.arange(to * BLOCK, min(n, (to + 1) * BLOCK), dtype=float)
        s = _sums(target, pdf["idx"].to_numpy(dtype=float), pdf["_y"].to_numpy(), pdf["_w"].to_numpy(), n, k)
        res = pd.DataFrame({name: s[i] for i, name in enumerate(sums)})
        res["idx"] = target.astype("int64")
        for c in keys:
            res[c] = pdf[c].iloc[0]
        return res[s[0] != 0][[*keys, "idx", *sums]]

    total = pairs.groupBy(*keys, "_to", "_from").applyInPandas(per_pair, schema).groupBy(*keys, "idx").agg(
        *[F.sum(s).alias(s) for s in sums])
    s0, s1, s2, t0, t1 = (F.col(s) for s in sums)
    det = s0 * s2 - s1 * s1
    line = F.when(det > s0 * s0 * F.lit(1e-12), F.try_divide(s2 * t0 - s1 * t1, det)).otherwise(F.try_divide(t0, s0))
    return df.join(total, [*keys, "idx"], "left").withColumn(
        out, F.when(s0 > 0, line).otherwise(F.col(x))).drop("_k", *sums)


def _long(df, keys, x, out, frac, passes, rule):
    from tidebars.sources.storage import materialize

    cols = df.columns
    df = df.withColumn("_w", F.lit(1.0))
    for turn in range(passes + 1):
        df = _long_pass(df, keys, x, out, frac, rule)
        if turn == passes:
            return df.select(*cols, out)
        df = materialize(df.withColumn("_r", F.abs(F.col(x) - F.col(out))), "lowess")
        mid = median_per_series(df, keys, "_r", "_m")
        r = F.when(F.col("_m") == 0, F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).otherwise(
            F.try_divide(F.col("_r"), F.col("_m") * 6.0))
        r = F.when(r >= 0.999, 1.0).when(r <= 0.001, 0.0).otherwise(r)
        df = df.join(mid, list(keys)).withColumn("_w", F.pow(1 - r * r, F.lit(2.0))).drop("_m", "_r", out)


def lowess(df: DataFrame, keys: Sequence[str] = KEYS, x: str = "close", out: str = "filtered",
           params: dict | None = None, edge: str = "zero", short_rows: int = SHORT) -> DataFrame:
    """``params``: frac, passes (3 re-weighting passes; 0 for the plain rule),
    rule (``floor`` or ``round`` for the neighbourhood size). Missing rows are
    left out at every length: the others are numbered without them, and only
    they get a value."""
    p = {"frac": 0.1, "passes": 3, "rule": "floor", **(params or {})}
    short = _short(df.where(F.col("n") <= short_rows), keys, x, out, p["frac"], int(p["passes"]), p["rule"])
    long = df.where(F.col("n") > short_rows)
    if long.isEmpty():
        return short
    keys = list(keys)
    narrow = long.select(*keys, "idx", "n", F.col(x).alias("_x"))
    fitted = _long(seen_only(narrow, keys, known("_x").isNotNull()), keys, "_x", out, p["frac"], int(p["passes"]), p["rule"])
    back = fitted.select(*keys, F.col("_row").alias("idx"), out)
    return short.unionByName(long.join(back, [*keys, "idx"], "left").select(*short.columns))

"""Series operators beyond the base filters: DEMA, TEMA, trend/cycle split,
walk-forward windows, bootstrap paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions import taps as K
from tidebars.functions.recurrence import BLOCK, Recurrence, second_order
from tidebars.functions.scalars import start_of
from tidebars.operators.filters import ema_scan, ema_series, per_chunk
from tidebars.operators.series import CHUNK_ROWS, chunked, core_rows
from tidebars.schema import KEYS


def _stacked(df: DataFrame, span: int, depth: int, x: str, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    alpha = 2.0 / (span + 1.0)
    # From its first value on the first mean has no holes, so the next ones need a halo only.
    cut = chunked(ema_series(df, keys, x, "_e1", alpha, chunk_rows), (depth - 1) * K.settle(1.0 - alpha), 0, chunk_rows)
    for level in range(2, depth + 1):
        cut = ema_scan(cut, keys, f"_e{level - 1}", f"_e{level}", alpha)
    return core_rows(cut)


def dema(df: DataFrame, span: int, x: str = "close", out: str = "dema", keys: Sequence[str] = KEYS,
         chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    e = _stacked(df, span, 2, x, keys, chunk_rows)
    return e.withColumn(out, 2.0 * F.col("_e1") - F.col("_e2")).drop("_e1", "_e2")


def tema(df: DataFrame, span: int, x: str = "close", out: str = "tema", keys: Sequence[str] = KEYS,
         chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    e = _stacked(df, span, 3, x, keys, chunk_rows)
    return e.withColumn(out, 3.0 * F.col("_e1") - 3.0 * F.col("_e2") + F.col("_e3")).drop("_e1", "_e2", "_e3")


@lru_cache(64)
def _hp_factors(lamb: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors d, l1, l2 of I + lamb D'D = L d L' from the first row on, until they stop
    changing; they hold up to the last rows of a series of any length."""
    d, l1, l2, main = [], [], [], (1.0 + lamb, 1.0 + 5.0 * lamb, 1.0 + 6.0 * lamb)
    while len(d) < 3 or max(abs(d[-1] / d[-2] - 1.0), abs(l1[-1] - l1[-2]), abs(l2[-1] - l2[-2])) > 1e-15:
        i = len(d)
        if i > 1_000_000:
            raise ValueError(f"the factors for {lamb} don't settle within a million rows")
        d.append(main[min(i, 2)] - (l1[i - 1] ** 2 * d[i - 1] if i else 0.0) - (l2[i - 2] ** 2 * d[i - 2] if i > 1 else 0.0))
        l1.append(((-4.0 if i else -2.0) * lamb - (l1[i - 1] * d[i - 1] * l2[i - 1] if i else 0.0)) / d[i])
        l2.append(lamb / d[i])
    return np.array(d), np.array(l1), np.array(l2)


@lru_cache(64)
def _hp_sweeps(lamb: float) -> tuple[Recurrence, Recurrence, Recurrence]:
    """Down the rows, up the rows where factors have settled, up the first rows."""
    _, l1, l2 = _hp_factors(lamb)
    down = second_order(np.r_[0.0, l1], np.r_[0.0, 0.0, l2[:-1]])
    return down, second_order(l1[-1:], l2[-1:]), second_order(l1[::-1], l2[::-1])


def _trend(y: np.ndarray, lamb: float) -> np.ndarray:
    """Solve (I + lamb D'D) t = y: two bands on either side, so a sweep down and one up
    the rows, each a recurrence of second order."""
    n = len(y)
    if n < 3 or np.isnan(y).any():
        return y.copy() if n < 3 else np.full(n, np.nan)
    if n <= BLOCK:
        bend = np.diff(np.eye(n), 2, axis=0)
        return np.linalg.solve(np.eye(n) + lamb * bend.T @ bend, y)
    factors = _hp_factors(lamb)
    settled = len(factors[0])
    d, l1, l2 = (f[np.minimum(np.arange(n), settled - 1)] for f in factors)
    # The two last rows have weights of their own.
    d[-2] = 1.0 + 5.0 * lamb - l1[-3] ** 2 * d[-3] - l2[-4] ** 2 * d[-4]
    l1[-2] = (-2.0 * lamb - l1[-3] * d[-3] * l2[-3]) / d[-2]
    d[-1] = 1.0 + lamb - l1[-2] ** 2 * d[-2] - l2[-3] ** 2 * d[-3]
    down, up, up_first = _hp_sweeps(lamb)
    z = np.empty(n)
    z[:-1] = down.solve(y[:-1], (0.0, 0.0))
    z[-1] = y[-1] - l1[-2] * z[-2] - l2[-3] * z[-3]
    z /= d
    z[-2] -= l1[-2] * z[-1]
    top = n - 2
    if top > settled:
        z[settled:top] = up.solve(z[settled:top][::-1], (z[top], z[top + 1]))[::-1]
        top = settled
    z[:top] = up_first.solve(z[:top][::-1], (z[top], z[top + 1]), settled - top)[::-1]
    return z


def hp_reach(lamb: float) -> int:
    """Rows after which the smoother has forgotten its neighbours: its roots
    have modulus 1 - sin(pi/4)/lamb^(1/4) at least."""
    roots = np.roots([lamb, -4 * lamb, 1 + 6 * lamb, -4 * lamb, lamb])
    return K.settle(float(max(abs(r) for r in roots if abs(r) < 1.0)), 1e-15)


def hp_filter(df: DataFrame, lamb: float = 1600.0, x: str = "close", keys: Sequence[str] = KEYS,
              chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``trend`` and ``cycle``. The influence of a row fades geometrically, so
    a halo of ``hp_reach`` rows makes every chunk exact to rounding."""
    reach = hp_reach(lamb)
    cut = chunked(df, reach, reach, chunk_rows)
    out = per_chunk(cut, keys, x, "trend", lambda idx, n, y: _trend(y, lamb))
    return core_rows(out).withColumn("cycle", F.col(x) - F.col("trend"))


def walk_forward(df: DataFrame, train: int = 6, test: int = 3, step: int = 1, keys: Sequence[str] = KEYS,
                 ts: str = "ts") -> DataFrame:
    """Windows of ``train`` then ``test`` months, moving by ``step`` months,
    that lie within the data of a series."""
    span = df.groupBy(*keys).agg(
        start_of("month", F.min(ts)).alias("_first"), F.max(ts).alias("_last"))
    months = lambda m: F.make_ym_interval(months=F.lit(m))
    last_start = F.col("_last") - months(train + test) + F.make_dt_interval(days=F.lit(1))
    starts = F.when(last_start >= F.col("_first"),
                    F.sequence("_first", last_start, F.expr(f"interval {step} month")))
    return (
        span.withColumn("train_start", F.explode(starts))
        .select(*keys, "train_start", (F.col("train_start") + months(train)).alias("test_start"),
                (F.col("train_start") + months(train + test)).alias("test_end"))
    )


def window_rows(df: DataFrame, windows: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Rows of every walk-forward window with ``part`` train or test. Windows
    start on month firsts, so rows meet them on the month, without a range
    join."""
    month = lambda c: start_of("month", F.col(c) if isinstance(c, str) else c)
    spread = windows.withColumn("_month", F.explode(F.sequence(
        "train_start", F.col("test_end") - F.make_dt_interval(days=F.lit(1)), F.expr("interval 1 month"))))
    rows = df.withColumn("_month", month(F.col(ts))).join(spread, [*keys, "_month"]).drop("_month")
    return rows.withColumn("part", F.when(F.col(ts) < F.col("test_start"), "train").otherwise("test"))


def bootstrap(df: DataFrame, paths: int = 1000, seed: int = 42, base: str = "filtered", resid: str = "residual",
              keys: Sequence[str] = KEYS, out: str = "close") -> DataFrame:
    """``paths`` disturbed copies of every series: ``base`` plus a residual of
    a random row of the same series. The row is chosen by the MD5 digest of seed, path,
    index and keys, so a rerun after a lost executor, or another system, gives the same paths."""
    keys = list(keys)
    copies = df.select(*keys, "idx", "n", base).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("path").cast("string"), F.col("idx").cast("string"), *keys))
    pick = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.col("n"))
    drawn = df.select(*keys, F.col("idx").alias("_pick"), F.col(resid).alias("_r"))
    return (
        copies.withColumn("_pick", pick).join(drawn, [*keys, "_pick"])
        .select(*keys, "path", "idx", "n", (F.col(base) + F.col("_r")).alias(out))
    )


def path_quantiles(per_path: DataFrame, value: str, shares: Sequence[float] = (0.05, 0.5, 0.95), keys: Sequence[str] = KEYS) -> DataFrame:
    """Quantiles of a number that every disturbed path of a series has: ``q5``, ``q50``..."""
    return per_path.groupBy(*keys).agg(*[F.percentile(value, q).alias(f"q{round(100 * q)}") for q in shares])

"""Registered queries: filters, derivatives, volatility."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidebars.catalog.base import HOURLY, SERIES, SIGNAL, SMOOTH, W, filtered_sql, indexed, register, slope_sql, stored, with_
from tidebars.functions import taps as K
from tidebars.operators import derive as D
from tidebars.operators import extensions as E
from tidebars.operators.filters import apply_filter, dual_filter
from tidebars.operators.quality import series_stats
from tidebars.sources.bars import latest_n
from tidebars.operators.series import index_bounded
from tidebars.catalog.base import TICKS, bars_sql, hourly
from tidebars.operators.signals import schmitt


def _out(df, *cols):
    return df.select("ticker", "timeframe", "idx", *[F.round(c, 6).alias(c) for c in (cols or ("filtered",))])


def _taps_sql(taps: dict[int, float], edge: str) -> str:
    """Taps as a table joined on the row offset."""
    values = ", ".join(f"({o}, {v!r}::DOUBLE)" for o, v in taps.items())
    pick = {
        "zero": "x.idx = s.idx + k.o",
        "reflect": "x.idx = CASE WHEN s.idx + k.o < 0 THEN -1 - (s.idx + k.o) WHEN s.idx + k.o >= s.n THEN 2 * s.n - 1 - (s.idx + k.o) ELSE s.idx + k.o END",
        "first": "x.idx = greatest(s.idx + k.o, 0)",
        "nan": "x.idx = s.idx + k.o",
    }[edge]
    value = "sum(k.v * x.close)" if edge != "nan" else f"CASE WHEN count(*) = {len(taps)} THEN sum(k.v * x.close) END"
    return with_(*SERIES, f"k(o, v) AS (VALUES {values})") + f"""SELECT s.ticker, s.timeframe, s.idx, round({value}, 6) AS filtered
FROM s CROSS JOIN k JOIN s x ON x.ticker = s.ticker AND x.timeframe = s.timeframe AND {pick} GROUP BY ALL"""


def _frame(n: int) -> str:
    return f"PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING"


@register("filter_sma", with_(*SERIES) + f"SELECT ticker, timeframe, idx, round(sum(close) OVER ({_frame(5)}) / 11, 6) AS filtered FROM s")
def filter_sma(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "sma", {"window": 11}))


@register("filter_sma_nan", with_(*SERIES) + f"""SELECT ticker, timeframe, idx, CASE WHEN count(*) OVER ({_frame(5)}) = 11
THEN round(sum(close) OVER ({_frame(5)}) / 11, 6) END AS filtered FROM s""")
def filter_sma_nan(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "sma", {"window": 11}, edge="nan"))


EMA_SQL = """e AS (SELECT ticker, timeframe, idx, close AS y FROM s WHERE idx = 0 UNION ALL
 SELECT s.ticker, s.timeframe, s.idx, {a} * s.close + (1 - {a}) * e.y FROM e JOIN s ON s.ticker = e.ticker AND s.timeframe = e.timeframe AND s.idx = e.idx + 1)"""


@register("filter_ema", with_(*SERIES, EMA_SQL.format(a="(2.0::DOUBLE / 11)")) + "SELECT ticker, timeframe, idx, round(y, 6) AS filtered FROM e")
def filter_ema(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "ema", {"span": 10}))


@register("filter_ema_alpha", with_(*SERIES, EMA_SQL.format(a="0.2::DOUBLE")) + "SELECT ticker, timeframe, idx, round(y, 6) AS filtered FROM e")
def filter_ema_alpha(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "ema", {"alpha": 0.2}))


def _weights(w, newest=False):
    total = w * (w + 1) / 2
    return {o: ((o + w // 2 + 1) if newest else (w // 2 - o + 1)) / total for o in range(-(w // 2), w // 2 + 1)}


@register("filter_wma", _taps_sql(_weights(11), "zero"))
def filter_wma(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "wma", {"window": 11}))


@register("filter_wma_newest", _taps_sql(_weights(11, True), "nan"))
def filter_wma_newest(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "wma", {"window": 11, "direction": "newest"}, edge="nan"))


def _bell_weights(w, centre, s, offset_of):
    raw = {offset_of(i): math.exp(-0.5 * ((i - centre) / s) ** 2) for i in range(w)}
    total = sum(raw.values())
    return {o: v / total for o, v in raw.items()}


@register("filter_alma", _taps_sql(_bell_weights(21, 17.0, 3.5, lambda i: 10 - i), "zero"))
def filter_alma(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "alma", {"window": 21, "offset": 0.85, "sigma": 6.0}))


@register("filter_alma_causal", _taps_sql(_bell_weights(21, 17.0, 3.5, lambda i: i - 20), "first"))
def filter_alma_causal(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "alma", {"window": 21, "offset": 0.85, "sigma": 6.0}, edge="causal"))


def _savgol_sql(w: int, order: int) -> str:
    """Weights from the normal equations, one row of the table per position
    inside the window that is evaluated."""
    h = w // 2
    basis = np.vander(np.arange(w) - h, order + 1, increasing=True).astype(float)
    hat = basis @ np.linalg.solve(basis.T @ basis, basis.T)
    values = ", ".join(f"({i}, {j}, {float(hat[i, j])!r}::DOUBLE)" for i in range(w) for j in range(w))
    return with_(*SERIES, f"k(p, j, v) AS (VALUES {values})", f"""place AS (SELECT *, CASE WHEN idx < {h} THEN 0 WHEN idx >= n - {h} THEN n - {w} ELSE idx - {h} END AS lo FROM s)""") + """
SELECT a.ticker, a.timeframe, a.idx, round(sum(k.v * x.close), 6) AS filtered FROM place a JOIN k ON k.p = a.idx - a.lo
JOIN s x ON x.ticker = a.ticker AND x.timeframe = a.timeframe AND x.idx = a.lo + k.j GROUP BY ALL"""


@register("filter_savgol", _savgol_sql(21, 2))
def filter_savgol(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "savgol", {"window": 21, "order": 2}))


KALMAN_SQL = """kf AS (SELECT ticker, timeframe, idx, close AS pos, 0.0::DOUBLE AS vel, p00 - p00 * p00 / (p00 + {r}) AS p00,
   p01 - p00 * p01 / (p00 + {r}) AS p01, p11 - p01 * p01 / (p00 + {r}) AS p11
  FROM (SELECT *, 0.2 + {q} / 4 AS p00, 0.1 + {q} / 2 AS p01, 0.1 + {q} AS p11 FROM s WHERE idx = 0) UNION ALL
 SELECT ticker, timeframe, idx, pos + p00 / (p00 + {r}) * (close - pos), vel + p01 / (p00 + {r}) * (close - pos),
   p00 - p00 * p00 / (p00 + {r}), p01 - p00 * p01 / (p00 + {r}), p11 - p01 * p01 / (p00 + {r})
  FROM (SELECT s.ticker, s.timeframe, s.idx, s.close, k.pos + k.vel AS pos, k.vel, k.p00 + 2 * k.p01 + k.p11 + {q} / 4 AS p00,
    k.p01 + k.p11 + {q} / 2 AS p01, k.p11 + {q} AS p11
   FROM kf k JOIN s ON s.ticker = k.ticker AND s.timeframe = k.timeframe AND s.idx = k.idx + 1))"""


@register("filter_kalman", with_(*SERIES, KALMAN_SQL.format(q="0.01::DOUBLE", r="1.0::DOUBLE")) + "SELECT ticker, timeframe, idx, round(pos, 6) AS filtered FROM kf")
def filter_kalman(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "kalman", {"Q": 0.01, "R": 1.0}))


def _lowpass_sql(cutoff: float) -> str:
    """Fourth order, forward and backward over the extended series, sample by
    sample. Two second-order sections from the textbook formula with quality
    factors 0.5412 and 1.3066."""
    w0 = math.tan(math.pi * cutoff)
    secs = []
    for q in (1 / (2 * math.cos(math.pi / 8)), 1 / (2 * math.cos(3 * math.pi / 8))):
        d = 1 + w0 / q + w0 * w0
        secs.append((w0 * w0 / d, 2 * w0 * w0 / d, w0 * w0 / d, 2 * (w0 * w0 - 1) / d, (1 - w0 / q + w0 * w0) / d))
    (b0, b1, b2, a1, a2), (c0, c1, c2, e1, e2) = [[f"({v!r}::DOUBLE)" for v in sec] for sec in secs]

    def run(name: str, src: str, x: str) -> str:
        u, y = f"({b0} * i.{x} + p.z1)", f"({c0} * ({b0} * i.{x} + p.z1) + p.z3)"
        return f"""{name} AS (SELECT ticker, timeframe, j, {x} AS y, {b1} * {x} - {a1} * {x} + ({b2} - {a2}) * {x} AS z1, {b2} * {x} - {a2} * {x} AS z2,
    {c1} * {x} - {e1} * {x} + ({c2} - {e2}) * {x} AS z3, {c2} * {x} - {e2} * {x} AS z4 FROM {src} WHERE j = 0 UNION ALL
  SELECT i.ticker, i.timeframe, i.j, {y}, {b1} * i.{x} - {a1} * {u} + p.z2, {b2} * i.{x} - {a2} * {u}, {c1} * {u} - {e1} * {y} + p.z4, {c2} * {u} - {e2} * {y}
  FROM {name} p JOIN {src} i ON i.ticker = p.ticker AND i.timeframe = p.timeframe AND i.j = p.j + 1)"""

    return with_(*SERIES, """pad AS (SELECT s.ticker, s.timeframe, s.idx + 15 AS j, s.close AS x, s.n FROM s UNION ALL
  SELECT s.ticker, s.timeframe, 15 - s.idx, 2 * f.close - s.close, s.n FROM s JOIN s f ON f.ticker = s.ticker AND f.timeframe = s.timeframe AND f.idx = 0 WHERE s.idx BETWEEN 1 AND 15 UNION ALL
  SELECT s.ticker, s.timeframe, 15 + 2 * (s.n - 1) - s.idx, 2 * l.close - s.close, s.n FROM s JOIN s l ON l.ticker = s.ticker AND l.timeframe = s.timeframe AND l.idx = s.n - 1
   WHERE s.idx BETWEEN s.n - 16 AND s.n - 2)""", run("fw", "pad", "x"),
                 "rev AS (SELECT f.ticker, f.timeframe, p.n + 29 - f.j AS j, f.y AS x FROM fw f JOIN pad p USING (ticker, timeframe, j))", run("bw", "rev", "x")) + """
SELECT b.ticker, b.timeframe, p.n + 14 - b.j AS idx, round(b.y, 6) AS filtered FROM bw b JOIN (SELECT DISTINCT ticker, timeframe, n FROM s) p USING (ticker, timeframe)
WHERE p.n + 14 - b.j BETWEEN 0 AND p.n - 1"""


@register("filter_butterworth", _lowpass_sql(0.15))
def filter_butterworth(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "butterworth", {"order": 4, "cutoff": 0.15}))


@register("filter_gaussian", _taps_sql(_bell_weights(25, 12.0, 3.0, lambda i: i - 12), "reflect"))
def filter_gaussian(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "gaussian", {"sigma": 3.0}))


@register("filter_median", with_(*SERIES) + f"""SELECT ticker, timeframe, idx, list_sort(list_concat(l, list_resize([]::DOUBLE[], 5 - len(l), 0.0)))[3] AS filtered
FROM (SELECT *, list(close) OVER ({_frame(2)}) AS l FROM s)""")
def filter_median(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "median", {"window": 5}))


@register("filter_median_nan", with_(*SERIES) + f"""SELECT ticker, timeframe, idx, CASE WHEN count(*) OVER ({_frame(3)}) = 7
THEN median(close) OVER ({_frame(3)}) END AS filtered FROM s""")
def filter_median_nan(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "median", {"window": 7}, edge="nan"))


@register("filter_lowess_plain", with_(*SERIES, "p AS (SELECT *, greatest(2, floor(n * 0.1 + 0.5))::BIGINT AS k FROM s)",
                                      "q AS (SELECT *, greatest(0, least(n - k, ceil(idx - k / 2.0)))::BIGINT AS lo FROM p)",
                                      "rr AS (SELECT *, greatest(idx - lo, lo + k - 1 - idx) AS rad FROM q)", """m AS (SELECT r.ticker, r.timeframe, r.idx, r.rad, x.idx - r.idx AS d, x.close AS y,
 CASE WHEN abs(x.idx - r.idx) > 0.999 * r.rad THEN 0.0 WHEN abs(x.idx - r.idx) <= 0.001 * r.rad THEN 1.0
  ELSE pow(1 - pow(abs(x.idx - r.idx) / r.rad::DOUBLE, 3), 3) END AS w
 FROM rr r JOIN s x ON x.ticker = r.ticker AND x.timeframe = r.timeframe AND x.idx BETWEEN r.lo AND r.lo + r.k - 1)""") + """
SELECT ticker, timeframe, idx, round((sum(w*d*d) * sum(w*y) - sum(w*d) * sum(w*d*y)) / (sum(w) * sum(w*d*d) - sum(w*d) * sum(w*d)), 6) AS filtered
FROM m GROUP BY ALL""")
def filter_lowess_plain(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "lowess", {"frac": 0.1, "passes": 0, "rule": "round"}))


def _robust_sql() -> str:
    """The plain regression four times, re-weighted by the residuals in between."""
    ctes = [*SERIES, "p AS (SELECT *, greatest(1, floor(n * 0.1 + 1e-10))::BIGINT AS k FROM s)",
            "q AS (SELECT *, greatest(0, least(n - k, ceil(idx - k / 2.0)))::BIGINT AS lo FROM p)",
            "d0 AS (SELECT *, greatest(idx - lo, lo + k - 1 - idx) AS rad, 1.0::DOUBLE AS wt FROM q)"]
    for i in range(4):
        ctes.append(f"""m{i} AS MATERIALIZED (SELECT r.ticker, r.timeframe, r.idx, x.idx - r.idx AS d, x.close AS y,
 x.wt * CASE WHEN abs(x.idx - r.idx) > 0.999 * r.rad THEN 0.0 WHEN abs(x.idx - r.idx) <= 0.001 * r.rad THEN 1.0
  ELSE pow(1 - pow(abs(x.idx - r.idx) / r.rad::DOUBLE, 3), 3) END AS w
 FROM d{i} r JOIN d{i} x ON x.ticker = r.ticker AND x.timeframe = r.timeframe AND x.idx BETWEEN r.lo AND r.lo + r.k - 1)""")
        ctes.append(f"""f{i} AS MATERIALIZED (SELECT ticker, timeframe, idx, (sum(w*d*d) * sum(w*y) - sum(w*d) * sum(w*d*y)) / (sum(w) * sum(w*d*d) - sum(w*d) * sum(w*d)) AS fit
 FROM m{i} GROUP BY ALL)""")
        ctes.append(f"""e{i} AS MATERIALIZED (SELECT d.* EXCLUDE (wt), abs(d.close - f.fit) AS e, median(abs(d.close - f.fit)) OVER (PARTITION BY d.ticker, d.timeframe) AS md
 FROM d{i} d JOIN f{i} f USING (ticker, timeframe, idx))""")
        ctes.append(f"""d{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (e, md), CASE WHEN e / (6 * md) >= 0.999 THEN 0.0 WHEN e / (6 * md) <= 0.001 THEN 1.0
 ELSE pow(1 - pow(e / (6 * md), 2), 2) END::DOUBLE AS wt FROM e{i})""")
    return with_(*ctes) + "SELECT ticker, timeframe, idx, round(fit, 6) AS filtered FROM f3"


@register("filter_lowess_robust", _robust_sql())
def filter_lowess_robust(spark, sf):
    return _out(apply_filter(indexed(spark, sf), "lowess", {"frac": 0.1}))


@register("filter_unknown", with_(*SERIES) + "SELECT ticker, timeframe, idx, NULL::DOUBLE AS filtered FROM s")
def filter_unknown(spark, sf):
    return apply_filter(indexed(spark, sf), "no_such_filter").select("ticker", "timeframe", "idx", "filtered")


@register("dual_filter", with_(*SERIES) + f"""SELECT ticker, timeframe, idx, round(sum(close) OVER ({_frame(5)}) / 11, 6) AS filtered,
round(sum(close) OVER ({_frame(10)}) / 21, 6) AS filtered2 FROM s""")
def dual(spark, sf):
    return _out(dual_filter(indexed(spark, sf), ("sma", {"window": 11}), ("sma", {"window": 21})), "filtered", "filtered2")


# --- derivatives -----------------------------------------------------------

FLAGSHIP = with_(TICKS, bars_sql("60m", name="all_bars"), """bars AS (SELECT * FROM all_bars QUALIFY row_number() OVER
 (PARTITION BY ticker, timeframe ORDER BY ts DESC) <= 120)""", *SMOOTH[2:], """bend AS (SELECT *, filtered - 2 * lag(filtered) OVER w + lag(filtered, 2) OVER w AS c FROM g
 WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx))""") + """SELECT ticker, timeframe, count(*) AS points, last(close ORDER BY ts) AS last_close,
round(stddev_pop(close), 6) AS sigma, round(coalesce(sum(c * c), 0), 4) AS roughness, round(last(v ORDER BY idx), 8) AS last_v,
round(last(a ORDER BY idx), 8) AS last_a, round(avg(abs(filtered - close)), 6) AS mean_residual FROM bend GROUP BY ALL"""


@register("flagship", FLAGSHIP)
def flagship(spark, sf):
    """Newest 120 hourly bars per series: smoothed, derived, summarised."""
    bars = index_bounded(latest_n(hourly(spark, sf), 120))
    # at most 120 rows per series: one chunk each
    rows = D.residual(D.smooth_and_derive(bars, "sma", {"window": 11}, decimals=6, chunk_rows=None))
    w = D.in_chunk(["ticker", "timeframe"])
    cut = D.chunked(rows, chunk_rows=None)
    bend = F.col("filtered") - 2.0 * F.lag("filtered", 1).over(w) + F.lag("filtered", 2).over(w)
    return D.core_rows(cut.withColumn("_b", bend)).groupBy("ticker", "timeframe").agg(
        F.count(F.lit(1)).alias("points"), F.max_by("close", "ts").alias("last_close"),
        F.round(F.stddev_pop("close"), 6).alias("sigma"), F.round(F.coalesce(F.sum(F.col("_b") * F.col("_b")), F.lit(0.0)), 4).alias("roughness"),
        F.round(F.max_by("v", "idx"), 8).alias("last_v"), F.round(F.max_by("a", "idx"), 8).alias("last_a"),
        F.round(F.avg(F.abs("residual")), 6).alias("mean_residual"))


@register("derivatives", with_(*SMOOTH) + "SELECT ticker, timeframe, idx, filtered, round(v, 9) AS v, round(a, 9) AS a FROM g")
def derivatives(spark, sf):
    r = D.smooth_and_derive(indexed(spark, sf), "sma", {"window": 11}, decimals=6)
    return r.select("ticker", "timeframe", "idx", "filtered", F.round("v", 9).alias("v"), F.round("a", 9).alias("a"))


@register("derivatives_shifted", with_(*SERIES, filtered_sql(11), f"""sh AS (SELECT * REPLACE (coalesce(lag(filtered) OVER w, filtered) AS filtered) FROM f {W})""",
                                      f"g0 AS (SELECT *, {slope_sql('filtered')} AS v FROM sh {W})") + f"""SELECT ticker, timeframe, idx, round(v, 9) AS v,
round({slope_sql('v')}, 9) AS a FROM g0 {W}""")
def derivatives_shifted(spark, sf):
    f = apply_filter(indexed(spark, sf), "sma", {"window": 11}).withColumn("filtered", F.round("filtered", 6))
    return D.derivatives(f, shift=1).select("ticker", "timeframe", "idx", F.round("v", 9).alias("v"), F.round("a", 9).alias("a"))


@register("residual", with_(*SERIES, filtered_sql(11)) + "SELECT ticker, timeframe, idx, round(filtered - close, 6) AS residual FROM f")
def residual(spark, sf):
    f = apply_filter(indexed(spark, sf), "sma", {"window": 11}).withColumn("filtered", F.round("filtered", 6))
    return _out(D.residual(f), "residual")


@register("ewma_volatility", with_(*SIGNAL) + """SELECT ticker, timeframe, idx, round(mu, 6) AS mu, round(sigma, 6) AS sigma,
round(0.15 * greatest(sigma, 0.05), 6) AS eps FROM r""")
def ewma_volatility(spark, sf):
    rows = stored(D.smooth_and_derive(indexed(spark, sf), "sma", {"window": 11}, decimals=6))
    return _out(D.ewma_volatility(rows, "v", 60).withColumn("eps", D.deadband(F.col("sigma"), 0.15, 0.05)), "mu", "sigma", "eps")


@register("drawdown", with_(*SERIES) + """SELECT ticker, timeframe, idx, round((close - m) / m * 100, 6) AS drawdown_pct FROM
(SELECT *, max(close) OVER (PARTITION BY ticker, timeframe ORDER BY idx) AS m FROM s)""")
def drawdown(spark, sf):
    return _out(D.drawdown(stored(indexed(spark, sf)), "close"), "drawdown_pct")


@register("roughness", with_(*SERIES) + """SELECT ticker, timeframe, round(sum(c * c), 4) AS roughness FROM (SELECT *, close - 2 * lag(close) OVER w + lag(close, 2) OVER w AS c FROM s
WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx)) GROUP BY ALL""")
def roughness(spark, sf):
    return D.roughness(indexed(spark, sf), "close").withColumn("roughness", F.round("roughness", 4))


E2 = """e AS (SELECT ticker, timeframe, idx, close AS e1, close AS e2, close AS e3 FROM s WHERE idx = 0 UNION ALL
 SELECT ticker, timeframe, idx, e1, e2, {a} * e2 + (1 - {a}) * p3 FROM (SELECT ticker, timeframe, idx, e1, {a} * e1 + (1 - {a}) * p2 AS e2, p3 FROM (
  SELECT s.ticker, s.timeframe, s.idx, {a} * s.close + (1 - {a}) * e.e1 AS e1, e.e2 AS p2, e.e3 AS p3
  FROM e JOIN s ON s.ticker = e.ticker AND s.timeframe = e.timeframe AND s.idx = e.idx + 1)))""".format(a="(2.0::DOUBLE / 11)")


@register("dema", with_(*SERIES, E2) + "SELECT ticker, timeframe, idx, round(2 * e1 - e2, 6) AS dema FROM e")
def dema(spark, sf):
    return _out(E.dema(indexed(spark, sf), 10), "dema")


@register("tema", with_(*SERIES, E2) + "SELECT ticker, timeframe, idx, round(3 * e1 - 3 * e2 + e3, 6) AS tema FROM e")
def tema(spark, sf):
    return _out(E.tema(indexed(spark, sf), 10), "tema")


# (I + lambda D'D) t = close row by row: elimination forward, substitution back.
HP_SQL = """m AS (SELECT *, 1 + 1600.0::DOUBLE * (CASE WHEN idx <= n - 3 THEN 1 ELSE 0 END + CASE WHEN idx BETWEEN 1 AND n - 2 THEN 4 ELSE 0 END + CASE WHEN idx >= 2 THEN 1 ELSE 0 END) AS c0,
  -3200.0::DOUBLE * (CASE WHEN idx <= n - 3 THEN 1 ELSE 0 END + CASE WHEN idx BETWEEN 1 AND n - 2 THEN 1 ELSE 0 END) AS c1, CASE WHEN idx <= n - 3 THEN 1600.0::DOUBLE ELSE 0.0 END AS c2 FROM s),
fw AS (SELECT ticker, timeframe, idx, n, c0 AS d, c1 AS u1, c2 AS u2, close AS z, 1.0::DOUBLE AS pd, 0.0::DOUBLE AS pu1, 0.0::DOUBLE AS pu2, 0.0::DOUBLE AS pz FROM m WHERE idx = 0 UNION ALL
 SELECT m.ticker, m.timeframe, m.idx, m.n, m.c0 - f.u1 * f.u1 / f.d - f.pu2 * f.pu2 / f.pd, m.c1 - f.u1 * f.u2 / f.d, m.c2, m.close - f.u1 / f.d * f.z - f.pu2 / f.pd * f.pz,
  f.d, f.u1, f.u2, f.z FROM fw f JOIN m ON m.ticker = f.ticker AND m.timeframe = f.timeframe AND m.idx = f.idx + 1),
bk AS (SELECT ticker, timeframe, idx, z / d AS t, 0.0::DOUBLE AS nt FROM fw WHERE idx = n - 1 UNION ALL
 SELECT f.ticker, f.timeframe, f.idx, (f.z - f.u1 * b.t - f.u2 * b.nt) / f.d, b.t FROM bk b JOIN fw f ON f.ticker = b.ticker AND f.timeframe = b.timeframe AND f.idx = b.idx - 1)"""


@register("hp_filter", with_(*SERIES, HP_SQL) + "SELECT ticker, timeframe, idx, round(t, 6) AS trend, round(s.close - t, 6) AS cycle FROM bk JOIN s USING (ticker, timeframe, idx)")
def hp_filter(spark, sf):
    return _out(E.hp_filter(indexed(spark, sf), 1600.0), "trend", "cycle")

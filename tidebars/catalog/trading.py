"""Registered queries: trigger, pairs, fits, trades, equity."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidebars.catalog.base import (
    CAPITAL, EQUITY, HOURLY, PAIRS, SEGMENTS, SIGNAL, SUMMARY, TRADED, VERTEX, hourly, indexed, register, stored, trades_sql, with_,
)
from tidebars.operators import backtest as T
from tidebars.operators import fits as P
from tidebars.operators import signals as G
from tidebars.operators.derive import smooth_and_derive
from tidebars.operators.filters import apply_filter
from tidebars.operators.series import chunk_limit
from tidebars.plans.analysis import analyse, signal_rows

K3 = ("ticker", "timeframe")


def signal_and_limit(spark, sf):
    """Stored: pairs, segments and trades read it several times. With the chunk
    size, None where no series needs more than one chunk."""
    rows = stored(indexed(spark, sf).select(*K3, "ts", "idx", "n", "close"))
    limit = chunk_limit(rows)
    return stored(signal_rows(rows, replace(HOURLY, chunk_rows=limit))), limit


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("trigger", with_(*SIGNAL) + """SELECT ticker, timeframe, idx, round(mu, 6) AS mu, round(sigma, 6) AS sigma,
round(0.15 * greatest(sigma, 0.05), 6) AS eps, sig FROM r""")
def trigger(spark, sf):
    rows = stored(indexed(spark, sf).select(*K3, "ts", "idx", "n", "close"))
    s = signal_rows(rows, replace(HOURLY, chunk_rows=chunk_limit(rows)))
    return _rounded(s.select(*K3, "idx", "mu", "sigma", "eps", "sig"), "mu", "sigma", "eps")


@register("state_duration", with_(*SIGNAL) + "SELECT ticker, timeframe, idx, sig, dur FROM r")
def state_duration(spark, sf):
    s, limit = signal_and_limit(spark, sf)
    return G.state_duration(s, chunk_rows=limit).select(*K3, "idx", "sig", "dur")


@register("signal_runs", with_(*SIGNAL) + """SELECT ticker, timeframe, min(idx) AS start_idx, max(idx) AS end_idx, any_value(sig) AS value FROM
(SELECT *, idx - row_number() OVER (PARTITION BY ticker, timeframe, sig ORDER BY idx) AS island FROM r) WHERE sig <> 0 GROUP BY ticker, timeframe, sig, island""")
def signal_runs(spark, sf):
    s, limit = signal_and_limit(spark, sf)
    return G.runs(s, chunk_rows=limit)


@register("signal_pairs", with_(*SIGNAL, PAIRS) + """SELECT ticker, timeframe, pair_id::INTEGER AS pair_id, start_idx, end_idx, v1, v2 FROM pairs""")
def signal_pairs(spark, sf):
    s, limit = signal_and_limit(spark, sf)
    return G.find_pairs(s, chunk_rows=limit).drop("n")


def pairs_and_rows(spark, sf):
    s, limit = signal_and_limit(spark, sf)
    p = stored(G.find_pairs(s, x="filtered", chunk_rows=limit))
    return s, p, P.segment_rows(s, p, chunk_rows=limit)


@register("segment_rows", with_(*SIGNAL, PAIRS, SEGMENTS) + """SELECT ticker, timeframe, pair_id::INTEGER AS pair_id, start_idx, end_idx, idx, filtered FROM seg""")
def segment_rows(spark, sf):
    return pairs_and_rows(spark, sf)[2].select(*K3, "pair_id", "start_idx", "end_idx", "idx", "filtered")


@register("fit_vertex", with_(*SIGNAL, PAIRS, SEGMENTS, VERTEX) + """SELECT ticker, timeframe, pair_id::INTEGER AS pair_id, start_idx, end_idx,
round(a, 6) AS a, round(c, 6) AS c, x0 FROM fits""")
def fit_vertex(spark, sf):
    f = P.fit_pairs(pairs_and_rows(spark, sf)[2], "parabola")
    return _rounded(f.drop("b"), "a", "c")


# Normal equations around the start of a pair, solved by Cramer's rule.
POLY2 = """mo AS (SELECT ticker, timeframe, pair_id, start_idx, end_idx, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4,
  sum(filtered) AS t0, sum(x * filtered) AS t1, sum(x*x * filtered) AS t2 FROM (SELECT *, (idx - start_idx)::DOUBLE AS x FROM seg)
  WHERE end_idx - start_idx >= 3 GROUP BY ALL),
dt AS (SELECT *, s4*(s2*s0 - s1*s1) - s3*(s3*s0 - s1*s2) + s2*(s3*s1 - s2*s2) AS det FROM mo),
lc AS (SELECT *, (t2*(s2*s0 - s1*s1) - s3*(t1*s0 - s1*t0) + s2*(t1*s1 - s2*t0)) / det AS a,
  (s4*(t1*s0 - t0*s1) - t2*(s3*s0 - s1*s2) + s2*(s3*t0 - t1*s2)) / det AS b1,
  (s4*(s2*t0 - s1*t1) - s3*(s3*t0 - t1*s2) + t2*(s3*s1 - s2*s2)) / det AS c1 FROM dt),
fits AS (SELECT ticker, timeframe, pair_id, start_idx, end_idx, a, b1 - 2 * a * start_idx AS b,
  c1 - b1 * start_idx + a * start_idx * start_idx AS c FROM lc)"""


@register("fit_poly2", with_(*SIGNAL, PAIRS, SEGMENTS, POLY2) + """SELECT ticker, timeframe, pair_id::INTEGER AS pair_id, start_idx, end_idx,
round(a, 5) AS a, round(b, 4) AS b, round(c, 2) AS c FROM fits""")
def fit_poly2(spark, sf):
    f = P.fit_pairs(pairs_and_rows(spark, sf)[2], "poly2").drop("x0")
    return f.withColumns({"a": F.round("a", 5), "b": F.round("b", 4), "c": F.round("c", 2)})


def _poly2_trades_sql() -> str:
    """Trades on free quadratics: their vertex and their value at the rows ahead."""
    free = POLY2.replace("fits AS (SELECT", "fits0 AS (SELECT") + """,
fits AS (SELECT ticker, timeframe, pair_id, start_idx, end_idx, a, b, c, 0.0::DOUBLE AS x0 FROM fits0)"""
    up = "(f.a * pow(p.end_idx + 7, 2) + f.b * (p.end_idx + 7) + f.c) > (f.a * pow(p.end_idx, 2) + f.b * p.end_idx + f.c) AS up"
    return with_(*SIGNAL, PAIRS, SEGMENTS, free, trades_sql().replace("f.a * pow(8 - 1, 2) + f.c > f.c AS up", up))


@register("trades_poly2", _poly2_trades_sql() + """SELECT ticker, timeframe, id, type, entry_idx, exit_idx, round(entry_price, 6) AS entry_price,
round(exit_price, 6) AS exit_price, round(return_pct, 5) AS return_pct, exit_reason FROM trades""")
def trades_poly2(spark, sf):
    a = analyse(stored(hourly(spark, sf)), replace(HOURLY, fit_mode="poly2"))
    t = a.trades.select(*K3, F.col("id").cast("long").alias("id"), "type", "entry_idx", "exit_idx", "entry_price", "exit_price", "return_pct", "exit_reason")
    return _rounded(t, "entry_price", "exit_price").withColumn("return_pct", F.round("return_pct", 5))


@register("fitted_rows", with_(*SIGNAL, PAIRS, SEGMENTS, VERTEX) + """SELECT s.ticker, s.timeframe, s.pair_id::INTEGER AS pair_id, s.idx,
round(f.a * pow(s.idx - f.x0, 2) + f.c, 7) AS y_fit FROM seg s JOIN fits f USING (ticker, timeframe, pair_id)""")
def fitted_rows(spark, sf):
    rows = pairs_and_rows(spark, sf)[2]
    return P.fitted(rows, P.fit_pairs(rows)).select(*K3, "pair_id", "idx", F.round("y_fit", 7).alias("y_fit"))


@register("extrapolation", with_(*SIGNAL, PAIRS, SEGMENTS, VERTEX) + """SELECT f.ticker, f.timeframe, f.pair_id::INTEGER AS pair_id, f.end_idx + k.i AS idx,
round(f.a * i * i + f.c, 7) AS y_pred FROM fits f CROSS JOIN range(8) k(i)""")
def extrapolation(spark, sf):
    f = P.fit_pairs(pairs_and_rows(spark, sf)[2])
    return P.extrapolate(f, 8).select(*K3, "pair_id", "idx", F.round("y_pred", 7).alias("y_pred"))


@register("direction", with_(*SIGNAL, PAIRS, SEGMENTS, VERTEX) + "SELECT ticker, timeframe, pair_id::INTEGER AS pair_id, f.a * 49 + f.c > f.c AS up FROM fits f")
def direction(spark, sf):
    return P.direction(P.fit_pairs(pairs_and_rows(spark, sf)[2]), 8).select(*K3, "pair_id", "up")


@register("pred_residual", with_(*SIGNAL, PAIRS, SEGMENTS, VERTEX) + """SELECT f.ticker, f.timeframe, f.pair_id::INTEGER AS pair_id, f.end_idx + k.i AS idx,
round(f.a * i * i + f.c - r.filtered, 7) AS residual FROM fits f JOIN r ON r.ticker = f.ticker AND r.timeframe = f.timeframe AND r.idx = f.end_idx CROSS JOIN range(8) k(i)""")
def pred_residual(spark, sf):
    s, _, rows = pairs_and_rows(spark, sf)
    return P.pred_residual(P.fit_pairs(rows), s, 8).select(*K3, "pair_id", "idx", F.round("residual", 7).alias("residual"))


@register("attach_fit", with_(*SIGNAL, PAIRS, SEGMENTS, VERTEX) + """SELECT p.ticker, p.timeframe, p.pair_id::INTEGER AS pair_id, p.end_idx, p.v2, round(f.a, 6) AS a
FROM pairs p JOIN fits f USING (ticker, timeframe, end_idx)""")
def attach_fit(spark, sf):
    _, p, rows = pairs_and_rows(spark, sf)
    return P.attach_fit(p, P.fit_pairs(rows)).select(*K3, "pair_id", "end_idx", "v2", F.round("a", 6).alias("a"))


def entered(spark, sf):
    s, p, rows = pairs_and_rows(spark, sf)
    return s, T.entries(p, P.fit_pairs(rows), 8)


@register("entries", with_(*TRADED) + "SELECT ticker, timeframe, entry_idx, type, entry_price FROM entries")
def entries(spark, sf):
    return entered(spark, sf)[1].select(*K3, "entry_idx", "type", "entry_price")


@register("exits", with_(*TRADED) + "SELECT ticker, timeframe, entry_idx, exit_idx, exit_reason FROM exits")
def exits(spark, sf):
    s, e = entered(spark, sf)
    return T.first_exit(stored(e), s, 2.0, 8).select(*K3, "entry_idx", "exit_idx", "exit_reason")


def traded(spark, sf):
    return analyse(hourly(spark, sf), HOURLY)


@register("trades", with_(*TRADED) + """SELECT ticker, timeframe, id::INTEGER AS id, type, entry_idx, exit_idx, entry_price, exit_price,
round(return_pct, 6) AS return_pct, exit_reason FROM trades""")
def trades(spark, sf):
    return _rounded(traded(spark, sf).trades, "return_pct")


@register("trades_with_costs", with_(*TRADED) + "SELECT ticker, timeframe, id::INTEGER AS id, round(return_pct - 0.2, 6) AS return_pct FROM trades")
def trades_with_costs(spark, sf):
    return _rounded(T.with_costs(traded(spark, sf).trades, 20.0).select(*K3, "id", "return_pct"), "return_pct")


# Compounded capital spans many magnitudes: compared as logarithms.
@register("capital", with_(*TRADED) + """SELECT ticker, timeframe, id::INTEGER AS id, round(ln(capital_before), 8) AS log_before,
round(ln(capital_after), 8) AS log_after FROM cap""")
def capital(spark, sf):
    return T.capital(traded(spark, sf).trades).select(
        *K3, "id", F.round(F.ln("capital_before"), 8).alias("log_before"), F.round(F.ln("capital_after"), 8).alias("log_after"))


@register("equity", with_(*TRADED) + "SELECT ticker, timeframe, idx, round(ln(long_pnl), 8) AS log_long, round(ln(short_pnl), 8) AS log_short FROM eq")
def equity(spark, sf):
    return traded(spark, sf).equity.select(
        *K3, "idx", F.round(F.ln("long_pnl"), 8).alias("log_long"), F.round(F.ln("short_pnl"), 8).alias("log_short"))


@register("equity_without_trades", with_(*SIGNAL) + "SELECT ticker, timeframe, idx, 100.0::DOUBLE AS long_pnl, 100.0::DOUBLE AS short_pnl FROM r")
def equity_without_trades(spark, sf):
    a = traded(spark, sf)
    return T.equity(a.signal, a.trades.where("false")).select(*K3, "idx", "long_pnl", "short_pnl")


@register("summary", with_(*TRADED, SUMMARY) + """SELECT ticker, timeframe, trades, wins, round(ln(long_return + 100), 8) AS long_log,
round(ln(short_return + 100), 8) AS short_log, round(long_drawdown, 6) AS long_drawdown, round(short_drawdown, 6) AS short_drawdown,
round(ln(total_return + 200), 8) AS total_log FROM summary""")
def summary(spark, sf):
    return traded(spark, sf).summary.select(
        *K3, "trades", "wins", F.round(F.ln(F.col("long_return") + 100), 8).alias("long_log"),
        F.round(F.ln(F.col("short_return") + 100), 8).alias("short_log"), F.round("long_drawdown", 6).alias("long_drawdown"),
        F.round("short_drawdown", 6).alias("short_drawdown"), F.round(F.ln(F.col("total_return") + 200), 8).alias("total_log"))


ATR = """atr AS (SELECT *, CASE WHEN idx >= 13 THEN avg(tr) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr
 FROM (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM s
 WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx)))"""


@register("atr", with_(*SIGNAL[:3], ATR) + "SELECT ticker, timeframe, idx, round(atr, 6) AS atr FROM atr")
def atr(spark, sf):
    return _rounded(T.atr(indexed(spark, sf), 14).select(*K3, "idx", "atr"), "atr")


@register("atr_stop", with_(*TRADED, ATR) + """SELECT e.ticker, e.timeframe, e.entry_idx, round(greatest(2.0, coalesce(a.atr / e.entry_price * 200, 2.0)), 6) AS stop_pct
FROM entries e LEFT JOIN atr a ON a.ticker = e.ticker AND a.timeframe = e.timeframe AND a.idx = e.entry_idx""")
def atr_stop(spark, sf):
    e = entered(spark, sf)[1]
    return _rounded(T.atr_stop(e, T.atr(indexed(spark, sf), 14)).select(*K3, "entry_idx", "stop_pct"), "stop_pct")


ATR_TRADED = (*SIGNAL, PAIRS, SEGMENTS, VERTEX, ATR, trades_sql(
    stop="greatest(2.0, coalesce((SELECT q.atr FROM atr q WHERE q.ticker = p.ticker AND q.timeframe = p.timeframe AND q.idx = p.entry_idx) / p.entry_price * 200, 2.0))"))


@register("exits_atr_stop", with_(*ATR_TRADED) + "SELECT ticker, timeframe, entry_idx, exit_idx, exit_reason FROM exits")
def exits_atr_stop(spark, sf):
    s, e = entered(spark, sf)
    stops = stored(T.atr_stop(e, T.atr(indexed(spark, sf), 14)))
    return T.first_exit(stops, s, "stop_pct", 8).select(*K3, "entry_idx", "exit_idx", "exit_reason")


GATES = """ema AS (SELECT ticker, timeframe, idx, close AS e20, close AS e50 FROM s WHERE idx = 0 UNION ALL
 SELECT s.ticker, s.timeframe, s.idx, (2.0::DOUBLE/21) * s.close + (1 - 2.0::DOUBLE/21) * e.e20, (2.0::DOUBLE/51) * s.close + (1 - 2.0::DOUBLE/51) * e.e50
 FROM ema e JOIN s ON s.ticker = e.ticker AND s.timeframe = e.timeframe AND s.idx = e.idx + 1)"""


@register("gate", with_(*TRADED, GATES) + """SELECT e.ticker, e.timeframe, e.entry_idx, e.type FROM entries e
JOIN ema m ON m.ticker = e.ticker AND m.timeframe = e.timeframe AND m.idx = e.entry_idx
JOIN r ON r.ticker = e.ticker AND r.timeframe = e.timeframe AND r.idx = e.entry_idx
WHERE ((e.type = 'long' AND e20 > e50) OR (e.type = 'short' AND e20 < e50)) AND r.sigma > 5""")
def gate(spark, sf):
    s, e = entered(spark, sf)
    wide = apply_filter(s, "ema", {"span": 20}, out="ema20")
    wide = apply_filter(wide, "ema", {"span": 50}, out="ema50")
    return T.gate(e, wide, fast="ema20", slow="ema50", sigma="sigma", sigma_min=5.0).select(*K3, "entry_idx", "type")


@register("rolling_perf", with_(*TRADED) + """SELECT ticker, timeframe, id::INTEGER AS id, round(avg(return_pct) OVER w / stddev_samp(return_pct) OVER w, 6) AS sharpe,
round(avg((return_pct > 0)::INTEGER) OVER w, 6) AS win_rate, count(*) OVER w AS window_trades FROM trades
WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_perf(spark, sf):
    return _rounded(T.rolling_perf(traded(spark, sf).trades, 30).select(*K3, "id", "sharpe", "win_rate", "window_trades"), "sharpe", "win_rate")


@register("trigger_chunked", with_(*SIGNAL) + "SELECT ticker, timeframe, idx, sig FROM r")
def trigger_chunked(spark, sf):
    """The plan for long series on short chunks: maps composed over them."""
    rows = smooth_and_derive(indexed(spark, sf), "sma", {"window": 11}, decimals=6, chunk_rows=128)
    return G.schmitt(rows, 60, chunk_rows=128, decimals=9).select(*K3, "idx", "sig")

"""Registered queries: as-of joins and cross-timeframe results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import (
    BAR_START, HIGHER, LEVEL_TRADED, LEVELS, ORDER_TICKS, ROWS, S, SUMMARY, TICKS, bars_sql, calendar_bars, derived_sql, filtered_sql, register, stored, table,
    ticks, trigger_sql, two_levels, with_,
)
from tidebars.functions.scalars import net_position
from tidebars.operators import align as A
from tidebars.operators.backtest import entries, gate
from tidebars.operators.series import with_index
from tidebars.plans.analysis import analyse, run_all, signal_rows

K3 = ("ticker", "timeframe")


@register("asof_higher_close", with_(TICKS, bars_sql("60m", "1d"), HIGHER) + """SELECT b.ticker, b.timeframe, b.ts, h.close AS higher_close
FROM (SELECT * FROM bars JOIN tf_dim USING (timeframe)) b ASOF LEFT JOIN (SELECT ticker, timeframe, ts, close FROM bars) h
ON b.ticker = h.ticker AND b.higher_tf = h.timeframe AND b.ts >= h.ts""")
def asof_higher_close(spark, sf):
    b = stored(two_levels(spark, sf))
    h = b.withColumn("higher_close", F.col("close"))
    return A.asof_higher(b, h, ["higher_close"]).select("ticker", "timeframe", "ts", "higher_close")


@register("asof_higher_closed", with_(TICKS, bars_sql("60m", "1d"), HIGHER) + """SELECT b.ticker, b.timeframe, b.ts, h.close AS higher_close
FROM (SELECT * FROM bars JOIN tf_dim USING (timeframe)) b ASOF LEFT JOIN
 (SELECT ticker, timeframe, ts + INTERVAL 1 DAY AS closed, close FROM bars WHERE timeframe = '1d') h
ON b.ticker = h.ticker AND b.higher_tf = h.timeframe AND b.ts >= h.closed""")
def asof_higher_closed(spark, sf):
    b = stored(two_levels(spark, sf))
    h = b.withColumn("higher_close", F.col("close"))
    return A.asof_higher(b, h, ["higher_close"], mode="closed").select("ticker", "timeframe", "ts", "higher_close")


@register("asof_backward", """SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN
(SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate + INTERVAL 8400 DAY AS d FROM orders GROUP BY o_custkey, o_orderdate) o
ON e.user_id = o.o_custkey AND e.ts >= o.d - INTERVAL 7000 DAY""")
def asof_backward(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey")).select(
        F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1400))).alias("ts"), "o_orderkey")
    # a busy key may hold a third of all events, so the buckets are hours
    return A.asof_backward(e, o, ["k"], "ts", ["o_orderkey"], F.date_trunc("hour", "ts")).select("event_id", "o_orderkey")


@register("higher_timeframe", with_(ORDER_TICKS, bars_sql("1d", "1wk", "1mo", "3mo"), HIGHER) + """SELECT ticker, timeframe, higher_tf, count(*) AS "rows"
FROM bars JOIN tf_dim USING (timeframe) GROUP BY ALL""")
def higher_timeframe(spark, sf):
    return A.higher_of(calendar_bars(spark, sf)).groupBy(*K3, "higher_tf").agg(F.count(F.lit(1)).alias("rows"))


def levels(spark, sf):
    a = analyse(two_levels(spark, sf), LEVELS)
    return a, stored(a.equity)


ALIGNED = (*LEVEL_TRADED, HIGHER, """al AS (SELECT e.*, d.higher_tf, h.long_pnl AS aligned_long, h.short_pnl AS aligned_short
 FROM eq e JOIN tf_dim d ON d.timeframe = e.timeframe ASOF LEFT JOIN (SELECT ticker, timeframe, ts, long_pnl, short_pnl FROM eq) h
 ON e.ticker = h.ticker AND d.higher_tf = h.timeframe AND e.ts >= h.ts)""")


@register("align_pnl", with_(*ALIGNED) + "SELECT ticker, timeframe, idx, round(ln(aligned_long), 7) AS aligned_long, round(ln(aligned_short), 7) AS aligned_short FROM al")
def align_pnl(spark, sf):
    _, eq = levels(spark, sf)
    return A.align_pnl(eq, eq).select(*K3, "idx", F.round(F.ln("aligned_long"), 7).alias("aligned_long"), F.round(F.ln("aligned_short"), 7).alias("aligned_short"))


MARKERS = (*ALIGNED, """ev AS (SELECT t.ticker, t.timeframe AS higher_tf, t.id, t.type AS side, 'entry' AS kind, r.ts AS at_ts, NULL::DOUBLE AS return_pct, NULL::VARCHAR AS exit_reason
  FROM trades t JOIN r ON r.ticker = t.ticker AND r.timeframe = t.timeframe AND r.idx = t.entry_idx UNION ALL
 SELECT t.ticker, t.timeframe, t.id, t.type, 'exit', r.ts, t.return_pct, t.exit_reason FROM trades t
  JOIN r ON r.ticker = t.ticker AND r.timeframe = t.timeframe AND r.idx = t.exit_idx),
markers AS (SELECT ev.ticker, a.timeframe, ev.id, ev.side, ev.kind, a.idx AS bar_idx,
  coalesce(CASE WHEN ev.side = 'long' THEN a.aligned_long ELSE a.aligned_short END, 100) AS pnl, ev.return_pct, ev.exit_reason
 FROM ev ASOF JOIN (SELECT * FROM al WHERE higher_tf IS NOT NULL) a ON ev.ticker = a.ticker AND ev.higher_tf = a.higher_tf AND ev.at_ts >= a.ts)""")


def marked(spark, sf):
    a, eq = levels(spark, sf)
    aligned = stored(A.align_pnl(eq, eq))
    return a, eq, aligned, stored(A.events_to_bars(a.trades, eq, aligned))


@register("markers", with_(*MARKERS) + """SELECT ticker, timeframe, id::INTEGER AS id, side, kind, bar_idx, round(ln(pnl), 7) AS pnl,
round(return_pct, 6) AS return_pct, exit_reason FROM markers""")
def markers(spark, sf):
    return marked(spark, sf)[3].withColumns({"pnl": F.round(F.ln("pnl"), 7), "return_pct": F.round("return_pct", 6)})


HOLDS = (*MARKERS, """holds AS (SELECT m.ticker, m.timeframe, m.side, m.bar_idx AS entry_bar, coalesce((SELECT min(x.bar_idx) FROM markers x WHERE x.kind = 'exit'
  AND x.ticker = m.ticker AND x.timeframe = m.timeframe AND x.side = m.side AND x.bar_idx > m.bar_idx), c.n - 1) AS exit_bar
 FROM markers m JOIN (SELECT ticker, timeframe, max(n) AS n FROM al GROUP BY ALL) c USING (ticker, timeframe) WHERE m.kind = 'entry')""",
         """masks AS (SELECT a.*, EXISTS (SELECT 1 FROM holds h WHERE h.ticker = a.ticker AND h.timeframe = a.timeframe AND h.side = 'long' AND a.idx BETWEEN h.entry_bar AND h.exit_bar) AS long_mask,
 EXISTS (SELECT 1 FROM holds h WHERE h.ticker = a.ticker AND h.timeframe = a.timeframe AND h.side = 'short' AND a.idx BETWEEN h.entry_bar AND h.exit_bar) AS short_mask FROM al a)""")


def held(spark, sf):
    a, eq, aligned, m = marked(spark, sf)
    counts = eq.groupBy(*K3).agg(F.max("n").alias("n"))
    return a, aligned, A.next_exit(m, counts)


@register("next_exit", with_(*HOLDS) + "SELECT ticker, timeframe, side, entry_bar, exit_bar FROM holds")
def next_exit(spark, sf):
    return held(spark, sf)[2]


def masked(spark, sf):
    a, aligned, holds = held(spark, sf)
    return a, stored(A.holding_masks(aligned, holds))


@register("holding_masks", with_(*HOLDS) + "SELECT ticker, timeframe, idx, long_mask, short_mask FROM masks")
def holding_masks(spark, sf):
    return masked(spark, sf)[1].select(*K3, "idx", "long_mask", "short_mask")


@register("aligned_equity", with_(*HOLDS) + """, step AS (SELECT *,
 CASE WHEN long_mask AND lag(long_pnl) OVER w <> 0 THEN long_pnl / lag(long_pnl) OVER w ELSE 1 END AS lm,
 CASE WHEN short_mask AND lag(short_pnl) OVER w <> 0 THEN short_pnl / lag(short_pnl) OVER w ELSE 1 END AS sm
 FROM masks WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx))
SELECT ticker, timeframe, idx, round(ln(100 * product(coalesce(lm, 1)) OVER w), 7) AS long_log, round(ln(100 * product(coalesce(sm, 1)) OVER w), 7) AS short_log
FROM step WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def aligned_equity(spark, sf):
    return A.aligned_equity(masked(spark, sf)[1]).select(
        *K3, "idx", F.round(F.ln("long_filtered"), 7).alias("long_log"), F.round(F.ln("short_filtered"), 7).alias("short_log"))


@register("masked_trades", with_(*HOLDS, """mm AS MATERIALIZED (SELECT ticker, timeframe, idx, long_mask, short_mask FROM masks)""",
                                 """tt AS MATERIALIZED (SELECT ticker, timeframe, id, type, entry_idx, exit_idx, exit_reason FROM trades)""",
                                 """hit AS MATERIALIZED (SELECT t.*, m.idx FROM tt t JOIN mm m ON m.ticker = t.ticker AND m.timeframe = t.timeframe
 WHERE m.idx >= t.entry_idx AND m.idx <= t.exit_idx AND CASE WHEN t.type = 'long' THEN m.long_mask ELSE m.short_mask END)""") + """
SELECT ticker, timeframe, id::INTEGER AS id, type, bool_or(idx = entry_idx) AS entry_masked, bool_or(idx = exit_idx AND exit_reason <> 'eod') AS exit_masked
FROM hit GROUP BY ticker, timeframe, id, type""")
def masked_trades(spark, sf):
    a, masks = masked(spark, sf)
    return A.masked_trades(a.trades, masks).select(*K3, "id", "type", "entry_masked", "exit_masked")


@register("run_all", with_(*LEVEL_TRADED, SUMMARY) + """SELECT ticker, timeframe, trades, wins, round(long_return, 4) AS long_return,
round(short_return, 4) AS short_return FROM summary WHERE timeframe = '1d'
UNION ALL SELECT ticker, timeframe, trades, wins, round(ln(long_return + 100), 6), round(ln(short_return + 100), 6) FROM summary WHERE timeframe = '60m'""")
def run_levels(spark, sf):
    whole, _ = run_all(two_levels(spark, sf), {"1d": LEVELS}, default=LEVELS)
    log = F.col("timeframe") == "60m"
    shape = lambda c: F.when(log, F.round(F.ln(F.col(c) + 100), 6)).otherwise(F.round(c, 4)).alias(c)
    return whole.summary.select(*K3, "trades", "wins", shape("long_return"), shape("short_return"))


COMBINED = with_(*LEVEL_TRADED) + """, lv AS (SELECT b.*, coalesce(h.sig, 0) AS s_hour, coalesce(d.sig, 0) AS s_day FROM (SELECT ticker, timeframe, idx, ts FROM r WHERE timeframe = '60m') b
 ASOF LEFT JOIN (SELECT ticker, ts, sig FROM r WHERE timeframe = '60m') h ON b.ticker = h.ticker AND b.ts >= h.ts
 ASOF LEFT JOIN (SELECT ticker, ts, sig FROM r WHERE timeframe = '1d') d ON b.ticker = d.ticker AND b.ts >= d.ts),
cb AS (SELECT *, (2 * s_hour + 3 * s_day) / 5.0::DOUBLE AS combined FROM lv)
"""


def combined(spark, sf):
    s = levels(spark, sf)[0].signal
    hour, day = s.where("timeframe = '60m'"), s.where("timeframe = '1d'")
    base = hour.select(*K3, "idx", "ts")
    return A.combine_signals(base, {"60m": (hour, 2.0), "1d": (day, 3.0)})


@register("combine_signals", COMBINED + """SELECT ticker, timeframe, idx, round(combined, 6) AS combined,
round((CASE WHEN sign(s_hour) <> sign(combined) THEN 2 ELSE 0 END + CASE WHEN sign(s_day) <> sign(combined) THEN 3 ELSE 0 END) / 5.0::DOUBLE, 6) AS disagreement FROM cb""")
def combine_signals(spark, sf):
    return combined(spark, sf).select(*K3, "idx", F.round("combined", 6).alias("combined"), F.round("disagreement", 6).alias("disagreement"))


@register("net_position", COMBINED + """SELECT ticker, timeframe, idx, CASE WHEN s_day = 0 THEN s_hour WHEN s_day = s_hour THEN s_day ELSE s_day * 0.5 END::DOUBLE AS net FROM cb""")
def net_positions(spark, sf):
    c = combined(spark, sf)
    up, low = F.coalesce(F.col("sig_1d"), F.lit(0)), F.coalesce(F.col("sig_60m"), F.lit(0))
    return c.select(*K3, "idx", net_position(up, low).alias("net"))


@register("gate_confirmed", with_(*LEVEL_TRADED) + """SELECT e.ticker, e.timeframe, e.entry_idx, e.type FROM entries e
JOIN r ON r.ticker = e.ticker AND r.timeframe = e.timeframe AND r.idx = e.entry_idx
ASOF JOIN (SELECT ticker, ts, sig FROM r WHERE timeframe = '1d') d ON r.ticker = d.ticker AND r.ts >= d.ts
WHERE e.timeframe = '60m' AND d.sig = CASE WHEN e.type = 'long' THEN 1 ELSE -1 END""")
def gate_confirmed(spark, sf):
    """Hourly entries that the daily signal confirms."""
    a, _ = levels(spark, sf)
    entered = entries(a.pairs, a.fits, LEVELS.n_ext)
    higher = A.asof_higher(a.signal, a.signal.withColumnRenamed("sig", "higher_sig"), ["higher_sig"])
    return gate(entered, higher, higher_sig="higher_sig").select(*K3, "entry_idx", "type")


FOUR = {"3mo": 4.0, "1mo": 3.0, "1wk": 2.0, "1d": 1.0}


def _four_sql() -> str:
    joins = "".join(f"\n ASOF LEFT JOIN (SELECT ticker, ts, sig FROM r WHERE timeframe = '{tf}') l{i} ON b.ticker = l{i}.ticker AND b.ts >= l{i}.ts" for i, tf in enumerate(FOUR))
    sums = " + ".join(f"{w} * coalesce(l{i}.sig, 0)" for i, w in enumerate(FOUR.values()))
    against = " + ".join(f"CASE WHEN sign(s{i}) <> sign(combined) THEN {w} ELSE 0 END" for i, w in enumerate(FOUR.values()))
    own = ", ".join(f"coalesce(l{i}.sig, 0) AS s{i}" for i in range(len(FOUR)))
    return with_(ORDER_TICKS, bars_sql("1d", "1wk", "1mo", "3mo"), S, filtered_sql(3), derived_sql(), trigger_sql(10), ROWS,
                 f"lv AS (SELECT b.*, {own}, ({sums}) / 10.0::DOUBLE AS combined FROM (SELECT ticker, timeframe, idx, ts FROM r WHERE timeframe = '1d') b{joins})") + f"""
SELECT ticker, timeframe, idx, round(combined, 6) AS combined, round(({against}) / 10.0::DOUBLE, 6) AS disagreement FROM lv"""


@register("combine_four_levels", _four_sql())
def combine_four_levels(spark, sf):
    """Quarters, months, weeks and days weigh 4 : 3 : 2 : 1, in one scan of the signals."""
    s = stored(signal_rows(stored(with_index(stored(calendar_bars(spark, sf)), bucket="year")), LEVELS))
    done = A.combine_levels(s.where("timeframe = '1d'").select(*K3, "idx", "ts"), s, FOUR)
    return done.select(*K3, "idx", F.round("combined", 6).alias("combined"), F.round("disagreement", 6).alias("disagreement"))

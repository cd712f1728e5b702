"""Inputs of the registered queries and the shared parts of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators.series import with_index
from tidebars.plans.analysis import Settings
from tidebars.sources.bars import ohlcv, ohlcv_all
from tidebars.sources.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tick_id"), F.col("event_type").alias("ticker"), "ts",
        F.col("value").alias("price"), F.col("value").alias("volume"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(ticks(spark, sf_dir), "60m", tie="tick_id")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars are stored first: numbering reads them twice, the ticks once."""
    return with_index(stored(hourly(spark, sf_dir)))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tick_id"), F.col("o_orderpriority").alias("ticker"),
        F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))


def calendar_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1d, 1wk, 1mo and 3mo bars of the orders, one ticker per priority."""
    return ohlcv_all(order_ticks(spark, sf_dir), ["1d", "1wk", "1mo", "3mo"], base="1d", tie="tick_id")


def two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60m and 1d bars of the events."""
    return ohlcv_all(ticks(spark, sf_dir), ["60m", "1d"], base="60m", tie="tick_id")


def stored(df: DataFrame) -> DataFrame:
    return materialize(df, "input")


HOURLY = Settings("sma", {"window": 11}, span=60, decimals=6)
LEVELS = Settings("sma", {"window": 3}, span=10, decimals=6)


# --- SQL -------------------------------------------------------------------

TICKS = """ticks AS (SELECT event_id AS tick_id, event_type AS ticker, ts, value AS price, value AS volume FROM events)"""

ORDER_TICKS = """ticks AS (SELECT o_orderkey AS tick_id, o_orderpriority AS ticker, o_orderdate AS ts,
  o_totalprice AS price, 1.0::DOUBLE AS volume FROM orders)"""

# SQL for the start of a bar.
BAR_START = {
    "1m": "date_trunc('minute', ts)",
    "5m": "time_bucket(INTERVAL '5 minutes', ts)",
    "15m": "time_bucket(INTERVAL '15 minutes', ts)",
    "60m": "date_trunc('hour', ts)",
    "1d": "date_trunc('day', ts)::TIMESTAMP",
    "1wk": "date_trunc('week', ts)::TIMESTAMP",
    "1mo": "date_trunc('month', ts)::TIMESTAMP",
    "3mo": "date_trunc('quarter', ts)::TIMESTAMP",
}


def bars_sql(*timeframes: str, name: str = "bars", source: str = "ticks") -> str:
    parts = [
        f"""SELECT ticker, '{tf}' AS timeframe, bar AS ts, first(price ORDER BY ts, tick_id) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, tick_id) AS close, sum(volume) AS volume
  FROM (SELECT *, {BAR_START[tf]} AS bar FROM {source}) GROUP BY ticker, bar"""
        for tf in timeframes
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


S = """s AS (SELECT *, row_number() OVER (PARTITION BY ticker, timeframe ORDER BY ts) - 1 AS idx,
  count(*) OVER (PARTITION BY ticker, timeframe) AS n FROM bars)"""


def slope_sql(x: str) -> str:
    return (f"CASE WHEN idx = 0 THEN lead({x}) OVER w - {x} WHEN idx = n - 1 THEN {x} - lag({x}) OVER w "
            f"ELSE (lead({x}) OVER w - lag({x}) OVER w) / 2 END")


W = "WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx)"


def filtered_sql(window: int = 11) -> str:
    h = window // 2
    return f"""f AS (SELECT *, round(sum(close) OVER (PARTITION BY ticker, timeframe ORDER BY idx
  ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) / {window}.0, 6) AS filtered FROM s)"""


def derived_sql() -> str:
    return f"""g0 AS (SELECT *, {slope_sql('filtered')} AS v FROM f {W}),
g AS (SELECT *, {slope_sql('v')} AS a FROM g0 {W})"""


def trigger_sql(span: int = 60, k: str = "0.15", floor: str = "0.05", source: str = "g", extra: str = "") -> str:
    """The trigger row by row, as a recursion over the row index."""
    al = f"(2.0::DOUBLE / {span + 1})"
    mu = f"({al} * g.v + (1 - {al}) * t.mu)"
    var = f"({al} * pow(g.v - {mu}, 2) + (1 - {al}) * t.var)"
    eps = f"round({k} * greatest(sqrt({var}), {floor}), 9)"
    eps0 = f"round({k} * {floor}, 9)"
    sig = f"""CASE WHEN t.sig = 0 AND round(g.a, 9) > {eps} AND round(g.v, 9) > 0 THEN 1
    WHEN t.sig = 0 AND round(g.a, 9) < -{eps} AND round(g.v, 9) < 0 THEN -1
    WHEN t.sig = 1 AND round(g.a, 9) < -{eps} THEN 0 WHEN t.sig = -1 AND round(g.a, 9) > {eps} THEN 0 ELSE t.sig END"""
    e = "".join(f", g.{c}" for c in extra.split(",") if c)
    return f"""t AS (SELECT g.ticker, g.timeframe, g.idx{e}, g.v AS mu, 0.0::DOUBLE AS var,
    CASE WHEN round(g.a, 9) > {eps0} AND round(g.v, 9) > 0 THEN 1
         WHEN round(g.a, 9) < -{eps0} AND round(g.v, 9) < 0 THEN -1 ELSE 0 END AS sig, 1 AS dur
  FROM {source} g WHERE g.idx = 0 AND g.n >= {span}
  UNION ALL
  SELECT g.ticker, g.timeframe, g.idx{e}, {mu} AS mu, {var} AS var, {sig} AS sig,
    CASE WHEN {sig} = t.sig THEN t.dur + 1 ELSE 1 END AS dur
  FROM t JOIN {source} g ON g.ticker = t.ticker AND g.timeframe = t.timeframe AND g.idx = t.idx + 1
    {" ".join(f"AND g.{c} = t.{c}" for c in extra.split(",") if c == "param_id")})"""


ROWS = """r AS (SELECT f.*, t.mu, sqrt(t.var) AS sigma, t.sig, t.dur
  FROM f JOIN t USING (ticker, timeframe, idx))"""

PAIRS = """live AS (SELECT *, lag(sig) OVER (PARTITION BY ticker, timeframe ORDER BY idx) AS prev FROM r WHERE sig <> 0),
starts AS (SELECT * FROM live WHERE prev IS NULL OR prev <> sig),
pairs0 AS (SELECT ticker, timeframe, row_number() OVER w - 1 AS pair_id, idx AS start_idx, lead(idx) OVER w AS end_idx,
  sig AS v1, lead(sig) OVER w AS v2, lead(filtered) OVER w AS y_end FROM starts
  WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx)),
pairs AS (SELECT * FROM pairs0 WHERE end_idx IS NOT NULL)"""

SEGMENTS = """seg AS (SELECT p.ticker, p.timeframe, p.pair_id, p.start_idx, p.end_idx, p.y_end, r.idx, r.filtered
  FROM pairs p JOIN r ON r.ticker = p.ticker AND r.timeframe = p.timeframe AND r.idx BETWEEN p.start_idx AND p.end_idx)"""

VERTEX = """fits AS (SELECT ticker, timeframe, pair_id, start_idx, end_idx,
  sum(pow(idx - end_idx, 2) * (filtered - y_end)) / sum(pow(idx - end_idx, 4)) AS a, 0.0::DOUBLE AS b, any_value(y_end) AS c,
  end_idx::DOUBLE AS x0 FROM seg WHERE end_idx - start_idx >= 3 GROUP BY ALL)"""


def trades_sql(stop: str = "2.0", n_ext: int = 8) -> str:
    pred = "(p.a * pow(b.idx - p.x0, 2) + p.b * (b.idx - p.x0) + p.c)"
    return f"""aimed AS (SELECT p.ticker, p.timeframe, p.pair_id, p.end_idx AS entry_idx, p.v2, f.a, f.b, f.c, f.x0,
    f.a * pow({n_ext} - 1, 2) + f.c > f.c AS up FROM pairs p JOIN fits f USING (ticker, timeframe, end_idx)),
entries AS (SELECT m.*, CASE WHEN v2 = 1 AND up THEN 'long' WHEN v2 = -1 AND NOT up THEN 'short' END AS type,
    r.filtered AS entry_price, r.n FROM aimed m JOIN r ON r.ticker = m.ticker AND r.timeframe = m.timeframe AND r.idx = m.entry_idx
    WHERE ((v2 = 1 AND up) OR (v2 = -1 AND NOT up)) AND r.filtered > 0),
hits AS (SELECT p.ticker, p.timeframe, p.entry_idx, b.idx,
    CASE WHEN b.idx <= p.entry_idx + {n_ext} AND {pred} > 0
          AND ((p.type = 'long' AND b.filtered < {pred} * (1 - {stop} / 100.0))
            OR (p.type = 'short' AND b.filtered > {pred} * (1 + {stop} / 100.0))) THEN 'stop_loss'
         WHEN (p.type = 'long' AND b.sig = -1) OR (p.type = 'short' AND b.sig = 1) THEN 'take_profit' END AS reason
    FROM entries p JOIN r b ON b.ticker = p.ticker AND b.timeframe = p.timeframe AND b.idx > p.entry_idx AND b.filtered > 0),
firsts AS (SELECT ticker, timeframe, entry_idx, min(idx) AS exit_idx, first(reason ORDER BY idx) AS reason
    FROM hits WHERE reason IS NOT NULL GROUP BY ALL),
exits AS (SELECT e.*, coalesce(x.exit_idx, e.n - 1) AS exit_idx, coalesce(x.reason, 'eod') AS exit_reason
    FROM entries e LEFT JOIN firsts x USING (ticker, timeframe, entry_idx) WHERE coalesce(x.exit_idx, e.n - 1) > e.entry_idx),
trades AS (SELECT e.ticker, e.timeframe, row_number() OVER (PARTITION BY e.ticker, e.timeframe ORDER BY e.entry_idx) AS id,
    e.type, e.entry_idx, e.exit_idx, e.entry_price, r.filtered AS exit_price,
    CASE WHEN e.type = 'long' THEN (r.filtered - e.entry_price) / e.entry_price
         ELSE (e.entry_price - r.filtered) / e.entry_price END * 100 AS return_pct, e.exit_reason
    FROM exits e JOIN r ON r.ticker = e.ticker AND r.timeframe = e.timeframe AND r.idx = e.exit_idx WHERE r.filtered > 0)"""


CAPITAL = """cap AS (SELECT *, coalesce(100 * product(1 + return_pct / 100) OVER (PARTITION BY ticker, timeframe, type ORDER BY entry_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100) AS capital_before,
  100 * product(1 + return_pct / 100) OVER (PARTITION BY ticker, timeframe, type ORDER BY entry_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capital_after FROM trades)"""

EQUITY = """eq AS (SELECT r.*,
    CASE WHEN l.entry_idx IS NULL THEN 100.0 WHEN r.idx <= l.exit_idx
      THEN l.capital_before * (1 + (r.filtered - l.entry_price) / l.entry_price) ELSE l.capital_after END AS long_pnl,
    CASE WHEN h.entry_idx IS NULL THEN 100.0 WHEN r.idx <= h.exit_idx
      THEN h.capital_before * (1 + (h.entry_price - r.filtered) / h.entry_price) ELSE h.capital_after END AS short_pnl
  FROM r ASOF LEFT JOIN (SELECT * FROM cap WHERE type = 'long') l
    ON r.ticker = l.ticker AND r.timeframe = l.timeframe AND r.idx >= l.entry_idx
  ASOF LEFT JOIN (SELECT * FROM cap WHERE type = 'short') h
    ON r.ticker = h.ticker AND r.timeframe = h.timeframe AND r.idx >= h.entry_idx)"""

SUMMARY = """peaks AS (SELECT *, max(long_pnl) OVER w AS lp, max(short_pnl) OVER w AS sp FROM eq
    WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx)),
curve AS (SELECT ticker, timeframe, last(long_pnl ORDER BY idx) - 100 AS long_return, last(short_pnl ORDER BY idx) - 100 AS short_return,
    min((long_pnl - lp) / lp * 100) AS long_drawdown, min((short_pnl - sp) / sp * 100) AS short_drawdown FROM peaks GROUP BY ALL),
deals AS (SELECT ticker, timeframe, count(*) AS trades, count_if(return_pct > 0) AS wins FROM trades GROUP BY ALL),
summary AS (SELECT c.*, coalesce(d.trades, 0)::BIGINT AS trades, coalesce(d.wins, 0)::BIGINT AS wins, c.long_return + c.short_return AS total_return
    FROM curve c LEFT JOIN deals d USING (ticker, timeframe))"""

HIGHER = """tf_dim AS (SELECT * FROM (VALUES ('1m','5m'),('5m','15m'),('15m','60m'),('60m','1d'),('1d','1wk'),('1wk','1mo'),
  ('1mo','3mo'),('3mo',NULL)) d(timeframe, higher_tf))"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


SERIES = (TICKS, bars_sql("60m"), S)
SMOOTH = (*SERIES, filtered_sql(11), derived_sql())
SIGNAL = (*SMOOTH, trigger_sql(60), ROWS)
TRADED = (*SIGNAL, PAIRS, SEGMENTS, VERTEX, trades_sql(), CAPITAL, EQUITY)
LEVEL_TRADED = (TICKS, bars_sql("60m", "1d"), S, filtered_sql(3), derived_sql(), trigger_sql(10), ROWS, PAIRS, SEGMENTS,
                VERTEX, trades_sql(), CAPITAL, EQUITY)

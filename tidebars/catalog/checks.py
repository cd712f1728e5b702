"""Registered queries: completeness, statistics, merges, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import (
    ORDER_TICKS, SERIES, TICKS, S, bars_sql, calendar_bars, hourly, indexed, order_ticks, register, table, ticks, with_,
)
from tidebars.catalog.storage import BAR_COLS, NULLED, _bar_cols, nulled_bars
from tidebars.functions.scalars import start_of
from tidebars.operators import quality as Q
from tidebars.sources.bars import coarser, ohlcv, ohlcv_all

CAL = with_(ORDER_TICKS, bars_sql("1d", "1wk", "1mo", "3mo"))
AS_OF = "2001-08-12"

# A base that ends early and a second source that starts late and differs.
TWO = f"""ticks AS (SELECT event_id AS tick_id, event_type AS ticker, ts, value AS price, value AS volume FROM events),
ticks2 AS (SELECT tick_id, ticker, ts, CASE WHEN tick_id % 97 = 0 THEN price + 1 ELSE price END AS price, volume FROM ticks),
{bars_sql('60m', name='all1')}, {bars_sql('60m', name='all2', source='ticks2')},
base AS (SELECT * FROM all1 WHERE ts < TIMESTAMP '2024-01-28'),
other AS (SELECT * FROM all2 WHERE ts >= TIMESTAMP '2024-01-03')"""


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


def base_and_other(spark, sf):
    t = ticks(spark, sf)
    t2 = t.withColumn("price", F.when(F.col("tick_id") % 97 == 0, F.col("price") + 1).otherwise(F.col("price")))
    base = ohlcv(t.where(F.col("ts") < _at("2024-01-28")), "60m", tie="tick_id")
    return base, ohlcv(t2.where(F.col("ts") >= _at("2024-01-03")), "60m", tie="tick_id")


def _days(df):
    """Days as text, so that both engines hand out the same type."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})


@register("date_range", CAL + "SELECT ticker, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY ticker")
def date_range(spark, sf):
    return Q.date_range(calendar_bars(spark, sf))


@register("has_data", """SELECT n_name AS ticker, n_name IN (SELECT c_mktsegment FROM customer)
OR n_name IN (SELECT o_orderpriority FROM orders) AS has_data FROM (SELECT n_name FROM nation UNION SELECT o_orderpriority FROM orders)""")
def has_data(spark, sf):
    wanted = table(spark, sf, "nation").select(F.col("n_name").alias("ticker")).union(
        table(spark, sf, "orders").select("o_orderpriority")).distinct()
    return Q.has_data(calendar_bars(spark, sf), wanted)


@register("tickers", CAL + "SELECT DISTINCT ticker FROM bars")
def tickers(spark, sf):
    return Q.tickers(calendar_bars(spark, sf))


@register("timeframes", CAL + "SELECT DISTINCT ticker, timeframe FROM bars")
def timeframes(spark, sf):
    return Q.timeframes(calendar_bars(spark, sf))


@register("completeness", with_(NULLED, bars_sql("60m")) + """SELECT ticker, timeframe, count(*) AS "rows", min(ts::DATE)::VARCHAR AS first_day,
max(ts::DATE)::VARCHAR AS last_day, count_if(close IS NULL)::BIGINT AS null_close FROM bars GROUP BY ALL""")
def completeness(spark, sf):
    return _days(Q.completeness(nulled_bars(spark, sf)))


GAPS = """gap AS (SELECT ticker, timeframe, count_if(epoch_us(ts) - epoch_us(prev) > 3 * CASE timeframe WHEN '60m' THEN 3600000000 ELSE 86400000000 END)::BIGINT AS gaps
  FROM (SELECT *, lag(ts) OVER (PARTITION BY ticker, timeframe ORDER BY ts) AS prev FROM bars WHERE timeframe IN ('60m', '1d')) GROUP BY ALL)"""

USER_TICKS = "ticks AS (SELECT event_id AS tick_id, user_id::VARCHAR AS ticker, ts, value AS price, value AS volume FROM events)"


def user_bars(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_id").alias("tick_id"), F.col("user_id").cast("string").alias("ticker"), "ts",
                                         F.col("value").alias("price"), F.col("value").alias("volume"))
    return ohlcv_all(t, ["60m", "1d"], base="60m", tie="tick_id")


@register("gap_count", with_(USER_TICKS, bars_sql("60m", "1d"), GAPS) + "SELECT ticker, timeframe, gaps FROM gap")
def gap_count(spark, sf):
    return Q.gap_count(user_bars(spark, sf))


@register("staleness", CAL + f"""SELECT ticker, timeframe, max(ts::DATE)::VARCHAR AS last_day, (DATE '{AS_OF}' - max(ts::DATE))::INTEGER AS age_days,
DATE '{AS_OF}' - max(ts::DATE) > 7 AS stale FROM bars WHERE timeframe = '1d' GROUP BY ALL""")
def staleness(spark, sf):
    return _days(Q.staleness(calendar_bars(spark, sf), AS_OF))


HEALTH = with_(NULLED, bars_sql("60m", "1d"), GAPS, """health AS (SELECT *, CASE WHEN stale THEN 'stale' ELSE found END AS status,
  (CASE WHEN found = 'ok' THEN 0 ELSE 1 END + CASE WHEN stale THEN 1 ELSE 0 END)::INTEGER AS warnings FROM (
  SELECT b.*, g.gaps, timeframe = '1d' AND DATE '2024-02-05' - last_day > 7 AS stale,
   CASE WHEN null_close > 0 THEN 'null_values' WHEN gaps > 0 THEN 'gaps' ELSE 'ok' END AS found
  FROM (SELECT ticker, timeframe, count(*) AS "rows", min(ts::DATE) AS first_day, max(ts::DATE) AS last_day,
   count_if(close IS NULL)::BIGINT AS null_close FROM bars GROUP BY ALL) b JOIN gap g USING (ticker, timeframe)))""")


def _health(spark, sf):
    t = ticks(spark, sf).withColumn("price", F.when(F.col("tick_id") % 53 != 0, F.col("price")))
    return Q.data_health(ohlcv_all(t, ["60m", "1d"], base="60m", tie="tick_id"), "2024-02-05")


@register("data_health", HEALTH + 'SELECT ticker, timeframe, "rows", first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, null_close, gaps, status, warnings FROM health')
def data_health(spark, sf):
    return _days(_health(spark, sf))


@register("health_summary", HEALTH + """SELECT count(DISTINCT ticker) AS tickers, count(*) AS series, sum(warnings)::BIGINT AS warnings,
CASE WHEN count(*) = 0 THEN 'error' WHEN sum(warnings) > 0 THEN 'warn' ELSE 'ok' END AS status FROM health""")
def health_summary(spark, sf):
    return Q.health_summary(_health(spark, sf))


@register("series_stats", CAL + """SELECT ticker, timeframe, round(stddev_pop(close), 4) AS sigma, last(close ORDER BY ts) AS last_close,
count(*) AS points FROM bars GROUP BY ALL""")
def series_stats(spark, sf):
    return Q.series_stats(calendar_bars(spark, sf)).withColumn("sigma", F.round("sigma", 4))


@register("top_sets", """SELECT p_type AS category, p_partkey AS name, p_retailprice AS score, row_number() OVER
(PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 5""")
def top_sets(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("score"))
    return Q.top_sets(s, 5).withColumn("rank", F.col("rank").cast("long"))


@register("common_ts", with_(TWO) + "SELECT ticker, timeframe, ts FROM base INTERSECT SELECT ticker, timeframe, ts FROM other")
def common_ts(spark, sf):
    return Q.common_ts(*base_and_other(spark, sf))


@register("only_in", with_(TWO) + """SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.timeframe, b.timeframe) AS timeframe,
coalesce(only_a, 0)::BIGINT AS only_a, coalesce(only_b, 0)::BIGINT AS only_b
FROM (SELECT ticker, timeframe, count(*) AS only_a FROM base ANTI JOIN other USING (ticker, timeframe, ts) GROUP BY ALL) a
FULL JOIN (SELECT ticker, timeframe, count(*) AS only_b FROM other ANTI JOIN base USING (ticker, timeframe, ts) GROUP BY ALL) b
ON a.ticker = b.ticker AND a.timeframe = b.timeframe""")
def only_in(spark, sf):
    return Q.only_in(*base_and_other(spark, sf))


LINE = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || ':' || printf('%.4f', close)"


@register("fingerprint", CAL + f"SELECT ticker, timeframe, md5(string_agg({LINE}, '' ORDER BY ts)) AS fingerprint FROM bars GROUP BY ALL")
def fingerprint(spark, sf):
    return Q.fingerprint(calendar_bars(spark, sf))


@register("fingerprint_by_year", CAL + f"""SELECT ticker, timeframe, md5(string_agg(d, '' ORDER BY part)) AS fingerprint FROM (
SELECT ticker, timeframe, date_trunc('year', ts) AS part, md5(string_agg({LINE}, '' ORDER BY ts)) AS d FROM bars GROUP BY ALL) GROUP BY ALL""")
def fingerprint_by_year(spark, sf):
    return Q.fingerprint_by(calendar_bars(spark, sf), "year")


MERGED = """, newest AS (SELECT ticker, timeframe, max(ts) AS m FROM base GROUP BY ALL),
ranked AS (SELECT *, 1 AS c FROM base UNION ALL BY NAME
  SELECT o.*, CASE WHEN o.ts >= m THEN 0 ELSE 2 END AS c FROM other o LEFT JOIN newest USING (ticker, timeframe))
"""


@register("merge_bars", with_(TWO) + MERGED + f"""SELECT {BAR_COLS} FROM (SELECT * FROM ranked
QUALIFY row_number() OVER (PARTITION BY ticker, timeframe, ts ORDER BY c) = 1)""")
def merge_bars(spark, sf):
    return _bar_cols(Q.merge_bars(*base_and_other(spark, sf)))


@register("merge_bars_repeated", """WITH raw AS (SELECT 'x' || (user_id % 5) AS ticker, '1d' AS timeframe, date_trunc('day', ts)::TIMESTAMP AS ts, value AS close, event_id FROM events),
base AS (SELECT * FROM raw WHERE event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY event_id) = 1),
newest AS (SELECT ticker, max(ts) AS m FROM base GROUP BY ALL),
ranked AS (SELECT ticker, timeframe, ts, close, 1 AS c, 0 AS o FROM base UNION ALL
 SELECT r.ticker, r.timeframe, r.ts, r.close, CASE WHEN r.ts >= m THEN 0 ELSE 2 END, CASE WHEN r.ts >= m THEN -event_id ELSE event_id END
 FROM raw r JOIN newest USING (ticker) WHERE event_id % 10 <> 0)
SELECT ticker, timeframe, ts, close FROM ranked QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY c, o) = 1""")
def merge_bars_repeated(spark, sf):
    """A batch with repeated stamps: first fills, last replaces."""
    from pyspark.sql import Window

    raw = table(spark, sf, "events").select(
        F.concat(F.lit("x"), (F.col("user_id") % 5).cast("string")).alias("ticker"), F.lit("1d").alias("timeframe"),
        start_of("day", F.col("ts")).alias("ts"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close", "volume")],
        "event_id")
    first = Window.partitionBy("ticker", "ts").orderBy("event_id")
    base = raw.where("event_id % 10 = 0").where(F.col("ts") < _at("2024-01-20")).withColumn(
        "_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "event_id")
    return Q.merge_bars(base, raw.where("event_id % 10 <> 0"), "event_id").select("ticker", "timeframe", "ts", "close")


@register("force_merge", with_(TWO) + f"""SELECT {BAR_COLS} FROM other UNION ALL
SELECT {BAR_COLS} FROM base ANTI JOIN other USING (ticker, timeframe, ts)""")
def force_merge(spark, sf):
    return _bar_cols(Q.force_merge(*base_and_other(spark, sf)))


JOINED = """, both_sides AS (SELECT ticker, timeframe, ts, a.close AS ca, b.close AS cb, a.ticker IS NOT NULL AS in_a, b.ticker IS NOT NULL AS in_b
 FROM base a FULL JOIN other b USING (ticker, timeframe, ts))
"""


@register("compare_bars", with_(TWO) + JOINED + """SELECT ticker, timeframe, count_if(in_a)::BIGINT AS base_count, count_if(in_b)::BIGINT AS other_count,
count_if(in_a AND in_b)::BIGINT AS overlap, count_if(NOT in_b)::BIGINT AS only_base, count_if(NOT in_a)::BIGINT AS only_other,
count_if(in_a AND in_b AND abs(ca - cb) > 1e-6)::BIGINT AS diffs,
strftime(min(ts) FILTER (in_a), '%Y-%m-%d') AS base_start, strftime(max(ts) FILTER (in_b), '%Y-%m-%d') AS other_end,
md5(string_agg(strftime(ts, '%Y%m%d%H') || printf('%.4f', ca), '' ORDER BY ts) FILTER (in_a AND in_b)) =
md5(string_agg(strftime(ts, '%Y%m%d%H') || printf('%.4f', cb), '' ORDER BY ts) FILTER (in_a AND in_b)) AS fingerprint_match,
CASE WHEN count_if(in_a AND in_b AND printf('%.4f', ca) <> printf('%.4f', cb)) > 0 THEN 'conflict'
 WHEN count_if(NOT in_a) > 0 THEN 'update_available' ELSE 'ok' END AS status FROM both_sides GROUP BY ALL""")
def compare_bars(spark, sf):
    return Q.compare_bars(*base_and_other(spark, sf)).select(
        "ticker", "timeframe", "base_count", "other_count", "overlap", "only_base", "only_other", "diffs", "base_start", "other_end",
        "fingerprint_match", "status")


@register("close_diffs", with_(TWO) + JOINED + """SELECT ticker, timeframe, ts, round(ca, 4) AS base_close, round(cb, 4) AS other_close
FROM both_sides WHERE in_a AND in_b AND abs(ca - cb) > 1e-6""")
def close_diffs(spark, sf):
    return Q.close_diffs(*base_and_other(spark, sf))


@register("backfill_close", with_(ORDER_TICKS, bars_sql("1d", "1wk"), """cut AS (SELECT * REPLACE (CASE WHEN timeframe = '1d' AND
 (ts = max(ts) OVER (PARTITION BY ticker, timeframe) OR day(ts) = 13) THEN NULL ELSE close END AS close) FROM bars),
wk AS (SELECT ticker, last(close ORDER BY ts) AS w FROM cut WHERE timeframe = '1wk' GROUP BY ALL)""") + """SELECT ticker, timeframe, ts,
CASE WHEN timeframe = '1d' AND ts = max(ts) OVER (PARTITION BY ticker, timeframe) THEN coalesce(close, w) ELSE close END AS close FROM cut JOIN wk USING (ticker)""")
def backfill_close(spark, sf):
    bars = coarser(ohlcv(order_ticks(spark, sf), "1d", tie="tick_id"), ["1d", "1wk"])
    newest = bars.where("timeframe = '1d'").groupBy("ticker").agg(F.max("ts").alias("m"))
    gone = (F.col("timeframe") == "1d") & ((F.col("ts") == F.col("m")) | (F.dayofmonth("ts") == 13))
    cut = bars.join(newest, "ticker").withColumn("close", F.when(~gone, F.col("close"))).drop("m")
    return Q.backfill_close(cut).select("ticker", "timeframe", "ts", "close")


@register("bad_quotes", with_(*SERIES) + """SELECT ticker, timeframe, idx, prev_close, round((close - prev_close) / prev_close, 6) AS move FROM
(SELECT *, lag(close) OVER (PARTITION BY ticker, timeframe ORDER BY idx) AS prev_close FROM s) WHERE abs((close - prev_close) / prev_close) > 0.1""")
def bad_quotes(spark, sf):
    return Q.bad_quotes(indexed(spark, sf)).select("ticker", "timeframe", "idx", "prev_close", F.round("move", 6).alias("move"))

"""Registered queries: bars, windows, scalars, parameter tables, storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebars.catalog.base import (
    BAR_START, ORDER_TICKS, S, SERIES, TICKS, bars_sql, calendar_bars, hourly, indexed, order_ticks, register, stored, table, ticks, with_,
)
from tidebars.functions import scalars as C
from tidebars.operators.series import with_index
from tidebars.schema import TIMEFRAMES
from tidebars.sources import bars as B
from tidebars.sources import params as P
from tidebars.sources import storage as ST

BAR_COLS = "ticker, timeframe, ts, open, high, low, close, round(volume, 4) AS volume"


def _bar_cols(df):
    return df.select("ticker", "timeframe", "ts", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


@register("bars_60m", with_(TICKS, bars_sql("60m")) + f"SELECT {BAR_COLS} FROM bars")
def bars_60m(spark, sf):
    return _bar_cols(hourly(spark, sf))


@register("read_bars", with_(TICKS, bars_sql("60m", "1d")) + f"SELECT {BAR_COLS} FROM bars WHERE timeframe = '1d' AND ts >= TIMESTAMP '2024-01-10'")
def read_bars(spark, sf):
    """Bars written by timeframe; the filters prune folders and row groups."""
    path = f"{ST.scratch_root(spark)}/bars-{uuid.uuid4().hex}"
    B.ohlcv_all(ticks(spark, sf), ["60m", "1d"], base="60m", tie="tick_id").write.partitionBy("timeframe").parquet(path)
    day = F.lit("2024-01-10").cast("timestamp_ntz")
    return _bar_cols(B.read_bars(spark, path).where((F.col("timeframe") == "1d") & (F.col("ts") >= day)))


@register("bars_all_timeframes", with_(TICKS, bars_sql(*BAR_START)) + f"SELECT {BAR_COLS} FROM bars")
def bars_all_timeframes(spark, sf):
    return _bar_cols(B.ohlcv_all(ticks(spark, sf), list(BAR_START), tie="tick_id"))


@register("bars_calendar", with_(ORDER_TICKS, bars_sql("1d", "1wk", "1mo", "3mo")) + f"SELECT {BAR_COLS} FROM bars")
def bars_calendar(spark, sf):
    return _bar_cols(calendar_bars(spark, sf))


@register("bars_per_user", "WITH ticks AS (SELECT event_id AS tick_id, user_id::VARCHAR AS ticker, ts, value AS price, value AS volume FROM events), "
          + bars_sql("1d") + f" SELECT {BAR_COLS} FROM bars")
def bars_per_user(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_id").alias("tick_id"), F.col("user_id").alias("ticker"), "ts",
                                         F.col("value").alias("price"), F.col("value").alias("volume"))
    return _bar_cols(B.ohlcv(t, "1d", tie="tick_id"))


@register("bars_per_supplier", """WITH ticks AS (SELECT l_orderkey * 10 + l_linenumber AS tick_id, l_suppkey::VARCHAR AS ticker,
  l_shipdate AS ts, l_extendedprice AS price, l_quantity AS volume, l_partkey AS p FROM lineitem),
bars AS (SELECT ticker, '1mo' AS timeframe, date_trunc('month', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, tick_id, price, volume) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, tick_id, price, volume) AS close, sum(volume) AS volume FROM ticks GROUP BY ALL)
SELECT ticker, timeframe, ts, open, high, low, close, round(volume, 4) AS volume FROM bars""")
def bars_per_supplier(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tick_id"), "l_extendedprice", "l_quantity").alias("tick_id"), F.col("l_suppkey").alias("ticker"),
        F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("volume"))
    # order and line number repeat within a day, so price and quantity order the rest
    return B.ohlcv(t, "1mo", tie="tick_id").select("ticker", "timeframe", "ts", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


NULLED = """ticks AS (SELECT event_id AS tick_id, event_type AS ticker, ts,
  CASE WHEN event_id % 53 <> 0 THEN value END AS price, value AS volume FROM events)"""


def nulled_bars(spark, sf):
    t = ticks(spark, sf).withColumn("price", F.when(F.col("tick_id") % 53 != 0, F.col("price")))
    return B.ohlcv(t, "60m", tie="tick_id")


@register("valid_close", with_(NULLED, bars_sql("60m")) + f"SELECT {BAR_COLS} FROM bars WHERE close IS NOT NULL")
def valid_close(spark, sf):
    return _bar_cols(B.valid_close(nulled_bars(spark, sf)))


@register("for_series", with_(TICKS, bars_sql("60m")) + f"SELECT {BAR_COLS} FROM bars WHERE ticker = 'view' AND timeframe = '60m'")
def for_series(spark, sf):
    return _bar_cols(B.for_series(hourly(spark, sf), "view", "60m"))


@register("before_offset", with_(TICKS, bars_sql("60m")) + f"""SELECT {BAR_COLS} FROM bars
QUALIFY ts <= max(ts) OVER (PARTITION BY ticker, timeframe) - INTERVAL 5 DAY""")
def before_offset(spark, sf):
    return _bar_cols(B.before_offset(hourly(spark, sf), 5))


@register("latest_120", with_(TICKS, bars_sql("60m")) + f"""SELECT {BAR_COLS} FROM bars
QUALIFY row_number() OVER (PARTITION BY ticker, timeframe ORDER BY ts DESC) <= 120""")
def latest_120(spark, sf):
    return _bar_cols(B.latest_n(hourly(spark, sf), 120))


@register("latest_120_before", with_(TICKS, bars_sql("60m")) + f"""SELECT {BAR_COLS} FROM (SELECT * FROM bars
QUALIFY ts <= max(ts) OVER (PARTITION BY ticker, timeframe) - INTERVAL 10 DAY)
QUALIFY row_number() OVER (PARTITION BY ticker, timeframe ORDER BY ts DESC) <= 120""")
def latest_120_before(spark, sf):
    return _bar_cols(B.latest_n(hourly(spark, sf), 120, day_offset=10))


LOOKBACK = ", ".join(f"('{t[0]}', {t[4] if t[4] else 'NULL'})" for t in TIMEFRAMES)


@register("within_lookback", with_(TICKS, bars_sql("1m", "60m")) + f"""SELECT {BAR_COLS} FROM bars
JOIN (VALUES {LOOKBACK}) d(tf, days) ON d.tf = timeframe
QUALIFY days IS NULL OR ts >= max(ts) OVER (PARTITION BY ticker, timeframe) - to_days(days::INTEGER)""")
def within_lookback(spark, sf):
    return _bar_cols(B.within_lookback(B.ohlcv_all(ticks(spark, sf), ["1m", "60m"], tie="tick_id")))


@register("window_round_trip", with_(TICKS, bars_sql("60m"), "bars1 AS (SELECT * FROM bars QUALIFY row_number() OVER "
          "(PARTITION BY ticker, timeframe ORDER BY ts DESC) <= 120)") + """SELECT ticker, timeframe, ts, close,
row_number() OVER (PARTITION BY ticker, timeframe ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY ticker, timeframe) AS n FROM bars1""")
def window_round_trip(spark, sf):
    path = f"{ST.scratch_root(spark)}/window-{uuid.uuid4().hex}"
    B.write_window(B.latest_n(hourly(spark, sf), 120), path)
    return B.read_window(spark, path).select("ticker", "timeframe", "ts", "close", "idx", "n")


@register("with_index", with_(*SERIES) + "SELECT ticker, timeframe, ts, close, idx, n FROM s")
def series_index(spark, sf):
    return indexed(spark, sf).select("ticker", "timeframe", "ts", "close", "idx", "n")


@register("calendar_flag", with_(ORDER_TICKS, bars_sql("1d", "1wk", "1mo", "3mo"), S) + """SELECT ticker, timeframe, idx,
CASE WHEN timeframe = '1d' THEN isodow(ts) = 1 WHEN timeframe = '1wk' THEN coalesce(month(ts) <> month(lag(ts) OVER
 (PARTITION BY ticker, timeframe ORDER BY ts)), false) ELSE month(ts) = 1 END AS flag FROM s""")
def calendar_flag(spark, sf):
    return B.calendar_flag(with_index(calendar_bars(spark, sf), bucket="year")).select("ticker", "timeframe", "idx", "flag")


@register("day_flag", with_(*SERIES) + """SELECT ticker, timeframe, idx,
coalesce(ts::DATE <> lag(ts::DATE) OVER (PARTITION BY ticker, timeframe ORDER BY ts), false) AS flag FROM s""")
def day_flag(spark, sf):
    return B.calendar_flag(indexed(spark, sf)).select("ticker", "timeframe", "idx", "flag")


@register("normalize_symbol", """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' ELSE 'US' END AS market,
 CASE WHEN c_custkey % 3 = 2 THEN lower(c_mktsegment) ELSE c_custkey::VARCHAR END AS code FROM customer)
SELECT c_custkey, CASE market WHEN 'CN' THEN code || CASE WHEN substr(code, 1, 1) = '6' THEN '.SS' ELSE '.SZ' END
 WHEN 'HK' THEN CASE WHEN length(code) < 4 THEN lpad(code, 4, '0') ELSE code END || '.HK' ELSE upper(code) END AS symbol FROM c""")
def normalize_symbol(spark, sf):
    k = F.col("c_custkey")
    market = F.when(k % 3 == 0, "CN").when(k % 3 == 1, "HK").otherwise("US")
    code = F.when(k % 3 == 2, F.lower("c_mktsegment")).otherwise(k.cast("string"))
    return table(spark, sf, "customer").select("c_custkey", C.normalize_symbol(market, code).alias("symbol"))


@register("date_scalars", """SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day, round(epoch_us(o_orderdate) / 86400000000.0 + 2440587.5, 6) AS julian,
o_orderdate - INTERVAL 5 DAY AS earlier, strftime(o_orderdate, '%Y-%m-%d') AS day_text FROM orders""")
def date_scalars(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", C.day_of(d).cast("string").alias("day"), F.round(C.julian_day(d), 6).alias("julian"),
        C.minus_days(d, 5).alias("earlier"), C.date_text(d).alias("day_text"))


@register("number_format", "SELECT event_id, printf('%.4f', value) AS text4, round(value, 1) AS r1, round(value / 3, 6) AS r6 FROM events")
def number_format(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.fixed4(F.col("value")).alias("text4"), F.round("value", 1).alias("r1"), F.round(F.col("value") / 3, 6).alias("r6"))


@register("wall_clock", """SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts, date_trunc('second', ts) AS stripped FROM events""")
def wall_clock(spark, sf):
    e = table(spark, sf, "events")
    zoned = F.col("ts").cast("timestamp")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    return e.select("event_id", C.wall_clock(zoned, "Asia/Hong_Kong").alias("local_ts"), C.text_wall_clock(text).alias("stripped"))


@register("finite_or_null", """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value FROM events""")
def finite_or_null(spark, sf):
    m = F.col("event_id") % 7
    v = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", C.finite_or_null(v).alias("value"))


# --- parameter tables ------------------------------------------------------

RAW = """raw AS (SELECT p_brand || '_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '_DP' WHEN 1 THEN '_QS' ELSE '' END AS name,
  CASE WHEN p_partkey % 11 = 0 THEN '{broken' ELSE '{"market":"HK"' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',"ticker":"' || p_partkey || '"' END
   || ',"global_f":"sma","v0_tf":"60分钟","v0_ke":' || (p_size / 100.0)::DECIMAL(8,2) || ',"v1_n":"' || p_size || '","窗口大小_v0_f1_sma":' || p_size || '}' END AS params_json,
  p_partkey, p_size FROM part)"""


def raw_sets(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    suffix = F.when(k % 3 == 0, "_DP").when(k % 3 == 1, "_QS").otherwise("")
    ticker = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',"ticker":"'), k.cast("string"), F.lit('"')))
    text = F.concat(
        F.lit('{"market":"HK"'), ticker, F.lit(',"global_f":"sma","v0_tf":"60分钟","v0_ke":'),
        (size / 100.0).cast("decimal(8,2)").cast("string"), F.lit(',"v1_n":"'), size.cast("string"),
        F.lit('","窗口大小_v0_f1_sma":'), size.cast("string"), F.lit("}"))
    return table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("_"), k.cast("string"), suffix).alias("name"),
        F.when(k % 11 == 0, "{broken").otherwise(text).alias("params_json"))


@register("describe_sets", with_(RAW) + """SELECT name, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 5 = 0 THEN name ELSE 'HK·' || p_partkey END AS description,
CASE WHEN name LIKE '%\\_DP' ESCAPE '\\' THEN 'dual' WHEN name LIKE '%\\_QS' ESCAPE '\\' THEN 'quick' ELSE 'single' END AS category,
NOT json_valid(params_json) AS broken FROM raw""")
def describe_sets(spark, sf):
    return P.describe_sets(raw_sets(spark, sf)).select("name", "description", "category", "broken")


@register("typed_params", with_(RAW) + """SELECT name, CASE WHEN json_valid(params_json) THEN params_json ->> '$.v0_ke' END AS k_eps,
coalesce(CASE WHEN json_valid(params_json) THEN (params_json ->> '$.v1_n')::INTEGER END, -1) AS n FROM raw""")
def typed_params(spark, sf):
    return P.typed_params(raw_sets(spark, sf)).select(
        "name", F.try_element_at("params", F.lit("v0_ke")).alias("k_eps"),
        F.expr("coalesce(try_cast(try_element_at(params, 'v1_n') as int), -1)").alias("n"))


@register("params_by_view", with_(RAW) + """SELECT name, 0 AS "view", '60分钟' AS tf, (p_size / 100.0)::DECIMAL(8,2)::DOUBLE AS ke, NULL::VARCHAR AS n,
p_size::DOUBLE AS "window", 'sma' AS filter FROM raw WHERE p_partkey % 11 <> 0
UNION ALL SELECT name, 1, NULL, NULL, p_size::VARCHAR, NULL, 'sma' FROM raw WHERE p_partkey % 11 <> 0""")
def params_by_view(spark, sf):
    return P.params_by_view(raw_sets(spark, sf)).select(
        "name", "view", "tf", F.col("ke").cast("double").alias("ke"), "n", F.try_element_at("filter_params", F.lit("window")).alias("window"), "filter")


@register("with_defaults", with_(RAW) + """SELECT name, 0 AS "view", '60m' AS timeframe, round(p_size / 100.0, 2)::DOUBLE AS k_eps, 120 AS n, 60 AS ewma_span,
'parabola' AS fit_mode, 2.0::DOUBLE AS stop_loss_pct,
 CASE WHEN greatest(3, least(101, p_size)) % 2 = 0 THEN greatest(3, least(101, p_size)) + 1 ELSE greatest(3, least(101, p_size)) END::DOUBLE AS "window" FROM raw WHERE p_partkey % 11 <> 0
UNION ALL SELECT name, 1, '1d', 0.15, p_size, 60, 'parabola', 2.0, 11.0 FROM raw WHERE p_partkey % 11 <> 0""")
def with_defaults(spark, sf):
    v = P.repair_params(P.with_defaults(P.params_by_view(raw_sets(spark, sf))))
    return v.select("name", "view", "timeframe", "k_eps", "n", "ewma_span", "fit_mode", "stop_loss_pct",
                    F.try_element_at("filter_params", F.lit("window")).alias("window"))


@register("with_param_names", """SELECT l_orderkey, l_linenumber, p_brand || '_' || (p_partkey % 50) AS name, p_type AS category
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def with_param_names(spark, sf):
    sets = table(spark, sf, "part").select(
        F.col("p_partkey").alias("param_id"),
        F.concat("p_brand", F.lit("_"), (F.col("p_partkey") % 50).cast("string")).alias("name"), F.col("p_type").alias("category"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("param_id"))
    return P.with_param_names(rows, sets).select("l_orderkey", "l_linenumber", "name", "category")


@register("versions", """SELECT 'restored' AS part, o_orderpriority AS ticker, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY ALL
UNION ALL SELECT 'newest', o_orderpriority, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'kept', v, r FROM (VALUES ('20240103T000000', 1), ('20240102T000000', 2)) t(v, r)""")
def versions(spark, sf):
    """Three different versions of a table, pruned to two; the older and the newer one
    restored, and the list of what is left."""
    root = f"{ST.scratch_root(spark)}/versions-{uuid.uuid4().hex}"
    orders = order_ticks(spark, sf)
    count = lambda df: df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    ST.snapshot(count(orders.where("tick_id % 3 = 0")), root, "20240101T000000")
    ST.snapshot(count(orders.where("tick_id % 3 <> 1")), root, "20240102T000000")
    ST.snapshot(count(orders), root, "20240103T000000")
    ST.prune(spark, root, keep=2)
    kept = ST.list_versions(spark, root).select(F.lit("kept").alias("part"), F.col("version").alias("ticker"), F.col("rank").cast("long").alias("n"))
    part = lambda name, v: ST.restore(spark, root, v).select(F.lit(name).alias("part"), "ticker", "n")
    return part("restored", "20240102T000000").unionByName(part("newest", "20240103T000000")).unionByName(kept)

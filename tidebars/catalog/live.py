"""Registered queries that run a stream over the tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebars.catalog.base import ORDER_TICKS, SERIES, TICKS, S, W, bars_sql, hourly, indexed, order_ticks, register, stored, ticks, with_
from tidebars.catalog.storage import BAR_COLS, _bar_cols
from tidebars.sources.bars import ohlcv, read_partitioned
from tidebars.sources.storage import scratch_root
from tidebars.streaming import live as L

K3 = ("ticker", "timeframe")


def _folder(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


# Bars (and ticks) of these hours arrive ten days late.
def late(ts):
    return F.dayofmonth(ts).isin(4, 11) & (F.hour(ts) < 6)


LATE = "(day(ts) IN (4, 11) AND hour(ts) < 6)"


def stream_of(spark, df, files=6, days=10):
    """A table as a stream of several batches in time order, late rows ten days after."""
    arrival = F.when(late("ts"), F.col("ts") + F.make_dt_interval(days=F.lit(days))).otherwise(F.col("ts"))
    return L.replay(df.withColumn("arrival", arrival), _folder(spark, "source"), "arrival", files)


def event_stream(spark, sf):
    return stream_of(spark, ticks(spark, sf))


def run_out(q):
    q.awaitTermination()
    if L.batch_count(q) < 4:
        raise RuntimeError(f"{L.batch_count(q)} batches only: state was not carried over")


def run_to_table(spark, stream, mode="append"):
    """Run a stream over all there is, into files, and read them."""
    out, check = _folder(spark, "out"), _folder(spark, "check")
    run_out(L.start(stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", check)))
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(spark, stream, sink, mode="append"):
    run_out(L.start(stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", _folder(spark, "check"))))


# What is left of the ticks and hourly bars once the late ones are gone.
ON_TIME = f"""ticks AS (SELECT event_id AS tick_id, event_type AS ticker, ts, value AS price, value AS volume FROM events WHERE NOT {LATE})"""
IN_ORDER = f"""o AS (SELECT * REPLACE (row_number() OVER (PARTITION BY ticker, timeframe ORDER BY ts) - 1 AS idx) FROM s WHERE NOT {LATE})"""


@register("stream_bars", with_(ON_TIME, bars_sql("60m")) + f"""SELECT {BAR_COLS} FROM bars
WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)""")
def stream_bars(spark, sf):
    """Bars whose end the watermark has passed; ticks of bars that have long gone out come too late."""
    return _bar_cols(run_to_table(spark, L.stream_bars(event_stream(spark, sf), "60m", tie="tick_id")))


@register("stream_bars_daily_sink", with_(ON_TIME, bars_sql("1d")) + f"""SELECT {BAR_COLS} FROM bars""")
def stream_bars_daily_sink(spark, sf):
    """Every state of the open bars goes to the sink, the last one stays."""
    path = _folder(spark, "table")
    run_batches(spark, L.stream_bars(event_stream(spark, sf), "1d", tie="tick_id"), L.bars_sink(path), "update")
    return _bar_cols(read_partitioned(spark, f"{path}/bars"))


@register("bars_sink", with_(ORDER_TICKS, bars_sql("1d")) + """SELECT ticker, timeframe, ts, CASE WHEN ts = max(ts) OVER (PARTITION BY ticker) THEN close + 1 ELSE close END AS close FROM bars""")
def bars_sink(spark, sf):
    """The same bars twice, raised by one the second time: only the newest bar
    of a series takes the new value."""
    path = _folder(spark, "table")
    bars = stored(ohlcv(order_ticks(spark, sf), "1d", tie="tick_id"))
    L.upsert_partitions(bars, path)
    L.upsert_partitions(bars.withColumn("close", F.col("close") + 1), path)
    return read_partitioned(spark, f"{path}/bars").select("ticker", "timeframe", "ts", "close")


@register("late_bars_sink", with_(TICKS, bars_sql("60m")) + f"""SELECT {BAR_COLS} FROM bars""")
def late_bars_sink(spark, sf):
    """Late bars fill the holes they left; copies of closed bars that come along change nothing."""
    path = _folder(spark, "table")
    bars = stored(hourly(spark, sf))
    again = bars.where((F.dayofmonth("ts") == 5) & (F.hour("ts") < 6)).withColumn("close", F.col("close") + 1)
    rows = bars.withColumn("arrival", F.when(late("ts"), F.col("ts") + F.make_dt_interval(days=F.lit(10))).otherwise(F.col("ts"))).unionByName(
        again.withColumn("arrival", F.col("ts") + F.make_dt_interval(days=F.lit(10))))
    run_batches(spark, L.replay(rows, _folder(spark, "source"), "arrival", 5).drop("arrival"), L.bars_sink(path))
    return _bar_cols(read_partitioned(spark, f"{path}/bars"))


@register("rollup_sink", with_(ORDER_TICKS, bars_sql("1d", "1wk", "1mo", "3mo")) + """SELECT ticker, timeframe, ts, open, high, low, close, round(volume, 4) AS volume FROM bars""")
def rollup_sink(spark, sf):
    """Weeks, months and quarters grow with the daily bars, of which some come late."""
    path = _folder(spark, "table")
    daily = ohlcv(order_ticks(spark, sf), "1d", tie="tick_id")
    run_batches(spark, stream_of(spark, daily, files=4, days=200).drop("arrival"), L.rollup_sink(path))
    return _bar_cols(read_partitioned(spark, f"{path}/bars"))


@register("stream_gradient", with_(*SERIES, IN_ORDER) + """SELECT ticker, timeframe, ts, round(c1 - c2, 6) AS v,
round(CASE WHEN c3 IS NULL THEN 0 ELSE (c1 - c2) - (c1 - c3) / 2 END, 6) AS a FROM (SELECT *, lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2, lag(close, 3) OVER w AS c3 FROM o
WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY ts)) WHERE idx >= 2""")
def stream_gradient(spark, sf):
    g = run_to_table(spark, L.stream_gradient(stream_of(spark, hourly(spark, sf))))
    return g.withColumns({c: F.round(c, 6) for c in ("v", "a")})


LIVE_STATE = """y AS (SELECT ticker, timeframe, idx, ts, close AS ema, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS var, 0 AS sig, 1 AS dur,
 close AS pos, 0.0::DOUBLE AS vel, 0.2025::DOUBLE / 1.2025 AS p00, 0.105::DOUBLE / 1.2025 AS p01, 0.11::DOUBLE - 0.105::DOUBLE * 0.105 / 1.2025 AS p11 FROM o WHERE idx = 0 UNION ALL
 SELECT ticker, timeframe, idx, ts, ema, v, a, mu, var, new, CASE WHEN new <> sig THEN 1 ELSE dur + 1 END, ahead + q00 / (q00 + 1) * (close - ahead), vel + q01 / (q00 + 1) * (close - ahead),
  q00 - q00 * q00 / (q00 + 1), q01 - q00 * q01 / (q00 + 1), q11 - q01 * q01 / (q00 + 1) FROM (
 SELECT *, CASE WHEN sig = 0 AND a > eps AND v > 0 THEN 1 WHEN sig = 0 AND a < -eps AND v < 0 THEN -1
   WHEN sig = 1 AND a < -eps THEN 0 WHEN sig = -1 AND a > eps THEN 0 ELSE sig END AS new FROM (
  SELECT *, 0.15 * greatest(sqrt(var), 0.05) AS eps FROM (
   SELECT *, (1 - 2.0::DOUBLE/61) * pvar + (2.0::DOUBLE/61) * pow(v - mu, 2) AS var FROM (
    SELECT *, v - pv AS a, (1 - 2.0::DOUBLE/61) * pmu + (2.0::DOUBLE/61) * v AS mu FROM (
     SELECT *, ema - pema AS v FROM (
      SELECT o.ticker, o.timeframe, o.idx, o.ts, o.close, y.ema AS pema, y.v AS pv, y.mu AS pmu, y.var AS pvar, y.sig, y.dur,
       (1 - 2.0::DOUBLE/11) * y.ema + (1 - (1 - 2.0::DOUBLE/11)) * o.close AS ema,
       y.pos + y.vel AS ahead, y.vel, y.p00 + 2 * y.p01 + y.p11 + 0.0025 AS q00, y.p01 + y.p11 + 0.005 AS q01, y.p11 + 0.01 AS q11
      FROM y JOIN o ON o.ticker = y.ticker AND o.timeframe = y.timeframe AND o.idx = y.idx + 1)))))))"""


@register("stream_signal", with_(*SERIES, IN_ORDER, LIVE_STATE) + """SELECT ticker, timeframe, ts, round(ema, 6) AS filtered, round(pos, 6) AS kalman, round(v, 6) AS v, round(a, 6) AS a,
round(mu, 6) AS mu, round(sqrt(var), 6) AS sigma, sig, dur FROM y""")
def stream_signal(spark, sf):
    g = run_to_table(spark, L.stream_signal(stream_of(spark, hourly(spark, sf))))
    return g.select(*K3, "ts", *[F.round(c, 6).alias(c) for c in ("filtered", "kalman", "v", "a", "mu", "sigma")], "sig", "dur")


@register("freeze_sink", with_(*SERIES) + "SELECT ticker, timeframe, idx, close AS prediction FROM s")
def freeze_sink(spark, sf):
    """Predictions of every bar come in batches and once more, raised, with later ones; the first ones stay."""
    path = _folder(spark, "frozen")
    p = indexed(spark, sf).select(*K3, "idx", "ts", F.col("close").alias("prediction"))
    again = p.withColumns({"prediction": F.col("prediction") + 1, "ts": F.col("ts") + F.make_dt_interval(days=F.lit(10))})
    offers = L.replay(p.unionByName(again), _folder(spark, "source"), "ts", 5)
    run_batches(spark, offers.withColumn("arrival", F.col("ts")), L.freeze_sink(path, part=F.floor(F.col("idx") / 128).cast("long")))
    return spark.read.parquet(path).select(*K3, "idx", "prediction")


@register("stream_staleness", with_(TICKS, bars_sql("60m")) + """SELECT ticker, timeframe, max(ts) AS last_ts, epoch(TIMESTAMP '2024-02-01' - max(ts))::BIGINT AS age_seconds FROM bars
GROUP BY ALL HAVING epoch(TIMESTAMP '2024-02-01' - max(ts)) > 3600""")
def stream_staleness(spark, sf):
    path = _folder(spark, "newest")
    newest = L.stream_staleness(stream_of(spark, hourly(spark, sf)))
    run_batches(spark, newest, lambda batch, i: batch.write.mode("append").parquet(path), "update")
    return L.stale_series(spark.read.parquet(path), "2024-02-01 00:00:00", 3600)

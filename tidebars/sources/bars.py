"""Bars: built from ticks, read from storage, cut to windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.scalars import clock_micros, start_of
from tidebars.operators.series import index_bounded
from tidebars.schema import BARS, KEYS, tf_dim, validate_schema

# How a timestamp is cut down to the start of its bar.
_CALENDAR = {"1m": "minute", "60m": "hour", "1d": "day", "1wk": "week", "1mo": "month", "3mo": "quarter"}
_MINUTES = {"5m": 5, "15m": 15}


def bar_start(ts: Column, timeframe: str) -> Column:
    """Start of the bar that holds ``ts``; weeks start on Monday."""
    if timeframe in _CALENDAR:
        return start_of(_CALENDAR[timeframe], ts)
    if timeframe in _MINUTES:
        hour = start_of("hour", ts)
        step = _MINUTES[timeframe]
        return hour + F.make_dt_interval(mins=(F.floor(F.minute(ts.cast("timestamp_ntz")) / step) * step).cast("int"))
    raise ValueError(f"unknown timeframe {timeframe!r}")


def _tick_order(ticks: DataFrame, ts: str, tie: str | None) -> Column:
    """Order of ticks as one number. Number-typed keys keep open and close in a
    hash aggregate; a struct would force a sort of all ticks."""
    if tie is None:
        return F.col(ts)
    if dict(ticks.dtypes)[tie] not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(ts, tie)
    number = lambda c: c.cast("decimal(20,0)")
    micros = number(clock_micros(F.col(ts))) * F.lit(10**17).cast("decimal(18,0)") * F.lit(1000).cast("decimal(4,0)")
    return (micros.cast("decimal(38,0)") + number(F.col(tie).cast("bigint")) + number(F.lit(2**63 - 1))).cast("decimal(38,0)")


def ohlcv(ticks: DataFrame, timeframe: str, ticker: str = "ticker", ts: str = "ts",
          price: str = "price", volume: str = "volume", tie: str | None = None) -> DataFrame:
    """Bars of one timeframe. A single hash aggregate with map-side partial
    results, so a ticker that holds a third of all ticks does not load one
    task. ``tie`` orders ticks of equal time."""
    when = _tick_order(ticks, ts, tie)
    return (
        ticks.groupBy(F.col(ticker).cast("string").alias("ticker"), bar_start(F.col(ts), timeframe).alias("_start"))
        .agg(
            F.min_by(price, when).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, when).alias("close"),
            F.sum(volume).cast("double").alias("volume"),
        )
        .select("ticker", F.lit(timeframe).alias("timeframe"), F.col("_start").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


def ohlcv_all(ticks: DataFrame, timeframes: Sequence[str], base: str = "1m", **columns) -> DataFrame:
    """Bars of several timeframes from one scan of the ticks: base bars first,
    the coarser ones from those. Correct for every timeframe that base bars
    tile, which holds for all eight when ``base`` is 1m (or 1d for 1d and up)."""
    return coarser(ohlcv(ticks, base, **columns), timeframes)


def coarser(fine: DataFrame, timeframes: Sequence[str]) -> DataFrame:
    """Bars of coarser timeframes that the ``fine`` bars tile."""
    starts = F.array(*[
        F.struct(F.lit(tf).alias("timeframe"), bar_start(F.col("ts"), tf).alias("start")) for tf in timeframes
    ])
    return (
        fine.select("ticker", "ts", "open", "high", "low", "close", "volume", F.explode(starts).alias("_to"))
        .groupBy("ticker", F.col("_to.timeframe").alias("timeframe"), F.col("_to.start").alias("_start"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_start", "ts")
        .select(*BARS.fieldNames())
    )


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """All stored bars; filters on ticker, timeframe and ts reach the scan."""
    return validate_schema(read_partitioned(spark, path), BARS)


def valid_close(df: DataFrame) -> DataFrame:
    return df.where(F.col("close").isNotNull() & ~F.isnan("close"))


def for_series(df: DataFrame, ticker: str, timeframe: str) -> DataFrame:
    return df.where((F.col("ticker") == ticker) & (F.col("timeframe") == timeframe))


def _newest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(ts).alias("_newest"))


def before_offset(df: DataFrame, days: int, exclusive: bool = False,
                  keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Rows up to ``days`` days before the newest row of their series. The
    newest stamp comes from an aggregate, so no series is sorted for it."""
    limit = F.col("_newest") - F.make_dt_interval(days=F.lit(days))
    keep = F.col(ts) < limit if exclusive else F.col(ts) <= limit
    return df.join(_newest(df, keys, ts), list(keys)).where(keep).select(*df.columns)


def latest_n(df: DataFrame, n: int, day_offset: int = 0, keys: Sequence[str] = KEYS,
             ts: str = "ts") -> DataFrame:
    """The newest ``n`` rows per series. Spark limits every task to ``n`` rows
    per series before the shuffle."""
    if day_offset > 0:
        df = before_offset(df, day_offset, keys=keys, ts=ts)
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def within_lookback(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Keep the look-back of each timeframe, counted from its newest bar."""
    newest = _newest(df, keys, ts).join(
        F.broadcast(tf_dim(df.sparkSession).select("timeframe", "lookback_days")), "timeframe")
    limit = F.col("_newest") - F.make_dt_interval(days=F.col("lookback_days"))
    return (
        df.join(newest, list(keys))
        .where(F.col("lookback_days").isNull() | (F.col(ts) >= limit))
        .select(*df.columns)
    )


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Read a table partitioned by timeframe. Folder names are text: left to
    type inference a timeframe like 1d would become a number."""
    found = spark.read.parquet(path).schema
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("timeframe", "month") else f for f in found.fields])
    return spark.read.schema(text).parquet(path)


def read_window(spark: SparkSession, path: str, min_rows: int = 5) -> DataFrame:
    """A prepared window with ``idx``; missing open, high and low come from the
    close and series of fewer than ``min_rows`` rows are left out."""
    df = read_partitioned(spark, path)
    for c in ("open", "high", "low"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.col("close")) if c in df.columns else F.col("close"))
    return index_bounded(df).where(F.col("n") >= min_rows)


def write_window(df: DataFrame, path: str, min_rows: int = 5) -> None:
    """Store the window of every series that has at least ``min_rows`` rows.
    ``df`` is a prepared window (``latest_n``), so a series is short."""
    sized = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))
    sized.where(F.col("_n") >= min_rows).drop("_n").write.mode("overwrite").partitionBy("timeframe").parquet(path)


def calendar_flag(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """``flag``: the bar opens a new day (intraday), is a Monday (daily), opens
    a new month (weekly) or lies in January (monthly, quarterly). Needs ``idx``
    and ``n``."""
    from tidebars.operators.series import chunked, core_rows, in_chunk

    cut = chunked(df, before=1)
    back = F.lag(ts).over(in_chunk(keys))
    flag = (
        F.when(F.col("timeframe").isin("1m", "5m", "15m", "60m"), F.to_date(ts) != F.to_date(back))
        .when(F.col("timeframe") == "1d", F.weekday(ts) == 0)
        .when(F.col("timeframe") == "1wk", F.month(ts) != F.month(back))
        .otherwise(F.month(ts) == 1)
    )
    return core_rows(cut.withColumn("flag", F.coalesce(flag, F.lit(False))))

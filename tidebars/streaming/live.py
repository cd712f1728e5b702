"""Structured Streaming: bars from ticks, sinks with upsert rules, stateful
signals per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebars.functions.scalars import clock_micros, start_of
from tidebars.operators.quality import force_merge, merge_bars
from tidebars.schema import KEYS
from tidebars.sources.bars import bar_start, coarser, read_partitioned
from tidebars.sources.storage import materialize

# Fixed values: (length, offset from the epoch) of the bar windows. The epoch
# is a Thursday, so Monday weeks are shifted by four days.
_WINDOWS = {
    "1m": ("1 minute", None), "5m": ("5 minutes", None), "15m": ("15 minutes", None),
    "60m": ("1 hour", None), "1d": ("1 day", None), "1wk": ("7 days", "4 days"),
}


def start(writer, every: str | None = None):
    """Start a prepared writer: once over what is there, or every so often."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def replay(table: DataFrame, path: str, order: str = "ts", files: int = 8) -> DataFrame:
    """A table as a stream: written to ``path`` in ``files`` ranges of ``order``, which are
    read one a batch in that order. A row whose ``order`` is later than its event time
    arrives late. The ranges are written side by side; only their files' times, which a file
    stream goes by, are set one after the other."""
    spark = table.sparkSession
    table.repartitionByRange(files, order).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    newest = max(fs.getFileStatus(p).getModificationTime() for p in parts)
    for k, part in enumerate(parts):
        fs.setTimes(part, newest + 1000 * (k - len(parts)), -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def batch_count(query) -> int:
    """Batches of an ended stream that held rows."""
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def stream_bars(ticks: DataFrame, timeframe: str, lateness: str = "10 minutes", ticker: str = "ticker",
                ts: str = "ts", price: str = "price", volume: str = "volume", tie: str | None = None) -> DataFrame:
    """Bars of a fixed length from a tick stream; a bar is emitted once the
    watermark has passed its end. Run it with session time zone UTC."""
    if timeframe not in _WINDOWS:
        raise ValueError("calendar bars come from calendar_rollup over stored daily bars")
    length, shift = _WINDOWS[timeframe]
    timed = ticks.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    win = F.window("_ts", length, length, shift) if shift else F.window("_ts", length)
    when = F.struct("_ts", tie) if tie else F.col("_ts")
    return (
        timed.groupBy(win.alias("_w"), F.col(ticker).cast("string").alias("ticker"))
        .agg(F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
             F.max_by(price, when).alias("close"), F.sum(volume).cast("double").alias("volume"))
        .select("ticker", F.lit(timeframe).alias("timeframe"), F.col("_w.start").cast("timestamp_ntz").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


def calendar_rollup(daily: DataFrame, timeframes: Sequence[str] = ("1wk", "1mo", "3mo")) -> DataFrame:
    """Week, month and quarter bars from daily bars, for use in a batch sink."""
    return coarser(daily, timeframes)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upsert_partitions(batch: DataFrame, path: str, arrival: str | None = None, replace: bool = False) -> None:
    """Merge a batch into the bar table at ``path`` (partitioned by timeframe
    and month). Only the months the batch touches are read and rewritten. The
    newest stamp per series is kept in a small table next to it, so the rule
    for open and closed bars does not scan the bars. Running a batch twice
    gives the same table. ``replace``: the batch's bars take the place of stored
    ones of any age."""
    spark = batch.sparkSession
    batch = batch.withColumn("month", F.date_format("ts", "yyyy-MM"))
    bars, heads = f"{path}/bars", f"{path}/heads"
    cols = [*KEYS, "ts", "open", "high", "low", "close", "volume"]
    touched = [tuple(r) for r in batch.select("timeframe", "month").distinct().collect()]
    if not touched:
        return
    if _exists(spark, bars):
        hit = F.lit(False)
        for tf, month in touched:
            hit = hit | ((F.col("timeframe") == tf) & (F.col("month") == month))
        base = read_partitioned(spark, bars).where(hit).select(*cols)
        newest = _heads(spark, heads)
    else:
        base, newest = batch.where("false").select(*cols), None
    merged = force_merge(base, batch, arrival) if replace else merge_bars(base, batch, arrival, newest)
    (
        merged.withColumn("month", F.date_format("ts", "yyyy-MM"))
        .repartition("timeframe", "month", "ticker")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("timeframe", "month").parquet(bars)
    )
    new_heads = batch.groupBy(*KEYS).agg(F.max("ts").alias("_newest"))
    if newest is not None:
        new_heads = newest.unionByName(new_heads).groupBy(*KEYS).agg(F.max("_newest").alias("_newest"))
    done = _head_versions(spark, heads)
    version = int(done[-1][2:]) + 1 if done else 0
    new_heads.write.mode("overwrite").parquet(f"{heads}/v={version:012d}")
    _drop_old_heads(spark, heads)


def _head_versions(spark: SparkSession, heads: str) -> list[str]:
    if not _exists(spark, heads):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(heads)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(p.getName() for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _drop_old_heads(spark: SparkSession, heads: str, keep: int = 3) -> None:
    for name in _head_versions(spark, heads)[:-keep]:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{heads}/{name}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _heads(spark: SparkSession, heads: str) -> DataFrame | None:
    found = _head_versions(spark, heads)
    return spark.read.parquet(f"{heads}/{found[-1]}") if found else None


def bars_sink(path: str, arrival: str | None = None):
    """For ``foreachBatch``: the open bar may change, closed bars stay, late
    rows only fill holes."""
    return lambda batch, batch_id: upsert_partitions(batch, path, arrival)


def rollup_sink(path: str):
    """For ``foreachBatch`` over daily bars: rewrite the week, month and
    quarter bars of the touched periods from the stored daily bars."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_partitions(batch, path)
        spark = batch.sparkSession
        daily = read_partitioned(spark, f"{path}/bars").where("timeframe = '1d'")
        quarter = lambda c: start_of("quarter", c)
        spans = batch.select("ticker", quarter(F.col("ts")).alias("_q")).distinct()
        # weeks cross quarter ends, so the quarters around are read as well
        near = spans.select("ticker", F.explode(F.array(
            F.col("_q") - F.make_ym_interval(months=F.lit(3)), F.col("_q"),
            F.col("_q") + F.make_ym_interval(months=F.lit(3)))).alias("_q")).distinct()
        rolled = calendar_rollup(daily.withColumn("_q", quarter(F.col("ts"))).join(near, ["ticker", "_q"], "left_semi"))
        # periods at the edge of what was read lack days: only those that hold a new day are written
        starts = F.array(*[F.struct(F.lit(tf).alias("timeframe"), bar_start(F.col("ts"), tf).alias("ts")) for tf in ("1wk", "1mo", "3mo")])
        held = batch.select("ticker", F.explode(starts).alias("_p")).select("ticker", "_p.*").distinct()
        upsert_partitions(rolled.join(held, [*KEYS, "ts"], "left_semi"), path, replace=True)

    return write


def freeze_partitions(batch: DataFrame, path: str, keys: Sequence[str] = (*KEYS, "idx"), part: Column | None = None) -> None:
    """Insert predictions whose bar has none yet; the first write wins. The store is cut
    into parts (``part``: an expression over the keys, by default 4,096 bars a part), and of
    those that the batch touches only the keys are read."""
    keys = list(keys)
    spark = batch.sparkSession
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), "arrival").alias("_r"))
    new = first.select(*keys, "_r.*").withColumn("part", F.floor(F.col("idx") / 4096).cast("long") if part is None else part)
    if _exists(spark, path):
        new = materialize(new, "offered")
        touched = [r[0] for r in new.select("part").distinct().collect()]
        new = new.join(frozen_parts(spark, path, touched).select(*keys), keys, "left_anti")
    new.write.mode("append").partitionBy("part").parquet(path)


def frozen_parts(spark: SparkSession, path: str, parts: Sequence) -> DataFrame:
    """The stored predictions of some parts; the other folders are not read."""
    return spark.read.parquet(path).where(F.col("part").isin(list(parts)))


def freeze_sink(path: str, keys: Sequence[str] = (*KEYS, "idx"), part: Column | None = None):
    return lambda batch, batch_id: freeze_partitions(batch, path, keys, part)


def stale_series(bars: DataFrame, as_of: str, limit_seconds: int) -> DataFrame:
    """Series whose newest bar is older than ``limit_seconds`` at ``as_of``."""
    newest = bars.groupBy(*KEYS).agg(F.max("ts").alias("last_ts"))
    age = F.floor((clock_micros(F.lit(as_of)) - clock_micros(F.col("last_ts"))) / 1_000_000).cast("long")
    return newest.withColumn("age_seconds", age).where(F.col("age_seconds") > limit_seconds)


def stream_staleness(bars: DataFrame) -> DataFrame:
    """Newest stamp per series as a streaming aggregate (update mode); feed
    each batch to ``stale_series`` in ``foreachBatch``."""
    return bars.groupBy(*KEYS).agg(F.max("ts").alias("ts"))


def stale_alerts(bars: DataFrame, limit: str = "5 minutes") -> DataFrame:
    """A row (``ticker, timeframe, last_ts``) for every series from which nothing has come
    for ``limit`` on the clock, while the stream runs; after its next bar a series can fall
    silent anew. State: the newest stamp and a timer."""
    wait = int(pd.Timedelta(limit).total_seconds() * 1000)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0])
            state.remove()
            yield pd.DataFrame([(*key, last)], columns=["ticker", "timeframe", "last_ts"])
            return
        newest = max(pdf["ts"].max().value for pdf in frames)
        state.update((max(newest, state.get[0]) if state.exists else newest,))
        state.setTimeoutDuration(wait)

    return bars.groupBy(*KEYS).applyInPandasWithState(
        step, "ticker string, timeframe string, last_ts timestamp_ntz", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


GRADIENT_SCHEMA = "ticker string, timeframe string, ts timestamp_ntz, v double, a double"
SIGNAL_SCHEMA = ("ticker string, timeframe string, ts timestamp_ntz, filtered double, kalman double, v double, "
                 "a double, mu double, sigma double, sig int, dur int")


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Rows of one series in one micro-batch, by time, then by a column ``arrival`` if there is one."""
    rows = pd.concat(list(frames))
    return rows.sort_values(["ts", "arrival"] if "arrival" in rows.columns else ["ts"], kind="stable")


def stream_gradient(bars: DataFrame, x: str = "close") -> DataFrame:
    """Velocity and acceleration of the last closed bar, once three bars are
    known. The newest bar counts as open and is left out; a bar with the newest stamp takes
    its place, an older one comes too late and is left out. State: four values and a stamp."""

    def step(key, frames, state: GroupState):
        past, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = []
        pdf = _in_order(frames)
        for ts, value in zip(pdf["ts"], pdf[x]):
            if last is not None and ts.value <= last:
                past[-1] = float(value) if ts.value == last else past[-1]
                continue
            past, last = [*past, float(value)][-4:], ts.value
            if len(past) < 3:
                continue
            closed = past[:-1]
            v = closed[-1] - closed[-2]
            # one closed bar before: one-sided slope, two before: central slope
            before = v if len(closed) == 2 else (closed[-1] - closed[-3]) / 2.0
            rows.append((*key, ts, v, v - before))
        state.update((past, last))
        yield pd.DataFrame(rows, columns=["ticker", "timeframe", "ts", "v", "a"])

    return bars.groupBy(*KEYS).applyInPandasWithState(
        step, GRADIENT_SCHEMA, "past array<double>, last long", "append", GroupStateTimeout.NoTimeout)


class SignalState:
    """One causal step of smoothing, slope and trigger. The numbers it keeps
    are all there is to know about the past of a series."""

    FIELDS = ("count", "ema", "v", "mu", "var", "sig", "dur", "pos", "vel", "p00", "p01", "p11")
    SCHEMA = ("count long, ema double, v double, mu double, var double, sig int, dur int, "
              "pos double, vel double, p00 double, p01 double, p11 double")

    def __init__(self, values: tuple | None = None):
        for name, value in zip(self.FIELDS, values or (0, 0.0, 0.0, 0.0, 0.0, 0, 0, 0.0, 0.0, 0.1, 0.0, 0.1)):
            setattr(self, name, value)

    def values(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)

    def push(self, x: float, keep: float, alpha: float, k_eps: float, sigma_min: float, q: float, r: float) -> tuple:
        first = self.count == 0
        before, v_before = self.ema, self.v
        self.ema = x if first else keep * before + (1 - keep) * x
        self.v = 0.0 if first else self.ema - before
        a = 0.0 if first else self.v - v_before
        self.mu = self.v if first else (1 - alpha) * self.mu + alpha * self.v
        self.var = 0.0 if first else (1 - alpha) * self.var + alpha * (self.v - self.mu) ** 2
        band = k_eps * max(self.var ** 0.5, sigma_min)
        push = 1 if a > band else -1 if a < -band else 0
        new = self.sig
        if push and self.sig == -push:
            new = 0
        elif push and self.sig == 0 and self.v * push > 0:
            new = push
        self.dur = 1 if new != self.sig else self.dur + 1
        self.sig = new
        self._kalman(x, first, q, r)
        self.count += 1
        return self.ema, self.pos, self.v, a, self.mu, self.var ** 0.5, self.sig, self.dur

    def _kalman(self, x: float, first: bool, q: float, r: float) -> None:
        if first:
            self.pos = x
        self.pos += self.vel
        p00 = self.p00 + 2 * self.p01 + self.p11 + q / 4
        p01 = self.p01 + self.p11 + q / 2
        p11 = self.p11 + q
        s = p00 + r
        g0, g1 = p00 / s, p01 / s
        miss = x - self.pos
        self.pos += g0 * miss
        self.vel += g1 * miss
        self.p00, self.p01, self.p11 = p00 - g0 * p00, p01 - g0 * p01, p11 - g1 * p01


def stream_signal(bars: DataFrame, ema_span: int = 10, span: int = 60, k_eps: float = 0.15, sigma_min: float = 0.05,
                  q: float = 0.01, r: float = 1.0, x: str = "close") -> DataFrame:
    """Causal smoothing (EMA and Kalman), backward slopes and trigger, one row
    per arriving bar. A bar that is not newer than what the series has had comes too late
    and is left out."""
    keep, alpha = 1.0 - 2.0 / (ema_span + 1.0), 2.0 / (span + 1.0)

    def step(key, frames, state: GroupState):
        *past, last = tuple(state.get) if state.exists else (None,)
        s = SignalState(tuple(past) if state.exists else None)
        rows = []
        pdf = _in_order(frames)
        for ts, value in zip(pdf["ts"], pdf[x]):
            if not np.isnan(value) and (last is None or ts.value > last):
                last = ts.value
                rows.append((*key, ts, *s.push(float(value), keep, alpha, k_eps, sigma_min, q, r)))
        state.update((*s.values(), last))
        yield pd.DataFrame(rows, columns=["ticker", "timeframe", "ts", "filtered", "kalman", "v", "a", "mu", "sigma", "sig", "dur"])

    return bars.groupBy(*KEYS).applyInPandasWithState(
        step, SIGNAL_SCHEMA, f"{SignalState.SCHEMA}, last long", "append", GroupStateTimeout.NoTimeout)

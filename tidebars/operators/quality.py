"""Completeness checks, statistics, merges and comparison of bar sources."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions.scalars import clock_micros, fixed4, known, start_of
from tidebars.schema import KEYS, tf_dim

PK = [*KEYS, "ts"]


def date_range(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def has_data(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """The wanted tickers with a flag whether any bar exists."""
    present = df.select("ticker").distinct().withColumn("has_data", F.lit(True))
    return tickers.join(present, "ticker", "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))


def tickers(df: DataFrame) -> DataFrame:
    return df.select("ticker").distinct()


def timeframes(df: DataFrame) -> DataFrame:
    return df.select("ticker", "timeframe").distinct()


def completeness(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.to_date("ts")).alias("first_day"),
        F.max(F.to_date("ts")).alias("last_day"),
        F.count_if(known("close").isNull()).alias("null_close"),
    )


def _days_between(a: Column, b: Column) -> Column:
    return (clock_micros(a) - clock_micros(b)) / F.lit(86_400_000_000.0)


def _by_month(df: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """Counts, ends and gaps per series and month from one pass. Stamps are
    compared inside months; the step over a month end joins two summary rows,
    so a long series is never sorted in one task."""
    dim = F.broadcast(tf_dim(df.sparkSession).select("timeframe", "expected_days"))
    inside = Window.partitionBy(*keys, "_month").orderBy("ts")
    across = Window.partitionBy(*keys).orderBy("_month")
    limit = F.col("expected_days") * factor
    wide = lambda a, b: F.coalesce(_days_between(a, b) > limit, F.lit(False)).cast("long")
    rows = (
        df.select(*keys, "ts", "close").join(dim, "timeframe", "left")
        .withColumn("_month", start_of("month", F.col("ts")))
    )
    per_month = rows.withColumn("_prev", F.lag("ts").over(inside)).groupBy(*keys, "_month", "expected_days").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(known("close").isNull()).alias("null_close"),
        F.sum(wide(F.col("ts"), F.col("_prev"))).alias("_in"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    return per_month.withColumn("gaps", F.col("_in") + wide(F.col("_first"), F.lag("_last").over(across)))


def gap_count(df: DataFrame, factor: float = 3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaps wider than ``factor`` expected steps; timeframes without an
    expected step (weeks and longer) are left out."""
    months = _by_month(df, factor, list(keys)).where("expected_days is not null")
    return months.groupBy(*keys).agg(F.sum("gaps").alias("gaps"))


def staleness(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Daily series whose last day is more than ``days`` before ``as_of``."""
    last = df.where(F.col("timeframe") == "1d").groupBy(*KEYS).agg(F.max(F.to_date("ts")).alias("last_day"))
    age = F.datediff(F.lit(as_of).cast("date"), "last_day")
    return last.withColumn("age_days", age).withColumn("stale", age > days)


def data_health(df: DataFrame, as_of: str, stale_days: int = 7, factor: float = 3.0) -> DataFrame:
    """One row per series with counts and status, from one pass. A stale daily series is
    reported as stale whatever else was found and counts one more warning."""
    base = _by_month(df, factor, KEYS).groupBy(*KEYS).agg(
        F.sum("rows").alias("rows"), F.to_date(F.min("_first")).alias("first_day"), F.to_date(F.max("_last")).alias("last_day"),
        F.sum("null_close").alias("null_close"), F.sum("gaps").alias("gaps"))
    age = F.datediff(F.lit(as_of).cast("date"), "last_day")
    stale = (F.col("timeframe") == "1d") & (age > stale_days)
    found = F.when(F.col("null_close") > 0, "null_values").when(F.col("gaps") > 0, "gaps").otherwise("ok")
    return (
        base.withColumn("status", F.when(stale, "stale").otherwise(found))
        .withColumn("warnings", F.when(found == "ok", 0).otherwise(1) + F.when(stale, 1).otherwise(0))
    )


def health_summary(health: DataFrame) -> DataFrame:
    """One row for everything; no rows at all is an error."""
    total = health.agg(
        F.countDistinct("ticker").alias("tickers"),
        F.count(F.lit(1)).alias("series"),
        F.coalesce(F.sum("warnings"), F.lit(0)).cast("long").alias("warnings"),
    )
    status = F.when(F.col("series") == 0, "error").when(F.col("warnings") > 0, "warn").otherwise("ok")
    return total.withColumn("status", status)


def series_stats(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.stddev_pop("close").alias("sigma"),
        F.max_by("close", "ts").alias("last_close"),
        F.count(F.lit(1)).alias("points"),
    )


def top_sets(summary: DataFrame, n: int, group: str = "category", score: str = "score", name: str = "name") -> DataFrame:
    """Best ``n`` rows per group; ties go to the smaller name."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(name))
    return summary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def common_ts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PK).intersect(b.select(*PK))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many stamps exist on one side only, per series."""
    def one_sided(x, y, name):
        return x.select(*PK).join(y.select(*PK), PK, "left_anti").groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))

    return one_sided(a, b, "only_a").join(one_sided(b, a, "only_b"), KEYS, "full_outer").na.fill(0, ["only_a", "only_b"])


def _line(value: str) -> Column:
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(":"), fixed4(F.col(value)))


def fingerprint(df: DataFrame, value: str = "close", keys: Sequence[str] = KEYS, out: str = "fingerprint") -> DataFrame:
    """MD5 over all ``stamp:value`` of a series in time order. The digest needs
    the order of the whole series, so a series streams through one task, but
    only one batch of it is in memory at a time. ``fingerprint_by`` spreads it."""
    keys = list(keys)
    lines = df.select(*keys, "ts", _line(value).alias("_line")).repartition(*keys).sortWithinPartitions(*keys, "ts")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(out, T.StringType())])

    def digest(batches):
        held, md5 = None, None
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                if key != held:
                    if md5 is not None:
                        yield pd.DataFrame([(*held, md5.hexdigest())], columns=[*keys, out])
                    held, md5 = key, hashlib.md5()
                md5.update("".join(part["_line"]).encode())
        if md5 is not None:
            yield pd.DataFrame([(*held, md5.hexdigest())], columns=[*keys, out])

    return lines.drop("ts").mapInPandas(digest, schema)


def fingerprint_by(df: DataFrame, bucket: str = "month", value: str = "close", keys: Sequence[str] = KEYS,
                   out: str = "fingerprint") -> DataFrame:
    """MD5 of the MD5s of calendar buckets: another value than ``fingerprint``,
    equal under the same conditions, and no task holds a whole series."""

    def digest(parts: Column) -> Column:
        return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda s: s["s"]), ""))

    per = df.groupBy(*keys, start_of(bucket, F.col("ts")).alias("_part")).agg(
        digest(F.struct("ts", _line(value).alias("s"))).alias("_d"))
    return per.groupBy(*keys).agg(digest(F.struct("_part", F.col("_d").alias("s"))).alias(out))


def merge_bars(base: DataFrame, batch: DataFrame, arrival: str | None = None,
               newest: DataFrame | None = None) -> DataFrame:
    """Upsert: batch rows older than the newest stored bar only fill holes, the
    others replace. Of equal stamps within the batch the first arrival fills,
    the last one replaces; ``arrival`` orders them, without it the smallest
    values win. ``newest`` (keys, _newest)
    gives the newest stored stamps when ``base`` is only a part of the table."""
    cols = base.columns
    if newest is None:
        newest = base.groupBy(*KEYS).agg(F.max("ts").alias("_newest"))
    come = F.col(arrival) if arrival else F.lit(0).cast("long")
    new = batch.withColumn("_come", come.cast("long")).select(*cols, "_come").join(newest, KEYS, "left")
    replaces = F.coalesce(F.col("ts") >= F.col("_newest"), F.lit(False))
    ranked = base.select(*cols, F.lit(1).alias("_class"), F.lit(0).cast("long").alias("_order")).unionByName(
        new.select(*cols, F.when(replaces, 0).otherwise(2).alias("_class"),
                   F.when(replaces, -F.col("_come")).otherwise(F.col("_come")).alias("_order")))
    # without an arrival, rows of one stamp are told apart by their values
    best = Window.partitionBy(*PK).orderBy("_class", "_order", *[F.col(c) for c in cols if c not in PK])
    return (
        ranked.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
        .withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select(*cols)
    )


def force_merge(base: DataFrame, batch: DataFrame, arrival: str | None = None) -> DataFrame:
    """Drop the stored rows whose stamps the batch holds, then upsert it."""
    kept = base.join(batch.select(*PK), PK, "left_anti")
    return merge_bars(kept, batch, arrival)


def _sides(base: DataFrame, other: DataFrame) -> DataFrame:
    return base.select(*PK, known("close").alias("a"), F.lit(True).alias("in_a")).join(
        other.select(*PK, known("close").alias("b"), F.lit(True).alias("in_b")), PK, "full_outer")


def close_diffs(base: DataFrame, other: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Common stamps whose closes differ; a missing close on one side counts."""
    both = _sides(base, other).where("in_a and in_b")
    differ = (F.abs(F.col("a") - F.col("b")) > tol) | (F.col("a").isNull() != F.col("b").isNull())
    return both.where(differ).select(*PK, F.round("a", 4).alias("base_close"), F.round("b", 4).alias("other_close"))


def compare_bars(base: DataFrame, other: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Report per series. Fingerprints agree exactly when no common stamp has a
    different four-decimal close, so no series is concatenated for it."""
    rows = _sides(base, other)
    both = F.col("in_a") & F.col("in_b")
    differ = (F.abs(F.col("a") - F.col("b")) > tol) | (F.col("a").isNull() != F.col("b").isNull())
    text = ~fixed4(F.col("a")).eqNullSafe(fixed4(F.col("b")))
    day = lambda f, side: F.date_format(f(F.when(F.col(side), F.col("ts"))), "yyyy-MM-dd")
    report = rows.groupBy(*KEYS).agg(
        F.count_if(F.col("in_a")).alias("base_count"),
        F.count_if(F.col("in_b")).alias("other_count"),
        F.count_if(both).alias("overlap"),
        F.count_if(F.col("in_b").isNull()).alias("only_base"),
        F.count_if(F.col("in_a").isNull()).alias("only_other"),
        F.coalesce(day(F.min, "in_a"), F.lit("-")).alias("base_start"),
        F.coalesce(day(F.max, "in_a"), F.lit("-")).alias("base_end"),
        F.coalesce(day(F.min, "in_b"), F.lit("-")).alias("other_start"),
        F.coalesce(day(F.max, "in_b"), F.lit("-")).alias("other_end"),
        F.count_if(both & differ).alias("diffs"),
        (F.count_if(both & text) == 0).alias("fingerprint_match"),
    )
    status = (
        F.when(~F.col("fingerprint_match"), "conflict")
        .when(F.col("only_other") > 0, "update_available").otherwise("ok")
    )
    return report.withColumn("status", status)


def backfill_close(bars: DataFrame) -> DataFrame:
    """Give the newest daily bar of a ticker the newest weekly close when its
    own close is missing. ``bars`` holds both timeframes."""
    newest = bars.where("timeframe = '1d'").groupBy(*KEYS).agg(F.max("ts").alias("ts"), F.lit(True).alias("_last"))
    weekly = bars.where("timeframe = '1wk'").groupBy("ticker").agg(F.max_by("close", "ts").alias("_week"))
    # one row per ticker on the right: joined to the few last rows, then back
    fills = newest.join(weekly, "ticker")
    return (
        bars.join(fills, [*KEYS, "ts"], "left")
        .withColumn("close", F.when(F.col("_last"), F.coalesce(known("close"), known("_week"))).otherwise(F.col("close")))
        .select(*bars.columns)
    )


def bad_quotes(df: DataFrame, limit: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars whose close moved more than ``limit`` from the previous close.
    Needs ``idx`` and ``n``."""
    from tidebars.operators.series import chunked, core_rows, in_chunk

    cut = chunked(df, before=1).withColumn("prev_close", F.lag("close").over(in_chunk(keys)))
    move = F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close"))
    return core_rows(cut.withColumn("move", move)).where(F.abs("move") > limit)

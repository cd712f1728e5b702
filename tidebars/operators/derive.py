"""Derivatives, residuals, volatility and running drawdown of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import taps as K
from tidebars.functions.scalars import known
from tidebars.operators.filters import REGISTRY, apply_filter, decay_rows, filter_chunks, filter_reach
from tidebars.operators.series import CHUNK_ROWS, chunk_of, chunked, core_rows, in_chunk, scan
from tidebars.schema import KEYS


def slope(x: str, w) -> Column:
    """Central difference, one-sided at both ends of the series."""
    ahead, back = F.lead(x).over(w), F.lag(x).over(w)
    # the two window values stand once each: at an end both sides use the row itself
    left = F.when(F.col("idx") == 0, F.col(x)).otherwise(back)
    right = F.when(F.col("idx") == F.col("n") - 1, F.col(x)).otherwise(ahead)
    one_sided = (F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1)
    return F.when(F.col("n") > 1, (right - left) / F.when(one_sided, 1.0).otherwise(2.0))


def with_slopes(cut: DataFrame, x: str, w) -> DataFrame:
    """``v``, the slope of ``x``, and ``a``, the slope of that, behind one
    window: both only need the rows up to two places away."""
    near = {k: F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w) for k in (-2, -1, 1, 2)}
    cut = cut.withColumns({f"_near{k}": c for k, c in near.items()})
    value = lambda k: F.col(x) if k == 0 else F.col(f"_near{k}")

    def first(k: int) -> Column:
        at = F.col("idx") + k
        return (
            F.when(at == 0, value(k + 1) - value(k)).when(at == F.col("n") - 1, value(k) - value(k - 1))
            .otherwise((value(k + 1) - value(k - 1)) / 2.0)
        )

    second = (
        F.when(F.col("idx") == 0, first(1) - first(0)).when(F.col("idx") == F.col("n") - 1, first(0) - first(-1))
        .otherwise((first(1) - first(-1)) / 2.0)
    )
    return cut.withColumns({"v": first(0), "a": second}).drop(*[f"_near{k}" for k in near])


def gradient(df: DataFrame, x: str = "filtered", out: str = "v", keys: Sequence[str] = KEYS,
             shift: int = 0, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """First derivative; ``shift=1`` uses closed bars only, the first value
    being repeated at the start."""
    cut = chunked(df, 1 + shift, 1, chunk_rows)
    if shift:
        w = in_chunk(keys)
        cut = cut.withColumn("_x", F.when(F.col("idx") < shift, F.first(x).over(w)).otherwise(F.lag(x, shift).over(w)))
        return core_rows(cut.withColumn(out, slope("_x", w)).drop("_x"))
    return core_rows(cut.withColumn(out, slope(x, in_chunk(keys))))


def derivatives(df: DataFrame, x: str = "filtered", keys: Sequence[str] = KEYS, shift: int = 0,
                chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Velocity ``v`` and acceleration ``a`` in one pass over the chunks."""
    cut = chunked(df, 2 + shift, 2, chunk_rows)
    w = in_chunk(keys)
    src = x
    if shift:
        src = "_x"
        cut = cut.withColumn("_x", F.when(F.col("idx") < shift, F.first(x).over(w)).otherwise(F.lag(x, shift).over(w)))
    return core_rows(with_slopes(cut, src, w).drop("_x"))


def smooth_chunks(cut: DataFrame, filter_id: str, params: dict | None, x: str, keys: Sequence[str],
                  edge: str | None, decimals: int | None, w) -> DataFrame:
    """Filter, velocity and acceleration inside chunks that are cut for it."""
    cut = filter_chunks(cut, filter_id, params, x, "filtered", keys, edge, w)
    if filter_reach(filter_id, params, edge)[2]:
        cut = cut.where((F.col("idx") >= 0) & (F.col("idx") < F.col("n")))
    if decimals is not None:
        cut = cut.withColumn("filtered", F.round("filtered", decimals))
    return with_slopes(cut, "filtered", w)


def smooth_and_derive(df: DataFrame, filter_id: str, params: dict | None = None, x: str = "close",
                      keys: Sequence[str] = KEYS, edge: str | None = None, decimals: int | None = None,
                      chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Filter, velocity and acceleration behind a single shuffle: the halo is
    wide enough for all three. ``decimals`` rounds the filtered value, so that
    thresholds decide alike whatever the order of summation was."""
    if not chunk_filter(filter_id):
        df = apply_filter(df, filter_id, params, x, "filtered", keys, edge, chunk_rows)
        if decimals is not None:
            df = df.withColumn("filtered", F.round("filtered", decimals))
        return derivatives(df, "filtered", keys, chunk_rows=chunk_rows)
    before, after, mirror = filter_reach(filter_id, params, edge)
    cut = chunked(df, before + 2, after + 2, chunk_rows, mirror)
    return core_rows(smooth_chunks(cut, filter_id, params, x, keys, edge, decimals, in_chunk(keys)))


def chunk_filter(filter_id: str) -> bool:
    """Whether a filter runs inside chunks (unknown and whole-table ones do not)."""
    return filter_id in REGISTRY and REGISTRY[filter_id].kind != "table"


def residual(df: DataFrame, filtered: str = "filtered", raw: str = "close", out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(filtered) - F.col(raw))


def block_window(keys: Sequence[str]):
    """Rows of a chunk in index order, written so that it shares its sort with
    windows per block."""
    return Window.partitionBy(*keys, "chunk").orderBy("_blk", "idx")


def with_blocks(cut: DataFrame, span: int) -> DataFrame:
    """``_blk``: blocks over which the weights of ``span`` lose 40 decades."""
    return cut.withColumn("_blk", F.floor(F.col("idx") / F.lit(decay_rows(1.0 - 2.0 / (span + 1.0)))))


def chunk_start(before: int, chunk_rows: int | None) -> Column:
    """Index of the first row in a chunk, halo included."""
    if chunk_rows is None:
        return F.lit(0).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.col("chunk") * chunk_rows - before)


def ewma_chunks(cut: DataFrame, keys: Sequence[str], v: str, span: int, start: Column,
                also: dict[str, Column] | None = None) -> DataFrame:
    """``mu`` and ``sigma`` of ``v`` inside chunks with ``_blk``: exponential
    mean and exponential mean square around it, started at v and 0 on the row
    ``start``. Missing values count as zero here; what follows them is blanked
    by the callers. ``also``: more columns over ``block_window``.

    Within a block the recursion is a running sum of scaled terms; of the
    blocks before only the last one still contributes. One sort serves all.
    """
    keep = 1.0 - 2.0 / (span + 1.0)
    rows = decay_rows(keep)
    at = F.col("idx") - F.col("_blk") * rows
    run = Window.partitionBy(*keys, "chunk", "_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = block_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    up = F.pow(F.lit(keep), at)
    value = F.coalesce(known(v), F.lit(0.0))
    opens = F.col("idx") == start

    def decayed(frame: DataFrame, term: Column, out: str, more: dict[str, Column]) -> DataFrame:
        frame = frame.withColumn("_y", up * F.sum(term / up).over(run))
        carried = F.coalesce(F.last(F.when(at == rows - 1, F.col("_y")), ignorenulls=True).over(before), F.lit(0.0))
        return frame.withColumns({out: F.col("_y") + up * keep * carried, **more})

    cut = decayed(cut, F.when(opens, value).otherwise(value * (1.0 - keep)), "mu", also or {})
    miss = value - F.col("mu")
    cut = decayed(cut, F.when(opens, 0.0).otherwise(miss * miss * (1.0 - keep)), "_var", {})
    return cut.withColumn("sigma", F.sqrt("_var")).drop("_y", "_var")


def ewma_reach(span: int) -> int:
    return K.settle(1.0 - 2.0 / (span + 1.0)) + 1


def first_missing(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Index of the first missing value per series (no row when none is)."""
    return df.where(known(v).isNull()).groupBy(*keys).agg(F.min("idx").alias("_missing_from"))


def ewma_volatility(df: DataFrame, v: str = "v", span: int = 60, keys: Sequence[str] = KEYS,
                    chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``mu`` and ``sigma``; a missing value makes both missing from there on."""
    cut = with_blocks(chunked(df, ewma_reach(span), 0, chunk_rows), span)
    cut = core_rows(ewma_chunks(cut, keys, v, span, chunk_start(ewma_reach(span), chunk_rows))).drop("_blk")
    holed = cut.join(first_missing(df, keys, v), list(keys), "left")
    good = F.col("_missing_from").isNull() | (F.col("idx") < F.col("_missing_from"))
    return (
        holed.withColumns({"mu": F.when(good, F.col("mu")), "sigma": F.when(good, F.col("sigma"))})
        .drop("_missing_from")
    )


def deadband(sigma: Column, k_eps, sigma_min) -> Column:
    """k * max(sigma, floor), NULL while sigma is missing (``greatest`` alone
    would skip the NULL)."""
    k = k_eps if isinstance(k_eps, Column) else F.lit(k_eps)
    floor = sigma_min if isinstance(sigma_min, Column) else F.lit(sigma_min)
    return F.when(sigma.isNotNull(), k * F.greatest(sigma, floor))


def drawdown(df: DataFrame, p: str, out: str = "drawdown_pct", keys: Sequence[str] = KEYS,
             chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Distance in percent from the running maximum."""
    peaks = scan(df, keys, chunk_of(chunk_rows=chunk_rows), ["idx"], {"_peak": ("max", F.col(p), False)})
    return peaks.withColumn(out, F.try_divide(F.col(p) - F.col("_peak"), F.col("_peak")) * 100.0).drop("_peak")


def roughness(df: DataFrame, x: str = "filtered", out: str = "roughness", keys: Sequence[str] = KEYS,
              chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Sum of squared second differences per series, 0 for fewer than 3 rows."""
    w = in_chunk(keys)
    bend = F.col(x) - 2.0 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)
    cut = chunked(df.select(*keys, "idx", "n", x), 2, 0, chunk_rows).withColumn("_bend", bend)
    return core_rows(cut).groupBy(*keys).agg(F.coalesce(F.sum(F.col("_bend") * F.col("_bend")), F.lit(0.0)).alias(out))

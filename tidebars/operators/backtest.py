"""Entries, exits, trades and equity curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.fits import at, attach_fit, direction
from tidebars.operators.series import CHUNK_ROWS, chunk_of, chunked, core_rows, in_chunk, scan
from tidebars.schema import KEYS


def _good(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & (p > 0)


def entries(pairs: DataFrame, fits: DataFrame, n_ext: int | str = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs whose predicted direction agrees with the signal that ends them,
    entered on their last row when its price is valid. ``pairs`` carry that
    price (``find_pairs`` with ``x``), so the bars are not needed."""
    aimed = direction(attach_fit(pairs, fits, keys), n_ext)
    side = F.when((F.col("v2") == 1) & F.col("up"), "long").when((F.col("v2") == -1) & ~F.col("up"), "short")
    return (
        aimed.withColumn("type", side).where(F.col("type").isNotNull() & _good(F.col("y_end")))
        .withColumnsRenamed({"end_idx": "entry_idx", "y_end": "entry_price"})
    )


def reverse_signals(bars: DataFrame, entered: DataFrame, keys: Sequence[str] = KEYS, price: str = "filtered",
                    chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Per entry the first later row (``idx``, ``p``) with a valid price and the
    opposite signal, read backwards over the rows that carry a signal."""
    keys = list(keys)
    live = bars.where((F.col("sig") != 0) & _good(F.col(price))).select(
        *keys, "idx", "sig", F.col(price).alias("p"), F.lit(0).alias("_is"))
    asked = entered.select(*keys, F.col("entry_idx").alias("idx"), F.lit(None).cast("int").alias("sig"),
                           F.lit(None).cast("double").alias("p"), F.lit(1).alias("_is"))
    found = scan(live.unionByName(asked), keys, chunk_of(chunk_rows=chunk_rows), ["idx", "_is"], {
        "_next_up": ("last", F.when(F.col("sig") == 1, F.struct("idx", "p")), False),
        "_next_down": ("last", F.when(F.col("sig") == -1, F.struct("idx", "p")), False)}, reverse=True)
    return found.where("_is = 1").select(*keys, F.col("idx").alias("entry_idx"), "_next_up", "_next_down")


def first_exit(entered: DataFrame, bars: DataFrame, stop_loss_pct: float | str = 2.0, n_ext: int | str = 10,
               keys: Sequence[str] = KEYS, price: str = "filtered", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Exit row, price and reason. Within ``n_ext`` rows after the entry a price
    beyond the stop around the prediction ends the trade, at any time the
    reverse signal does; the stop wins a tie. Otherwise the last row of the
    series. Exits without a valid price are dropped."""
    keys = list(keys)
    steps = F.col(n_ext) if isinstance(n_ext, str) else F.lit(n_ext)
    share = (F.col(stop_loss_pct) if isinstance(stop_loss_pct, str) else F.lit(float(stop_loss_pct))) / 100.0
    guarded = entered.withColumn("idx", F.explode(F.sequence(F.col("entry_idx") + 1, F.col("entry_idx") + steps)))
    priced = guarded.join(bars.select(*keys, "idx", F.col(price).alias("_p")), [*keys, "idx"]).where(_good(F.col("_p")))
    pred = at(F.col("idx").cast("double"))
    stop = F.when(F.col("type") == "long", F.col("_p") < pred * (1 - share)).otherwise(F.col("_p") > pred * (1 + share))
    stops = priced.where(_good(pred) & stop).groupBy(*keys, "entry_idx").agg(
        F.min("idx").alias("_stop"), F.min_by("_p", "idx").alias("_stop_price"))
    turns = reverse_signals(bars, entered, keys, price, chunk_rows)
    ends = bars.where(F.col("idx") == F.col("n") - 1).select(*keys, F.col(price).alias("_last_price"))
    out = entered.join(stops, [*keys, "entry_idx"], "left").join(turns, [*keys, "entry_idx"]).join(ends, keys)
    turn = F.when(F.col("type") == "long", F.col("_next_down")).otherwise(F.col("_next_up"))
    out = out.withColumn("_turn", turn)
    stopped = F.col("_stop").isNotNull() & (F.col("_turn").isNull() | (F.col("_stop") <= F.col("_turn.idx")))
    pick = lambda s, t, e: F.when(stopped, s).when(F.col("_turn").isNotNull(), t).otherwise(e)
    return (
        out.withColumns({
            "exit_reason": pick(F.lit("stop_loss"), F.lit("take_profit"), F.lit("eod")),
            "exit_idx": pick(F.col("_stop"), F.col("_turn.idx"), F.col("n") - 1),
            "exit_price": pick(F.col("_stop_price"), F.col("_turn.p"), F.col("_last_price"))})
        .where((F.col("exit_idx") > F.col("entry_idx")) & _good(F.col("exit_price")))
        .drop("_stop", "_stop_price", "_turn", "_next_up", "_next_down", "_last_price")
    )


def make_trades(exits: DataFrame, keys: Sequence[str] = KEYS, cost_bps: float = 0.0,
                chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Trades with return and id in entry order; ``cost_bps`` is taken off the
    return of every trade."""
    keys = list(keys)
    move = F.when(F.col("type") == "long", F.col("exit_price") - F.col("entry_price")).otherwise(
        F.col("entry_price") - F.col("exit_price"))
    ret = move / F.col("entry_price") - F.lit(cost_bps / 10_000.0)
    numbered = scan(exits, keys, chunk_of("entry_idx", chunk_rows), ["entry_idx"], {"id": ("sum", F.lit(1), False)})
    return numbered.select(
        *keys, F.col("id").cast("int").alias("id"), "type", "entry_idx", "exit_idx", "entry_price", "exit_price",
        (ret * 100.0).alias("return_pct"), "exit_reason")


def with_costs(trades: DataFrame, bps: float) -> DataFrame:
    return trades.withColumn("return_pct", F.col("return_pct") - F.lit(bps / 100.0))


def capital(trades: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Capital before and after every trade, compounded from 100 per side."""
    growth = 1.0 + F.col("return_pct") / 100.0
    grown = scan(trades, [*keys, "type"], chunk_of("entry_idx", chunk_rows), ["entry_idx"], {
        "capital_before": ("product", growth, True), "capital_after": ("product", growth, False)})
    return grown.withColumns({c: F.col(c) * 100.0 for c in ("capital_before", "capital_after")})


def equity(bars: DataFrame, trades: DataFrame, keys: Sequence[str] = KEYS, price: str = "filtered",
           chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``long_pnl`` and ``short_pnl`` on every bar: 100 before the first trade,
    marked to the price while a trade is open, flat after it. An invalid price
    inside a trade repeats the last mark. Bars and trades go through one scan."""
    keys = list(keys)
    others = [c for c in bars.columns if c not in keys]
    t_type = "struct<exit_idx:bigint,entry_price:double,capital_before:double,capital_after:double>"
    none = F.lit(None)
    rows = bars.select(*keys, "idx", F.lit(1).alias("_side"), F.struct(*others).alias("_row"),
                       F.when(_good(F.col(price)), F.col(price)).alias("_p"), none.cast(t_type).alias("_t"), none.cast("string").alias("_type"))
    opened = capital(trades, keys, chunk_rows).select(
        *keys, F.col("entry_idx").alias("idx"), F.lit(0).alias("_side"), none.cast(rows.schema["_row"].dataType).alias("_row"),
        none.cast("double").alias("_p"), F.struct("exit_idx", "entry_price", "capital_before", "capital_after").alias("_t"),
        F.col("type").alias("_type"))
    found = scan(rows.unionByName(opened), keys, chunk_of(chunk_rows=chunk_rows), ["idx", "_side"], {
        "_long": ("last", F.when(F.col("_type") == "long", F.col("_t")), False),
        "_short": ("last", F.when(F.col("_type") == "short", F.col("_t")), False),
        "_mark": ("last", F.col("_p"), False)})

    def curve(t: str, sign: int) -> Column:
        entry = F.col(f"{t}.entry_price")
        open_value = F.col(f"{t}.capital_before") * (1.0 + sign * (F.col("_mark") - entry) / entry)
        return (
            F.when(F.col(t).isNull(), F.lit(100.0))
            .when(F.col("idx") <= F.col(f"{t}.exit_idx"), open_value)
            .otherwise(F.col(f"{t}.capital_after"))
        )

    return found.where(F.col("_row").isNotNull()).select(
        *keys, "_row.*", curve("_long", 1).alias("long_pnl"), curve("_short", -1).alias("short_pnl"))


def summary(trades: DataFrame, curves: DataFrame, keys: Sequence[str] = KEYS,
            chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Trades, wins, returns and deepest drawdown per side of every series."""
    keys = list(keys)
    peaks = scan(curves.select(*keys, "idx", "long_pnl", "short_pnl"), keys, chunk_of(chunk_rows=chunk_rows), ["idx"], {
        "_lp": ("max", F.col("long_pnl"), False), "_sp": ("max", F.col("short_pnl"), False)})
    fall = lambda p, m: F.min(F.try_divide(F.col(p) - F.col(m), F.col(m)) * 100.0)
    per_series = peaks.groupBy(*keys).agg(
        (F.max_by("long_pnl", "idx") - 100.0).alias("long_return"),
        (F.max_by("short_pnl", "idx") - 100.0).alias("short_return"),
        fall("long_pnl", "_lp").alias("long_drawdown"), fall("short_pnl", "_sp").alias("short_drawdown"))
    counts = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("return_pct") > 0).alias("wins"))
    return (
        per_series.join(counts, keys, "left").na.fill(0, ["trades", "wins"])
        .withColumn("total_return", F.col("long_return") + F.col("short_return"))
    )


def atr(df: DataFrame, n: int = 14, keys: Sequence[str] = KEYS, out: str = "atr",
        chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Mean of the last ``n`` true ranges, NULL until there are ``n``."""
    w = in_chunk(keys)
    cut = chunked(df, n, 0, chunk_rows)
    cut = cut.withColumn("_before", F.lag("close").over(w))
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before")))
    cut = cut.withColumn("_tr", reach).drop("_before")
    frame = w.rowsBetween(-(n - 1), 0)
    mean = F.when(F.col("idx") >= n - 1, F.avg("_tr").over(frame))
    return core_rows(cut.withColumn(out, mean).drop("_tr"))


def atr_stop(entered: DataFrame, ranges: DataFrame, stop_loss_pct: float = 2.0, mult: float = 2.0,
             keys: Sequence[str] = KEYS) -> DataFrame:
    """Stop in percent per entry, ``max(fixed, mult * ATR / price)``, with the
    ATR of the entry row. Pass ``stop_pct`` as ``stop_loss_pct`` to
    ``first_exit``."""
    keys = list(keys)
    frozen = ranges.select(*keys, F.col("idx").alias("entry_idx"), "atr")
    wide = F.try_divide(F.col("atr"), F.col("entry_price")) * (mult * 100.0)
    return entered.join(frozen, [*keys, "entry_idx"], "left").withColumn(
        "stop_pct", F.greatest(F.lit(float(stop_loss_pct)), wide))


def gate(entered: DataFrame, bars: DataFrame, fast: str | None = None, slow: str | None = None,
         sigma: str | None = None, sigma_min: float = 0.05, higher_sig: str | None = None,
         keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep entries that pass the wanted gates: trend (fast above slow for
    longs, below for shorts), volatility (sigma above its floor), confirmation
    (the higher signal points the same way). Names are columns of ``bars``."""
    keys = list(keys)
    names = [c for c in (fast, slow, sigma, higher_sig) if c]
    out = entered.join(bars.select(*keys, F.col("idx").alias("entry_idx"), *[F.col(c).alias(f"_g_{c}") for c in names]),
                       [*keys, "entry_idx"])
    sign = F.when(F.col("type") == "long", 1).otherwise(-1)
    if fast and slow:
        out = out.where((F.col(f"_g_{fast}") - F.col(f"_g_{slow}")) * sign > 0)
    if sigma:
        out = out.where(F.col(f"_g_{sigma}") > sigma_min)
    if higher_sig:
        out = out.where(F.col(f"_g_{higher_sig}") == sign)
    return out.drop(*[f"_g_{c}" for c in names])


def rolling_perf(trades: DataFrame, n: int = 30, keys: Sequence[str] = KEYS,
                 chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Sharpe ratio and win rate over the last ``n`` trades."""
    rows = trades.withColumns({"idx": F.col("id").cast("long"), "n": F.lit(2**60)})
    cut = chunked(rows, n, 0, chunk_rows)
    frame = in_chunk(keys).rowsBetween(-(n - 1), 0)
    ret = F.col("return_pct")
    return core_rows(cut.withColumns({
        "sharpe": F.try_divide(F.avg(ret).over(frame), F.stddev_samp(ret).over(frame)),
        "win_rate": F.avg((ret > 0).cast("double")).over(frame),
        "window_trades": F.count(F.lit(1)).over(frame)})).drop("idx", "n")

"""As-of joins and the alignment of a higher timeframe with a lower one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.scalars import start_of
from tidebars.operators.series import CHUNK_ROWS, chunk_of, scan
from tidebars.schema import KEYS, tf_dim


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str,
                  cols: Sequence[str], bucket: Column | None, exclusive: bool = False) -> DataFrame:
    """For every left row the newest right row with ``right.on <= left.on``
    (``<`` when exclusive). Both sides are put into one stream per key and
    bucket; what the earlier buckets hold comes in as one carried row. Without
    a bucket every key is known to be short."""
    by = list(by)
    hit = F.struct(*[F.col(c) for c in cols])
    l_cols = [c for c in left.columns]
    empty = F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType)
    side_left = left.select(*by, F.col(on).alias("_on"), F.lit(0 if exclusive else 1).alias("_side"),
                            F.struct(*l_cols).alias("_row"), empty.alias("_hit"))
    no_row = F.lit(None).cast(side_left.schema["_row"].dataType)
    side_right = right.select(*by, F.col(on).alias("_on"), F.lit(1 if exclusive else 0).alias("_side"),
                              no_row.alias("_row"), hit.alias("_hit"))
    both = side_left.unionByName(side_right).withColumn(on, F.col("_on"))
    part = None
    if bucket is not None:
        both, part = both.withColumn("_part", bucket), F.col("_part")
    found = scan(both.drop(on), by, part, ["_on", "_side"], {"_found": ("last", F.col("_hit"), False)})
    return found.where(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in cols])


def month_of(ts: str = "ts") -> Column:
    return start_of("month", F.col(ts))


def bar_end(ts: Column, timeframe: Column) -> Column:
    """End of a start-labelled bar, which is when it is closed."""
    return (
        F.when(timeframe == "1m", ts + F.make_dt_interval(mins=F.lit(1)))
        .when(timeframe == "5m", ts + F.make_dt_interval(mins=F.lit(5)))
        .when(timeframe == "15m", ts + F.make_dt_interval(mins=F.lit(15)))
        .when(timeframe == "60m", ts + F.make_dt_interval(hours=F.lit(1)))
        .when(timeframe == "1d", ts + F.make_dt_interval(days=F.lit(1)))
        .when(timeframe == "1wk", ts + F.make_dt_interval(days=F.lit(7)))
        .when(timeframe == "1mo", ts + F.make_ym_interval(months=F.lit(1)))
        .otherwise(ts + F.make_ym_interval(months=F.lit(3)))
    )


def higher_of(df: DataFrame) -> DataFrame:
    """Add ``higher_tf``, the next timeframe up (NULL at the top)."""
    dim = tf_dim(df.sparkSession).select("timeframe", "higher_tf")
    return df.join(F.broadcast(dim), "timeframe", "left").select(*df.columns, "higher_tf")


def asof_higher(lower: DataFrame, higher: DataFrame, cols: Sequence[str], mode: str = "reference",
                by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Bring ``cols`` of the next timeframe up onto the lower bars. Mode
    ``reference`` takes the last bar that has started, ``closed`` the last one
    that has ended. Bars without a higher series get NULL."""
    keys = [*by, "higher_tf"]
    stamp = bar_end(F.col("ts"), F.col("timeframe")) if mode == "closed" else F.col("ts")
    right = higher.withColumn("_stamp", stamp).withColumn("higher_tf", F.col("timeframe"))
    left = higher_of(lower).withColumn("_stamp", F.col("ts"))
    found = asof_backward(left, right.select(*keys, "_stamp", *cols), keys, "_stamp", cols, month_of("_stamp"))
    return found.drop("_stamp")


def align_pnl(lower: DataFrame, higher_equity: DataFrame, mode: str = "reference",
              by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Higher curves on the lower bars as ``aligned_long``, ``aligned_short``."""
    curves = higher_equity.withColumnsRenamed({"long_pnl": "aligned_long", "short_pnl": "aligned_short"})
    return asof_higher(lower, curves, ["aligned_long", "aligned_short"], mode, by)


def events_to_bars(trades: DataFrame, higher: DataFrame, aligned: DataFrame,
                   by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Entry and exit events of higher-timeframe trades as markers on the lower
    bars: the last lower bar not after the event, its aligned value (100 when
    missing). Trades whose rows are not in ``higher`` are dropped, events
    before the first lower bar as well."""
    by = list(by)
    stamps = higher.select(*by, F.col("timeframe").alias("higher_tf"), "idx", F.col("ts").alias("_at"))
    both = trades.withColumnRenamed("timeframe", "higher_tf")
    entry = stamps.withColumnsRenamed({"idx": "entry_idx", "_at": "_entry_at"})
    exit_ = stamps.withColumnsRenamed({"idx": "exit_idx", "_at": "_exit_at"})
    timed = both.join(entry, [*by, "higher_tf", "entry_idx"]).join(exit_, [*by, "higher_tf", "exit_idx"])
    kinds = F.array(
        F.struct(F.lit("entry").alias("kind"), F.col("_entry_at").alias("at"),
                 F.lit(None).cast("double").alias("return_pct"), F.lit(None).cast("string").alias("exit_reason")),
        F.struct(F.lit("exit").alias("kind"), F.col("_exit_at").alias("at"),
                 F.col("return_pct"), F.col("exit_reason")),
    )
    events = timed.withColumn("_e", F.explode(kinds)).select(
        *by, "higher_tf", "id", F.col("type").alias("side"), F.col("_e.kind").alias("kind"),
        F.col("_e.at").alias("_at"), F.col("_e.return_pct").alias("return_pct"),
        F.col("_e.exit_reason").alias("exit_reason"))
    bars = higher_of(aligned).where("higher_tf is not null") if "higher_tf" not in aligned.columns else aligned
    bars = bars.select(*by, "higher_tf", F.col("ts").alias("_at"), "timeframe", F.col("idx").alias("bar_idx"),
                       "aligned_long", "aligned_short")
    hits = asof_backward(events, bars, [*by, "higher_tf"], "_at",
                         ["timeframe", "bar_idx", "aligned_long", "aligned_short"], month_of("_at"))
    value = F.when(F.col("side") == "long", F.col("aligned_long")).otherwise(F.col("aligned_short"))
    return hits.where("bar_idx is not null").select(
        *by, "timeframe", "id", "side", "kind", "bar_idx", F.coalesce(value, F.lit(100.0)).alias("pnl"),
        "return_pct", "exit_reason")


def next_exit(markers: DataFrame, bar_counts: DataFrame, keys: Sequence[str] = KEYS,
              chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """For every entry marker the first exit of the same side strictly after
    it, else the last bar. ``bar_counts`` has one ``n`` per series."""
    keys = list(keys)
    # read from the end; on one bar the entry comes before the exit is seen
    rows = markers.select(*keys, "side", "kind", "bar_idx", (F.col("kind") == "entry").cast("int").alias("_is"))
    found = scan(rows, [*keys, "side"], chunk_of("bar_idx", chunk_rows), ["bar_idx", "_is"], {
        "_later": ("last", F.when(F.col("kind") == "exit", F.col("bar_idx")), False)}, reverse=True)
    return (
        found.where("kind = 'entry'").join(bar_counts.select(*keys, "n"), keys)
        .select(*keys, "side", F.col("bar_idx").alias("entry_bar"),
                F.coalesce("_later", F.col("n") - 1).alias("exit_bar"))
    )


def holding_masks(bars: DataFrame, holds: DataFrame, keys: Sequence[str] = KEYS,
                  chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``long_mask`` and ``short_mask``: true on every bar between an entry and
    its exit. A sweep adds one at each entry and takes one away after each
    exit, so overlapping holds need no range join."""
    keys = list(keys)
    steps = holds.select(*keys, "side", F.explode(F.array(
        F.struct(F.col("entry_bar").alias("idx"), F.lit(1).alias("d")),
        F.struct((F.col("exit_bar") + 1).alias("idx"), F.lit(-1).alias("d")))).alias("_s"))
    per_bar = steps.groupBy(*keys, F.col("_s.idx").alias("idx")).agg(
        F.sum(F.when(F.col("side") == "long", F.col("_s.d"))).alias("_l"),
        F.sum(F.when(F.col("side") == "short", F.col("_s.d"))).alias("_r"))
    stepped = bars.join(per_bar, [*keys, "idx"], "left")
    open_now = scan(stepped, keys, chunk_of(chunk_rows=chunk_rows), ["idx"],
                    {"_lo": ("sum", F.col("_l"), False), "_so": ("sum", F.col("_r"), False)})
    return open_now.withColumn("long_mask", F.col("_lo") > 0).withColumn("short_mask", F.col("_so") > 0).drop(
        "_l", "_r", "_lo", "_so")


def aligned_equity(df: DataFrame, keys: Sequence[str] = KEYS, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Curves that move with ``long_pnl``/``short_pnl`` only while the mask of
    their side holds; 100 at the start."""
    from tidebars.operators.series import chunked, core_rows, in_chunk

    w = in_chunk(keys)
    cut = chunked(df, before=1, chunk_rows=chunk_rows)
    cut = cut.withColumns({f"_prev_{side}": F.lag(f"{side}_pnl").over(w) for side in ("long", "short")})
    for side in ("long", "short"):
        prev = F.col(f"_prev_{side}")
        moves = F.col(f"{side}_mask") & (F.col("idx") > 0) & (prev != 0)
        cut = cut.withColumn(f"_{side}", F.when(moves, F.try_divide(F.col(f"{side}_pnl"), prev)).otherwise(1.0))
    grown = scan(core_rows(cut.drop("_prev_long", "_prev_short")), keys, chunk_of(chunk_rows=chunk_rows), ["idx"], {
        f"_{side}_f": ("product", F.col(f"_{side}"), False) for side in ("long", "short")})
    return (
        grown.withColumn("long_filtered", F.col("_long_f") * 100.0)
        .withColumn("short_filtered", F.col("_short_f") * 100.0)
        .drop("_long", "_short", "_long_f", "_short_f")
    )


def masked_trades(trades: DataFrame, masks: DataFrame, keys: Sequence[str] = KEYS,
                  chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Trades that overlap the mask of their side, with flags whether entry and
    exit bars are masked. Overlap: the running count of masked bars grows
    between the two ends of the trade, so two look-ups replace a range join."""
    keys = list(keys)
    counted = masks
    for side in ("long", "short"):
        counted = counted.withColumn(f"_{side}", F.col(f"{side}_mask").cast("int"))
    counted = scan(counted.select(*keys, "idx", "long_mask", "short_mask", "_long", "_short"), keys,
                   chunk_of(chunk_rows=chunk_rows), ["idx"],
                   {"_nl": ("sum", F.col("_long"), False), "_ns": ("sum", F.col("_short"), False)})
    per_side = counted.select(*keys, "idx", F.explode(F.array(
        F.struct(F.lit("long").alias("type"), F.col("long_mask").alias("on"), F.col("_nl").alias("upto")),
        F.struct(F.lit("short").alias("type"), F.col("short_mask").alias("on"), F.col("_ns").alias("upto")),
    )).alias("m")).select(*keys, "idx", "m.*")
    at_entry = per_side.withColumnsRenamed({"idx": "entry_idx", "on": "entry_masked", "upto": "_from"})
    at_exit = per_side.withColumnsRenamed({"idx": "exit_idx", "on": "exit_masked", "upto": "_upto"})
    return (
        trades.join(at_entry, [*keys, "type", "entry_idx"]).join(at_exit, [*keys, "type", "exit_idx"])
        .where((F.col("_upto") > F.col("_from")) | F.col("entry_masked"))
        .withColumn("exit_masked", F.col("exit_masked") & F.col("exit_reason").isin("stop_loss", "take_profit"))
        .select(*trades.columns, "entry_masked", "exit_masked")
    )


def combine_levels(base: DataFrame, signals: DataFrame, weights: dict[str, float], sig: str = "sig",
                   by: Sequence[str] = ("ticker",), level: str = "timeframe") -> DataFrame:
    """Weighted mean of the signals of several levels (values of ``level`` in ``signals``) on
    the rows of ``base``, and the share of weight that disagrees with its sign. Each row
    meets the last signal of every level up to its ``ts`` (none: 0). Rows and signals of
    all levels go through one scan, whatever their number."""
    by, names = list(by), {tf: f"sig_{tf}" for tf in weights}
    hit = F.struct(F.col(sig).alias("s"))
    told = signals.where(F.col(level).isin(list(weights))).select(
        *by, F.col("ts").alias("_on"), F.lit(0).alias("_side"), *[F.when(F.col(level) == tf, hit).alias(name) for tf, name in names.items()])
    rows = base.select(*by, F.col("ts").alias("_on"), F.lit(1).alias("_side"), F.struct(*base.columns).alias("_row"))
    both = rows.unionByName(told, allowMissingColumns=True).withColumn("_part", month_of("_on"))
    found = scan(both, by, F.col("_part"), ["_on", "_side"], {f"_{name}": ("last", F.col(name), False) for name in names.values()})
    out = found.where(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_{name}.s").alias(name) for name in names.values()])
    total = sum(float(w) for w in weights.values())
    share = lambda c, w: F.coalesce(F.col(c), F.lit(0)) * F.lit(float(w))
    out = out.withColumn("combined", sum((share(names[tf], w) for tf, w in weights.items()), F.lit(0.0)) / F.lit(total))
    against = [F.when(F.signum(F.coalesce(F.col(names[tf]), F.lit(0)).cast("double")) != F.signum("combined"), F.lit(float(w))).otherwise(0.0) for tf, w in weights.items()]
    return out.withColumn("disagreement", sum(against, F.lit(0.0)) / F.lit(total))


def combine_signals(base: DataFrame, levels: dict[str, tuple[DataFrame, float]], sig: str = "sig",
                    by: Sequence[str] = ("ticker",)) -> DataFrame:
    """``combine_levels`` for signals that lie in a frame per level."""
    parts = [other.select(*by, "ts", F.lit(tf).alias("_level"), sig) for tf, (other, _) in levels.items()]
    return combine_levels(base, reduce(DataFrame.unionByName, parts), {tf: w for tf, (_, w) in levels.items()}, sig, by, "_level")

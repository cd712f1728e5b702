"""Hysteresis signal, its runs and the pairs of opposite entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.scalars import known
from tidebars.operators.derive import (
    block_window, chunk_filter, chunk_start, deadband, ewma_chunks, ewma_reach, smooth_and_derive, smooth_chunks, with_blocks,
)
from tidebars.operators.filters import filter_reach
from tidebars.operators.series import CHUNK_ROWS, chunk_of, chunked, core_rows, in_chunk, scan
from tidebars.schema import KEYS

STATES = (-1, 0, 1)

# Kinds of runs, see _states_in_chunk.
KIND_A, KIND_B, KIND_C = 0, 1, 2


def _states_in_chunk(cut: DataFrame, keys: Sequence[str], states: Sequence[int]) -> DataFrame:
    """State of every row for each of the states the chunk may be entered with,
    as columns ``_s-1``, ``_s0``, ``_s1``.

    A row pushes up (+1), pushes down (-1) or does nothing; a push is strong
    when the velocity agrees with it. Pushes of one direction form a run. The
    first push of a run only releases an opposite state, a strong push in
    neutral enters. At its end a run therefore is one of three kinds: ``a``
    (no strong push) ends neutral, ``c`` (a strong push after the first) ends
    in its own direction, ``b`` (only the first is strong) depends on how it
    was entered. Within a chain of ``b`` runs the outcome alternates, so the
    state follows from the last run that is not ``b`` and a parity. All of it
    is running values over one window, no row loop.
    """
    w = block_window(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, frame: F.last(c, ignorenulls=True).over(frame)
    push, opens, run = F.col("_push"), F.col("_opens"), F.col("_run")

    cut = cut.withColumns({"_prev": last(push, before), "_seen": F.count(push).over(upto)})
    cut = cut.withColumn("_opens", push.isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") != push)))
    cut = cut.withColumns({
        "_run": F.sum(opens.cast("long")).over(upto),
        # what opened the run: its place among the pushes, strong or not, up or down
        "_open": last(F.when(opens, F.col("_seen") * 4 + F.col("_strong").cast("int") * 2 + (push > 0).cast("int")), upto),
        "_last_strong": last(F.when(F.col("_strong"), F.col("_seen")), upto),
    })
    first = F.col("_open").bitwiseAND(2) == 2
    up = F.col("_open").bitwiseAND(1) == 1
    cut = cut.withColumns({
        "_dir": F.when(up, 1).when(~up, -1), "_first": first,
        "_later": F.coalesce(F.col("_last_strong") > F.floor(F.col("_open") / 4), F.lit(False))})
    kind = F.when(F.col("_later"), KIND_C).when(F.col("_first"), KIND_B).otherwise(KIND_A)
    cut = cut.withColumn("_kind", F.when(push.isNotNull(), kind * 2 + (F.col("_dir") > 0).cast("int")))
    cut = cut.withColumn("_was", last(F.col("_kind"), before))
    # At the row that opens run r >= 2: does run r - 1 fix the state by itself?
    fixes = opens & (run > 1) & ((F.floor(F.col("_was") / 2) != KIND_B) | (run == 2))
    cut = cut.withColumn("_fixed", last(F.when(fixes, (run - 1) * 8 + F.col("_was")), upto))
    fixed_run, fixed_kind = F.floor(F.col("_fixed") / 8), F.floor(F.col("_fixed") / 2) % 4
    fixed_dir = F.when(F.col("_fixed") % 2 == 1, 1).otherwise(-1)

    def state(s: int) -> Column:
        came = F.lit(s)
        outcome = (
            F.when(fixed_kind == KIND_C, True)
            .when(fixed_run > 1, False)
            .when(fixed_kind == KIND_A, came == fixed_dir)
            .otherwise(came != -fixed_dir)
        )
        odd = (run - 1 - fixed_run) % 2 == 1
        entered = F.when(run == 1, came).otherwise(F.when(outcome != odd, -F.col("_dir")).otherwise(0))
        return (
            F.when(run == 0, came)
            .when(entered == F.col("_dir"), F.col("_dir"))
            .when(entered == 0, F.when(F.col("_first") | F.col("_later"), F.col("_dir")).otherwise(0))
            .otherwise(F.when(F.col("_later"), F.col("_dir")).otherwise(0))
        ).cast("int")

    return cut.withColumns({f"_s{s}": state(s) for s in states}).drop(
        "_prev", "_seen", "_opens", "_run", "_open", "_dir", "_first", "_last_strong", "_later", "_kind", "_was", "_fixed")


# Maps that are applied one after the other in one array.
MAPS_AT_ONCE = 256


def _steps(maps: DataFrame, at: str, up: Sequence[str]) -> DataFrame:
    step = F.struct(F.col(at).alias("at"), F.array("_m-1", "_m0", "_m1").alias("m"))
    return maps.groupBy(*up).agg(F.array_sort(F.collect_list(step)).alias("_steps"))


def _composed(maps: DataFrame, at: str, up: Sequence[str]) -> DataFrame:
    """One map for each group of maps applied in the order of ``at``."""
    through = lambda s: F.aggregate("_steps", F.lit(s), lambda came, step: F.get(step["m"], came + 1))
    return _steps(maps, at, up).select(*up, *[through(s).alias(f"_m{s}") for s in STATES])


def _walked(maps: DataFrame, at: str, up: Sequence[str], entered: DataFrame | None) -> DataFrame:
    """``_came``: the state that each member of a group is entered with, given that of the group."""
    groups = _steps(maps, at, up)
    groups = groups.withColumn("_came", F.lit(0)) if entered is None else groups.join(entered, list(up))
    walked = F.aggregate(
        "_steps", F.struct(F.col("_came").alias("s"), F.array().cast("array<struct<at:bigint,s:int>>").alias("seen")),
        lambda acc, step: F.struct(F.get(step["m"], acc["s"] + 1).alias("s"),
                                   F.concat(acc["seen"], F.array(F.struct(step["at"].alias("at"), acc["s"].alias("s")))).alias("seen")),
        lambda acc: acc["seen"])
    return groups.select(*up, F.explode(walked).alias("_e")).select(*up, F.col("_e.at").alias(at), F.col("_e.s").alias("_came"))


def _entered_with(maps: DataFrame, keys: Sequence[str], group: int = MAPS_AT_ONCE) -> DataFrame:
    """State each chunk is entered with: the maps of the chunks before it applied to 0.
    Maps are composed group by group, up and down a tree of three levels, so an array holds
    ``group`` maps at most (the topmost as many as 1 / ``group``^2 of the chunks)."""
    keys = list(keys)
    chunks = maps.withColumn("_g1", F.expr(f"chunk div {group}"))
    one = _composed(chunks, "chunk", [*keys, "_g1"]).withColumn("_g2", F.expr(f"_g1 div {group}"))
    two = _composed(one, "_g1", [*keys, "_g2"])
    entered = _walked(one, "_g1", [*keys, "_g2"], _walked(two, "_g2", keys, None)).drop("_g2")
    came = _walked(chunks, "chunk", [*keys, "_g1"], entered).drop("_g1")
    return came.join(maps.select(*keys, "chunk", "_stuck"), [*keys, "chunk"])


def trigger_chunks(cut: DataFrame, span: int, k_eps: float | str, sigma_min: float | str, keys: Sequence[str],
                   decimals: int | None, before: int, chunk_rows: int | None) -> DataFrame:
    """Trigger on chunks that carry ``v``, ``a``, ``_blk`` and halo rows; the
    result holds the core rows. Chunks are read on as maps of the state only
    where a series has several."""
    from tidebars.sources.storage import materialize

    keys = list(keys)
    as_col = lambda p: F.col(p) if isinstance(p, str) else F.lit(float(p))
    # A missing v freezes everything after it, also in later chunks. Halo rows
    # do not count: what is missing there is missing in the chunk before.
    holes = F.when(F.col("core") & known("v").isNull(), 1)
    frozen = F.count(holes).over(block_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0
    cut = ewma_chunks(cut, keys, "v", span, chunk_start(before, chunk_rows), {"_frozen": frozen}).where("core")
    exact = (lambda c: c) if decimals is None else (lambda c: F.round(c, decimals))
    cut = cut.withColumn("eps", deadband(F.col("sigma"), as_col(k_eps), as_col(sigma_min)))
    a, v, band = exact(known("a")), exact(known("v")), exact(F.col("eps"))
    push = F.when(v.isNotNull() & ~F.col("_frozen"), F.when(a > band, 1).when(a < -band, -1))
    cut = cut.withColumn("_push", push)
    cut = cut.withColumn("_strong", F.coalesce(F.col("_push") * v > 0, F.lit(False)))
    if chunk_rows is not None:
        rows = materialize(_states_in_chunk(cut, keys, STATES).drop("_push", "_strong"), "states")
        ends = rows.groupBy(*keys, "chunk").agg(
            *[F.max_by(f"_s{s}", "idx").alias(f"_m{s}") for s in STATES], F.max("_frozen").alias("_holed"))
        # Behind a chunk with a missing v nothing moves any more.
        earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_stuck", F.coalesce(F.max("_holed").over(earlier), F.lit(False)))
        ends = ends.withColumns({f"_m{s}": F.when(F.col("_stuck"), F.lit(s)).otherwise(F.col(f"_m{s}")) for s in STATES})
        rows = rows.join(_entered_with(ends, keys), [*keys, "chunk"])
        sig = F.when(F.col("_stuck"), F.col("_came")).otherwise(
            F.when(F.col("_came") == 1, F.col("_s1")).when(F.col("_came") == -1, F.col("_s-1")).otherwise(F.col("_s0")))
        dead = F.col("_stuck") | F.col("_frozen")
    else:
        rows = _states_in_chunk(cut, keys, (0,))
        sig, dead = F.col("_s0"), F.col("_frozen")
    short = F.col("n") < span
    blank = lambda c: F.when(~short & ~dead, F.col(c))
    return rows.withColumns({
        "sig": F.when(~short, sig).cast("int"), "mu": blank("mu"), "sigma": blank("sigma"), "eps": blank("eps"),
    }).drop("chunk", "core", "_blk", "_push", "_strong", "_frozen", "_came", "_stuck", *[f"_s{s}" for s in STATES])


def schmitt(df: DataFrame, span: int = 60, k_eps: float | str = 0.15, sigma_min: float | str = 0.05,
            keys: Sequence[str] = KEYS, chunk_rows: int | None = CHUNK_ROWS, decimals: int | None = None) -> DataFrame:
    """Adds ``mu``, ``sigma``, ``eps`` and ``sig`` to rows with ``v``, ``a``.

    Enter +1 when a > eps and v > 0, -1 when a < -eps and v < 0; leave to 0 on
    an opposite a beyond eps; missing values keep the state. A missing v also
    makes eps missing from there on. Series shorter than ``span`` get NULL.
    ``k_eps`` and ``sigma_min`` may name columns (parameter sweeps).
    ``decimals`` rounds a, v and eps before they are compared.
    """
    cut = with_blocks(chunked(df, ewma_reach(span), 0, chunk_rows), span)
    return trigger_chunks(cut, span, k_eps, sigma_min, keys, decimals, ewma_reach(span), chunk_rows)


def smooth_and_trigger(df: DataFrame, filter_id: str, params: dict | None = None, edge: str | None = None,
                       span: int = 60, k_eps: float | str = 0.15, sigma_min: float | str = 0.05,
                       keys: Sequence[str] = KEYS, x: str = "close", chunk_rows: int | None = CHUNK_ROWS,
                       decimals: int | None = None) -> DataFrame:
    """Filter, slopes and trigger behind one shuffle and one sort: the halo
    covers the filter, both differences and the memory of the volatility."""
    finer = None if decimals is None else decimals + 3
    if not chunk_filter(filter_id):
        rows = smooth_and_derive(df, filter_id, params, x, keys, edge, decimals, chunk_rows)
        return schmitt(rows, span, k_eps, sigma_min, keys, chunk_rows, finer)
    before, after, mirror = filter_reach(filter_id, params, edge)
    reach = before + 2 + ewma_reach(span)
    cut = chunked(df, reach, after + 2, chunk_rows, mirror)
    cut = smooth_chunks(with_blocks(cut, span), filter_id, params, x, keys, edge, decimals, block_window(keys))
    return trigger_chunks(cut, span, k_eps, sigma_min, keys, finer, reach, chunk_rows)


def state_duration(df: DataFrame, keys: Sequence[str] = KEYS, sig: str = "sig", out: str = "dur",
                   chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Rows since the state last changed, counting from 1."""
    cut = chunked(df, 1, 0, chunk_rows)
    turned = (F.col("idx") == 0) | (F.lag(sig).over(in_chunk(keys)) != F.col(sig))
    marked = core_rows(cut.withColumn("_turn", F.when(turned, F.col("idx"))))
    found = scan(marked, keys, chunk_of(chunk_rows=chunk_rows), ["idx"], {"_since": ("last", F.col("_turn"), False)})
    return found.withColumn(out, F.when(F.col(sig).isNotNull(), F.col("idx") - F.col("_since") + 1).cast("int")).drop(
        "_turn", "_since")


def runs(df: DataFrame, keys: Sequence[str] = KEYS, sig: str = "sig", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Non-zero stretches of equal signal: start, end, value."""
    cut = chunked(df.select(*keys, "idx", "n", sig), 1, 0, chunk_rows)
    turned = (F.col("idx") == 0) | (F.lag(sig).over(in_chunk(keys)) != F.col(sig))
    marked = core_rows(cut.withColumn("_turn", F.when(turned, F.col("idx"))))
    found = scan(marked, keys, chunk_of(chunk_rows=chunk_rows), ["idx"], {"_since": ("last", F.col("_turn"), False)})
    return (
        found.where(F.col(sig) != 0)
        .groupBy(*keys, F.col("_since").alias("start_idx"))
        .agg(F.max("idx").alias("end_idx"), F.first(sig).alias("value"))
    )


def pair_starts(df: DataFrame, keys: Sequence[str] = KEYS, sig: str = "sig",
                chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Rows where a signal opposite to the last non-zero one appears (or the
    first one): zeros between equal signs do not end a stretch."""
    live = df.where(F.col(sig) != 0)
    seen = scan(live, keys, chunk_of(chunk_rows=chunk_rows), ["idx"], {"_prev": ("last", F.col(sig), True)})
    return seen.where(F.col("_prev").isNull() | (F.col("_prev") != F.col(sig))).drop("_prev")


def find_pairs(df: DataFrame, keys: Sequence[str] = KEYS, sig: str = "sig", x: str | None = None,
               chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """(start, end) of every stretch up to the entry of the opposite one. With
    ``x`` the value at the end is kept as ``y_end``."""
    from tidebars.sources.storage import materialize

    keys, value = list(keys), [x] if x else []
    starts = pair_starts(df, keys, sig, chunk_rows).where("n >= 3").select(*keys, "idx", "n", sig, *value)
    if chunk_rows is not None:
        starts = materialize(starts, "starts")
    part = chunk_of(chunk_rows=chunk_rows)
    here = F.struct(F.col("idx").alias("end_idx"), F.col(sig).alias("v2"), *[F.col(x).alias("y_end") for x in value])
    numbered = scan(starts, keys, part, ["idx"], {"pair_id": ("sum", F.lit(1), True)})
    closed = scan(numbered, keys, part, ["idx"], {"_next": ("last", here, True)}, reverse=True)
    return closed.where("_next is not null").select(
        *keys, F.col("pair_id").cast("int").alias("pair_id"), F.col("idx").alias("start_idx"), "_next.end_idx",
        F.col(sig).alias("v1"), "_next.v2", *["_next.y_end" for _ in value], "n")

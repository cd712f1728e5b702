"""Series filters. Every filter maps a column of an indexed series (``idx``,
``n``) to a new column of the same length.

``edge`` chooses what happens where the window leaves the series: ``zero`` pads
with zeros, ``nan`` gives NULL, ``causal`` (ALMA) repeats the first value and
looks back only. Without ``edge`` every filter uses its own default.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.functions import taps as K
from tidebars.functions.recurrence import Recurrence, second_order
from tidebars.functions.scalars import known
from tidebars.operators.lowess import lowess
from tidebars.operators.series import CHUNK_ROWS, chunk_of, chunked, core_rows, in_chunk, scan
from tidebars.schema import KEYS
from tidebars.sources.storage import materialize


@dataclass(frozen=True)
class FilterSpec:
    """``kind`` says what ``build`` gets: ``window`` (cut, x, out, params, w,
    edge) adds a column over the chunk window ``w``, ``frame`` (cut, keys, x,
    out, params, edge) does so with windows of its own, ``grouped`` (params)
    returns a function of the arrays of one chunk (idx, n, x), ``table`` (df,
    keys, x, out, params, edge) takes the uncut frame. ``reach`` gives the rows
    needed before, after and mirrored beyond the ends. Missing values reach a
    grouped function as NaN and go out as such."""

    filter_id: str
    name: str
    kind: str
    build: Callable
    reach: Callable
    params: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)


REGISTRY: dict[str, FilterSpec] = {}


def register_filter(spec: FilterSpec) -> FilterSpec:
    REGISTRY[spec.filter_id] = spec
    return spec


def defaults(filter_id: str) -> dict[str, float]:
    return {k: v[3] for k, v in REGISTRY[filter_id].params.items()}


def _repaired(filter_id: str, params: dict | None) -> dict:
    p = {**defaults(filter_id), **(params or {})}
    if "window" in p and not p.get("keep_even"):
        p["window"] = K.odd(p["window"])
    if filter_id == "savgol":
        p["order"] = int(min(p["order"], p["window"] - 1))
    if filter_id == "butterworth":
        p["order"] = int(p["order"])
        p["cutoff"] = 0.495 if p["cutoff"] >= 0.5 else p["cutoff"]
    return p


# --- finite windows -------------------------------------------------------

def tap_sum(x: Column | str, taps: dict[int, float], w, pad: float | None) -> Column:
    """Weighted sum over row offsets, always added from the oldest offset to
    the newest so that the result is reproducible to the last bit."""
    total = None
    for o in sorted(taps):
        at = F.col(x) if o == 0 and isinstance(x, str) else (
            F.lag(x, -o, pad).over(w) if o <= 0 else F.lead(x, o, pad).over(w))
        term = at * F.lit(taps[o])
        total = term if total is None else total + term
    return total


# A window value that an expression needs twice goes into a column of its own:
# written twice, it would be computed twice.


def _sma(cut, x, out, p, w, edge):
    width = int(p["window"])
    ahead = (width - 1) // 2
    # one aggregate per row: a missing value makes the sum NaN
    total = F.sum(F.coalesce(F.col(x), F.lit(float("nan")))).over(w.rowsBetween(ahead - width + 1, ahead))
    cut = cut.withColumn(out, total / F.lit(float(width)))
    if edge == "zero":
        return cut.withColumn(out, known(out))
    inside = (F.col("idx") + ahead - width + 1 >= 0) & (F.col("idx") + ahead < F.col("n"))
    return cut.withColumn(out, F.when(inside, known(out)))


def _padded_taps(table: Callable):
    def build(cut, x, out, p, w, edge):
        return cut.withColumn(out, tap_sum(x, table(p), w, 0.0 if edge == "zero" else None))

    return build


def _wma_table(p):
    return K.linear_taps(int(p["window"]), newest=p.get("direction") == "newest")


def _alma(cut, x, out, p, w, edge):
    if edge != "causal":
        taps = K.alma_taps(int(p["window"]), p["offset"], p["sigma"])
        return cut.withColumn(out, tap_sum(x, taps, w, 0.0 if edge == "zero" else None))
    taps = K.alma_taps(int(p["window"]), p["offset"], p["sigma"], causal=True)
    cut = cut.withColumn("_lead", F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = None
    for o in sorted(taps):
        at = F.when(F.col("idx") + o >= 0, F.lag(x, -o).over(w)).otherwise(F.col("_lead"))
        term = at * F.lit(taps[o])
        total = term if total is None else total + term
    return cut.withColumn(out, total).drop("_lead")


def _gaussian_radius(p, edge):
    return math.ceil(3 * p["sigma"]) if edge == "nan" else int(4.0 * p["sigma"] + 0.5)


def _gaussian(cut, x, out, p, w, edge):
    return cut.withColumn(out, tap_sum(x, K.gaussian_taps(p["sigma"], _gaussian_radius(p, edge)), w, None))


def _dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _savgol(cut, x, out, p, w, edge):
    width, h = int(p["window"]), int(p["window"]) // 2
    hat = K.savgol_matrix(width, int(p["order"]))
    middle = tap_sum(x, {o: float(hat[h, o + h]) for o in range(-h, h + 1)}, w, None)
    if edge == "nan":
        return cut.withColumn(out, middle)
    # End rows evaluate the polynomial through the first or last whole window.
    # Only chunks that hold an end of the series collect anything.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.struct("idx", F.coalesce(F.col(x), F.lit(float("nan"))).alias("v"))
    from_end = F.col("n") - F.col("idx")
    cut = cut.withColumns({
        out: middle,
        "_head": F.collect_list(F.when(F.col("idx") < width, value)).over(whole),
        "_tail": F.collect_list(F.when(from_end <= width, value)).over(whole),
    })

    def end_value(kept: str, row: Column) -> Column:
        values = F.transform(F.array_sort(kept), lambda s: s["v"])
        return _dot(values, F.get(F.lit(hat.tolist()), row.cast("int")))

    edge_value = F.when(F.col("idx") < h, end_value("_head", F.col("idx"))).when(
        from_end <= h, end_value("_tail", F.lit(width) - from_end)).otherwise(F.col(out))
    return cut.withColumn(out, F.when(F.col("n") >= width, edge_value)).withColumn(out, known(out)).drop("_head", "_tail")


def _median(cut, x, out, p, w, edge):
    width, h = int(p["window"]), int(p["window"]) // 2
    frame = w.rowsBetween(-h, h)
    cut = cut.withColumn("_seen", F.collect_list(F.coalesce(F.col(x), F.lit(float("nan")))).over(frame))
    full = F.concat("_seen", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("_seen")))
    middle = F.element_at(F.array_sort(full), h + 1)
    if edge != "zero":
        middle = F.when(F.size("_seen") == width, middle)
    return cut.withColumn(out, middle).withColumn(out, known(out)).drop("_seen")


# --- recursions -----------------------------------------------------------

# A block of a recursion ends when its rows have lost so many powers of e.
BLOCK_DECAY = 40 * math.log(10.0)


def affine_scan(cut: DataFrame, keys: Sequence[str], a: Column, b: Column, out: str, factor: str | None = None) -> DataFrame:
    """y = a * y_before + b along each chunk, without leaving the JVM.

    Rows with ``b`` NULL repeat the last y. Rows are cut into blocks by how much
    decay has added up, whatever a single row loses: inside a block the solution is a
    running sum scaled by the running product of ``a``, counted from the block's
    first row, so it neither overflows nor vanishes; and only the block before the
    current one still contributes. ``factor`` names a column for the product of all
    ``a`` of the chunk so far.
    """
    w = in_chunk(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumns({"_b": b, "_la": F.when(b.isNotNull(), -F.ln(F.greatest(a, F.lit(1e-300))))})
    cut = cut.withColumn("_cum", F.sum("_la").over(w))
    cut = cut.withColumn("_blk", F.floor(F.col("_cum") / F.lit(BLOCK_DECAY)))
    # blocks follow the index, so these orders need no second sort
    run = Window.partitionBy(*keys, "chunk", "_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys, "chunk").orderBy("_blk", "idx")
    first = F.first("_cum", ignorenulls=True).over(run)
    cut = cut.withColumns({"_s": F.col("_cum") - first, "_lead": F.first(F.when(F.col("_b").isNotNull(), F.col("_la")), ignorenulls=True).over(run)})
    cut = cut.withColumn("_y", F.exp(-F.col("_s")) * F.sum(F.col("_b") * F.exp("_s")).over(run))
    # the end value of the block before: last row whose successor opens a block
    cut = cut.withColumn("_end", F.when(F.lead("_blk").over(across) != F.col("_blk"), F.col("_y")))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.exp(-F.col("_s") - F.col("_lead")) * F.coalesce(F.last("_end", ignorenulls=True).over(before), F.lit(0.0))
    cut = cut.withColumn(out, F.when(F.col("_blk") >= 0, F.col("_y") + carried))
    if factor:
        cut = cut.withColumn(factor, F.exp(-F.coalesce("_cum", F.lit(0.0))))
    return cut.drop("_b", "_la", "_cum", "_blk", "_s", "_lead", "_y", "_end")


def decay_rows(keep: float) -> int:
    """Rows over which a factor ``keep`` per row loses 40 decades."""
    return 1 if keep <= 0.0 else max(1, int(40 / -math.log10(keep)))


def smoothing_factor(p: dict) -> float:
    return float(p["alpha"]) if "alpha" in p else 2.0 / (float(p["span"]) + 1.0)


def _ema_step(gap: Column, value: Column, alpha: float) -> tuple[Column, Column]:
    """Factor and addend of the mean: across missing rows the old mean loses weight per
    row, as the unadjusted pandas ``ewm`` does; without an earlier value it starts."""
    keep = 1.0 - alpha
    old = F.pow(F.lit(keep), gap)
    share = old + F.lit(alpha)
    next_row = gap == 1
    a = F.when(gap.isNull(), 1.0).when(next_row, keep).otherwise(old / share)
    b = F.when(gap.isNull(), 1.0).when(next_row, alpha).otherwise(F.lit(alpha) / share) * value
    return a, b


def ema_scan(cut: DataFrame, keys: Sequence[str], x: str, out: str, alpha: float) -> DataFrame:
    """Exponential mean along each chunk, started at the chunk's first value: for chunks
    whose halo holds enough values before them. ``ema_series`` needs no halo."""
    w = in_chunk(keys)
    value = known(x)
    if alpha >= 1.0:
        return cut.withColumn(out, F.last(value, ignorenulls=True).over(w))
    last_seen = F.last(F.when(value.isNotNull(), F.col("idx")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("_gap", F.col("idx") - last_seen)
    a, b = _ema_step(F.col("_gap"), value, alpha)
    return affine_scan(cut, keys, a, b, out).drop("_gap")


def _ema_chunk(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean along a chunk that starts with its first value, and the share that what
    came before this value keeps. Missing rows repeat the last mean."""
    at = np.flatnonzero(~np.isnan(x))
    mean, share = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if not len(at):
        return mean, share
    gap, keep = np.diff(at, prepend=at[0] - 1), 1.0 - alpha
    old = keep ** gap.astype(float)
    total = np.where(gap == 1, 1.0, old + alpha)
    a, b = np.where(gap == 1, keep, old / total), alpha / total * x[at]
    a[0], b[0] = 1.0, x[at[0]]
    left = np.exp(np.cumsum(np.log(np.maximum(a, 1e-300))))
    a[0], step = 0.0, 1
    while step < len(a) and a.any():  # steps are joined in pairs, pairs of pairs and so on
        a, b = np.r_[a[:step], a[step:] * a[:-step]], np.r_[b[:step], b[step:] + a[step:] * b[:-step]]
        step *= 2
    last = np.searchsorted(at, np.arange(len(x)), side="right") - 1
    seen = last >= 0
    mean[seen], share[seen] = b[last[seen]], left[last[seen]]
    return mean, share


def _ema_carry(ends: pa.Table, keys: Sequence[str], alpha: float) -> pa.Table:
    """Per chunk of a series the mean it is entered with, and by how much its first value's
    mean differs from the value. One short step per chunk."""
    ends, keep = ends.sort_by("chunk"), 1.0 - alpha
    entered, more, mean, upto = [], [], None, None
    for r in ends.select(["_from", "_upto", "_value0", "_mean", "_kept"]).to_pylist():
        entered.append(mean)
        more.append(None)
        if r["_from"] is None:
            continue
        moved = 0.0
        if mean is not None:
            gap = r["_from"] - upto
            old = keep ** gap
            a, b = (keep, alpha) if gap == 1 else (old / (old + alpha), alpha / (old + alpha))
            moved = a * mean + (b - 1.0) * r["_value0"]
        more[-1], mean, upto = moved, r["_mean"] + r["_kept"] * moved, r["_upto"]
    out = ends.select([*keys, "chunk"])
    return out.append_column("_in", pa.array(entered, pa.float64())).append_column("_more", pa.array(more, pa.float64()))


def ema_series(df: DataFrame, keys: Sequence[str], x: str, out: str, alpha: float, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Exponential mean of whole series, however many rows are missing and whatever
    ``alpha`` is. Each chunk starts with its own first value; its ends are one row, and a walk
    over these rows gives what each chunk should have started from."""
    keys = list(keys)
    value = known(x)
    if alpha >= 1.0:
        return scan(df, keys, chunk_of(chunk_rows=chunk_rows), ["idx"], {out: ("last", value, False)})
    cut = chunked(df, 0, 0, chunk_rows).drop("core")
    solved = per_chunk(cut, keys, x, ["_own", "_share"], lambda idx, n, values: _ema_chunk(values, alpha))
    if chunk_rows is None:
        return solved.withColumn(out, F.col("_own")).drop("_own", "_share", "chunk")
    solved = materialize(solved, "means")
    seen = F.when(value.isNotNull(), F.col("idx"))
    ends = solved.groupBy(*keys, "chunk").agg(
        F.min(seen).alias("_from"), F.max(seen).alias("_upto"), F.min_by(value, seen).alias("_value0"), F.max_by("_own", seen).alias("_mean"), F.max_by("_share", seen).alias("_kept"))
    carry = ends.groupBy(*keys).applyInArrow(
        lambda t: _ema_carry(t, keys, alpha), T.StructType([*[ends.schema[k] for k in [*keys, "chunk"]], *[T.StructField(c, T.DoubleType()) for c in ("_in", "_more")]]))
    moved = F.coalesce(F.col("_own") + F.col("_share") * F.coalesce("_more", F.lit(0.0)), F.col("_in"))
    return solved.join(carry, [*keys, "chunk"]).withColumn(out, moved).drop("_own", "_share", "_in", "_more", "chunk")


def _ema(cut, keys, x, out, p, edge):
    return ema_scan(cut, keys, x, out, smoothing_factor(p))


@lru_cache(64)
def _tracker(q: float, r: float, dt: float, model: str) -> Recurrence:
    gains = K.kalman_gains(q, r, dt, model)[0]
    ahead = np.array([[1.0, dt], [0.0, 1.0]])
    return Recurrence(ahead - gains[:, :, None] * ahead[0], gains)


def _kalman(p):
    model = p.get("model", "piecewise")
    settings = float(p["Q"]), float(p["R"]), float(p.get("dt", 1.0)), model
    # all but the first model hand the first value out as it is
    late = 0 if model == "piecewise" else 1

    def run(idx: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
        y, step = np.full(len(x), np.nan), int(idx[0]) - late
        seen = int(np.isnan(x).argmax()) if np.isnan(x).any() else len(x)
        skip = 1 if step < 0 else 0
        y[:min(skip, seen)] = x[:min(skip, seen)]
        if seen > skip:
            y[skip:seen] = _tracker(*settings).solve(x[skip:seen], (float(x[0]), 0.0), step + skip)
        return y

    return run


def _kalman_reach(p, edge):
    gains, radius = K.kalman_gains(float(p["Q"]), float(p["R"]), float(p.get("dt", 1.0)), p.get("model", "piecewise"))
    return len(gains) + K.settle(radius), 0, 0


def _sections(p):
    return K.butterworth_sections(int(p["order"]), float(p["cutoff"]) / 0.5)


@lru_cache(256)
def _section(a1: float, a2: float) -> Recurrence:
    return second_order(np.array([a1]), np.array([a2]))


def _run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cascade in one direction, started in the steady state of x[0]."""
    for b0, b1, b2, a1, a2 in sections.tolist():
        # every section has unit gain at zero, so the level x[0] passes through
        level = float(x[0])
        before = np.concatenate([[level, level], x])
        x = _section(a1, a2).solve(b0 * x + b1 * before[1:-1] + b2 * before[:-2], (level, level))
    return x


def butterworth_pad(order: int) -> int:
    """Odd extension at both ends: three times the taps of the cascade."""
    sections = (order + 1) // 2
    return 3 * (2 * sections + 1 - (order % 2))


def _butterworth(p):
    sections, pad = _sections(p), butterworth_pad(int(p["order"]))

    def run(idx: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
        if n <= pad or np.isnan(x).any():
            return np.full(len(x), np.nan)
        left = 2 * x[0] - x[pad:0:-1] if idx[0] == 0 else x[:0]
        right = 2 * x[-1] - x[-2:-pad - 2:-1] if idx[-1] == n - 1 else x[:0]
        whole = _run_sections(sections, np.concatenate([left, x, right]))
        whole = _run_sections(sections, whole[::-1])[::-1]
        return whole[len(left):len(left) + len(x)]

    return run


def _butterworth_reach(p, edge):
    rows = K.settle(K.section_radius(_sections(p)), 1e-15) + butterworth_pad(int(p["order"]))
    return rows, rows, 0


def _half(p, edge):
    h = int(p["window"]) // 2
    return h, h, 0


def _gaussian_reach(p, edge):
    r = _gaussian_radius(p, edge)
    return r, r, 0 if edge == "nan" else r


def _ema_reach(p, edge):
    return K.settle(1.0 - smoothing_factor(p)), 0, 0


# Fixed values: (smallest, largest, step, default) of every parameter.
for _spec in [
    FilterSpec("sma", "Simple moving average", "window", _sma, _half, {"window": (3, 101, 2, 11)}),
    FilterSpec("ema", "Exponential moving average", "frame", _ema, _ema_reach, {"span": (2, 100, 1, 10)}),
    FilterSpec("wma", "Weighted moving average", "window", _padded_taps(_wma_table), _half, {"window": (3, 101, 2, 11)}),
    FilterSpec("alma", "Arnaud Legoux moving average", "window", _alma,
               lambda p, edge: (int(p["window"]) - 1, int(p["window"]) - 1, 0),
               {"window": (3, 101, 2, 21), "offset": (0.0, 1.0, 0.01, 0.85), "sigma": (1.0, 20.0, 0.1, 6.0)}),
    FilterSpec("savgol", "Savitzky-Golay", "window", _savgol,
               lambda p, edge: (int(p["window"]), int(p["window"]), 0),
               {"window": (5, 101, 2, 21), "order": (1, 5, 1, 2)}),
    FilterSpec("kalman", "Kalman, constant velocity", "grouped", _kalman, _kalman_reach,
               {"Q": (0.001, 1.0, 0.001, 0.01), "R": (0.01, 10.0, 0.01, 1.0)}),
    FilterSpec("butterworth", "Butterworth, zero phase", "grouped", _butterworth, _butterworth_reach,
               {"order": (1, 8, 1, 4), "cutoff": (1.0, 45.0, 0.5, 10.0)}),
    FilterSpec("gaussian", "Gaussian", "window", _gaussian, _gaussian_reach, {"sigma": (0.5, 20.0, 0.1, 3.0)}),
    FilterSpec("median", "Median", "window", _median, _half, {"window": (3, 101, 2, 5)}),
    FilterSpec("lowess", "LOWESS", "table", lowess, lambda p, edge: (0, 0, 0), {"frac": (0.01, 0.5, 0.01, 0.1)}),
]:
    register_filter(_spec)


# What a missing value takes away, at every length of a series: all of it, or the rest.
_ENDED_BY_HOLES = {"kalman": "rest", "butterworth": "whole"}


def filter_reach(filter_id: str, params: dict | None = None, edge: str | None = None) -> tuple[int, int, int]:
    spec = REGISTRY[filter_id]
    return spec.reach(_repaired(filter_id, params), edge or "zero")


def per_chunk(cut: DataFrame, keys: Sequence[str], x: str, out: str | Sequence[str], run: Callable) -> DataFrame:
    """A column (or several) that ``run`` computes from the arrays (idx, n, x) of each chunk."""
    names = [out] if isinstance(out, str) else list(out)
    schema = T.StructType([*cut.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])

    def each(rows: pa.Table) -> pa.Table:
        idx = rows.column("idx").to_numpy()
        if (idx[1:] < idx[:-1]).any():
            rows = rows.take(pa.array(np.argsort(idx, kind="stable")))
            idx = rows.column("idx").to_numpy()
        found = run(idx, rows.column("n")[0].as_py(), rows.column(x).to_numpy().astype(float))
        for name, y in zip(names, [found] if isinstance(out, str) else found, strict=True):
            rows = rows.append_column(name, pa.array(y, pa.float64(), from_pandas=True))
        return rows

    return cut.groupBy(*keys, "chunk").applyInArrow(each, schema)


def filter_chunks(cut: DataFrame, filter_id: str, params: dict | None = None, x: str = "close",
                  out: str = "filtered", keys: Sequence[str] = KEYS, edge: str | None = None, w=None) -> DataFrame:
    """Apply a filter to a frame that is already cut with enough halo. ``w``
    replaces the chunk window by one with the same row order."""
    spec, p, edge = REGISTRY[filter_id], _repaired(filter_id, params), edge or "zero"
    if spec.kind == "window":
        return spec.build(cut, x, out, p, w or in_chunk(keys), edge)
    if spec.kind == "frame":
        return spec.build(cut, keys, x, out, p, edge)
    return per_chunk(cut, keys, x, out, spec.build(p))


def apply_filter(df: DataFrame, filter_id: str, params: dict | None = None, x: str = "close",
                 out: str = "filtered", keys: Sequence[str] = KEYS, edge: str | None = None,
                 chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Filter column ``x`` of every series. An unknown id gives NULLs."""
    spec = REGISTRY.get(filter_id)
    if spec is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    if spec.kind == "table":
        return spec.build(df, keys, x, out, _repaired(filter_id, params), edge or "zero")
    if filter_id == "ema":
        return ema_series(df, keys, x, out, smoothing_factor(_repaired(filter_id, params)), chunk_rows)
    before, after, mirror = filter_reach(filter_id, params, edge)
    cut = chunked(df, before, after, chunk_rows, mirror)
    done = core_rows(filter_chunks(cut, filter_id, params, x, out, keys, edge))
    return _ended(done, df, {out: filter_id}, x, keys)


def _ended(done: DataFrame, df: DataFrame, filters: dict[str, str], x: str, keys: Sequence[str]) -> DataFrame:
    """Columns (by filter id) that a missing value ends, emptied from there on."""
    ended = {out: _ENDED_BY_HOLES[f] for out, f in filters.items() if f in _ENDED_BY_HOLES}
    if not ended:
        return done
    holes = df.where(known(x).isNull()).groupBy(*keys).agg(F.min("idx").alias("_hole"))
    whole = F.col("_hole").isNull()
    good = {"whole": whole, "rest": whole | (F.col("idx") < F.col("_hole"))}
    return done.join(holes, list(keys), "left").withColumns({out: F.when(good[how], F.col(out)) for out, how in ended.items()}).drop("_hole")


def filter_all(df: DataFrame, filters: Sequence[tuple], x: str = "close", keys: Sequence[str] = KEYS,
               chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Several filters of one column, each (name, filter id, params) or with an edge as
    fourth, as columns called by name. Those that need no more than a halo share one cut of
    the rows, however many they are; LOWESS, the exponential mean and reflected ends have
    layouts of their own and go first."""
    named = [(*f, None)[:4] for f in filters]
    own = [f for f in named if f[1] in REGISTRY and (REGISTRY[f[1]].kind == "table" or f[1] == "ema" or filter_reach(*f[1:])[2])]
    for name, filter_id, params, edge in own:
        df = materialize(apply_filter(df, filter_id, params, x, name, keys, edge, chunk_rows), "filtered")
    shared = [f for f in named if f not in own]
    known_ones = [f for f in shared if f[1] in REGISTRY]
    reach = [filter_reach(*f[1:]) for f in known_ones] or [(0, 0, 0)]
    cut = chunked(df, max(r[0] for r in reach), max(r[1] for r in reach), chunk_rows)
    for name, filter_id, params, edge in shared:
        cut = filter_chunks(cut, filter_id, params, x, name, keys, edge) if filter_id in REGISTRY else cut.withColumn(name, F.lit(None).cast("double"))
    return _ended(core_rows(cut), df, {f[0]: f[1] for f in known_ones}, x, keys)


def dual_filter(df: DataFrame, first: tuple[str, dict], second: tuple[str, dict], **kw) -> DataFrame:
    """Two filters of the same input; the second one is for display only."""
    df = apply_filter(df, first[0], first[1], out="filtered", **kw)
    return apply_filter(df, second[0], second[1], out="filtered2", **kw)

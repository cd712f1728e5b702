"""Whole analyses: one job over all series, timeframes and parameter sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators import align, backtest, fits, metrics, signals
from tidebars.operators.derive import smooth_and_derive
from tidebars.operators.extensions import walk_forward, window_rows
from tidebars.operators.filters import filter_all
from tidebars.operators.series import CHUNK_ROWS, chunk_limit, with_index
from tidebars.schema import KEYS
from tidebars.sources.bars import valid_close
from tidebars.sources.params import cross_params
from tidebars.sources.storage import materialize


# Window operators copy whole rows, so only these columns go through them.
NEEDED = ("ts", "close")


@dataclass(frozen=True)
class Settings:
    filter_id: str = "savgol"
    filter_params: dict = field(default_factory=dict)
    edge: str | None = None
    span: int = 60
    k_eps: float | str = 0.15
    sigma_min: float | str = 0.05
    fit_mode: str = "parabola"
    n_ext: int | str = 8
    stop_loss_pct: float | str = 2.0
    decimals: int | None = None
    chunk_rows: int | None = CHUNK_ROWS


@dataclass(frozen=True)
class Analysis:
    signal: DataFrame
    pairs: DataFrame
    fits: DataFrame
    trades: DataFrame
    equity: DataFrame
    summary: DataFrame


def signal_rows(indexed: DataFrame, s: Settings, keys: Sequence[str] = KEYS, x: str = "close") -> DataFrame:
    """Filter, slopes and trigger of every series."""
    return signals.smooth_and_trigger(indexed, s.filter_id, s.filter_params, s.edge, s.span, s.k_eps, s.sigma_min,
                                      keys, x, s.chunk_rows, s.decimals)


def trade(signal: DataFrame, s: Settings, keys: Sequence[str] = KEYS, sets: DataFrame | None = None) -> Analysis:
    """Pairs to summary. ``signal`` is read several times, so hand in a stored
    table. ``sets`` (param_id and the columns that ``s`` names) gives stops and
    horizons that differ by parameter set; it must be small."""
    pairs = materialize(signals.find_pairs(signal, keys, x="filtered", chunk_rows=s.chunk_rows), "pairs")
    rows = fits.segment_rows(signal, pairs, keys, chunk_rows=s.chunk_rows)
    # pairs, fits and entries are read again by the exits, trades and curves
    fit = materialize(fits.fit_pairs(rows, s.fit_mode, keys), "fits")
    aimed = pairs if sets is None else pairs.join(F.broadcast(sets), "param_id")
    entered = materialize(backtest.entries(aimed, fit, s.n_ext, keys), "entries")
    exits = backtest.first_exit(entered, signal, s.stop_loss_pct, s.n_ext, keys, chunk_rows=s.chunk_rows)
    exits = materialize(exits, "exits") if s.chunk_rows is not None else exits
    trades = materialize(backtest.make_trades(exits, keys, chunk_rows=s.chunk_rows), "trades")
    curves = backtest.equity(signal, trades, keys, chunk_rows=s.chunk_rows)
    return Analysis(signal, pairs, fit, trades, curves, backtest.summary(trades, curves, keys, s.chunk_rows))


def analyse(bars: DataFrame, s: Settings = Settings(), keys: Sequence[str] = KEYS) -> Analysis:
    """``bars`` should be a stored table. Whether any series needs more than one
    chunk is looked up once; if none does, nothing is carried between chunks."""
    indexed = materialize(with_index(valid_close(bars).select(*keys, *NEEDED), keys), "indexed")
    s = replace(s, chunk_rows=chunk_limit(indexed, s.chunk_rows))
    return trade(materialize(signal_rows(indexed, s, keys), "signal"), s, keys)


def run_all(bars: DataFrame, settings: dict[str, Settings] | None = None,
            default: Settings = Settings(), mode: str = "reference") -> tuple[Analysis, DataFrame]:
    """All timeframes at once, each with its settings (at most eight), and the
    curves of the next higher timeframe on every bar. No order of timeframes is
    needed: alignment joins the finished curves through the hierarchy."""
    settings = settings or {}
    groups: dict[int, tuple[Settings, list[str]]] = {}
    distinct: list[Settings] = []
    for tf, s in settings.items():
        at = next((i for i, d in enumerate(distinct) if d == s), None)
        if at is None:
            at = len(distinct)
            distinct.append(s)
        groups.setdefault(at, (s, []))[1].append(tf)
    parts = [analyse(bars.where(F.col("timeframe").isin(tfs)), s) for s, tfs in groups.values()]
    rest = bars.where(~F.col("timeframe").isin(list(settings))) if settings else bars
    parts.append(analyse(rest, default))
    union = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    whole = Analysis(*[union(n) for n in ("signal", "pairs", "fits", "trades", "equity", "summary")])
    curves = materialize(whole.equity, "equity")
    whole = replace(whole, equity=curves)
    return whole, align.align_pnl(curves, curves, mode)


def sweep_summary(bars: DataFrame, sets: Sequence[dict], keys: Sequence[str] = KEYS,
                  base: Settings = Settings()) -> DataFrame:
    """One summary row per series and parameter set. ``sets``: dicts with
    ``param_id`` and any of the settings. Every different filter runs once per
    series, sets of one filter and span share a trigger plan with their
    thresholds as columns, and all sets go through the backtest together with
    stops and horizons as columns."""
    spark = bars.sparkSession
    rows = [replace(base, **{k: v for k, v in row.items() if k != "param_id"}) for row in sets]
    ids = [row["param_id"] for row in sets]
    indexed = materialize(with_index(valid_close(bars).select(*keys, *NEEDED), keys), "indexed")
    limit = chunk_limit(indexed, base.chunk_rows)
    wide_keys = [*keys, "param_id"]

    def grouped(key) -> list[list[int]]:
        groups: list[tuple[object, list[int]]] = []
        for i, s in enumerate(rows):
            match = next((g for g in groups if g[0] == key(s)), None)
            if match is None:
                match = (key(s), [])
                groups.append(match)
            match[1].append(i)
        return [g for _, g in groups]

    parts = []
    for members in grouped(lambda s: (s.filter_id, s.filter_params, s.edge, s.decimals, s.span)):
        s = rows[members[0]]
        smooth = smooth_and_derive(indexed, s.filter_id, s.filter_params, "close", keys, s.edge, s.decimals, limit)
        params = spark.createDataFrame([(ids[i], float(rows[i].k_eps), float(rows[i].sigma_min)) for i in members],
                                       ["param_id", "k_eps", "sigma_min"])
        finer = None if s.decimals is None else s.decimals + 3
        parts.append(signals.schmitt(cross_params(smooth, params), s.span, "k_eps", "sigma_min", wide_keys, limit, finer))
    signal = materialize(reduce(DataFrame.unionByName, parts), "sweep")
    out = []
    for members in grouped(lambda s: s.fit_mode):
        exits = spark.createDataFrame([(ids[i], float(rows[i].stop_loss_pct), int(rows[i].n_ext)) for i in members],
                                      ["param_id", "stop_loss_pct", "n_ext"])
        s = replace(rows[members[0]], stop_loss_pct="stop_loss_pct", n_ext="n_ext", chunk_rows=limit)
        mine = signal.join(F.broadcast(exits.select("param_id")), "param_id", "left_semi")
        out.append(trade(mine, s, wide_keys, exits).summary)
    return reduce(DataFrame.unionByName, out)


def walk_forward_test(bars: DataFrame, sets: Sequence[dict], keys: Sequence[str] = KEYS, base: Settings = Settings(),
                      train: int = 6, test: int = 3, step: int = 1, score: str = "total_return") -> DataFrame:
    """Per series and walk-forward window the parameter set with the best ``score`` on the
    train part (ties: the smaller ``param_id``) and what it makes of the test part:
    ``train_start, param_id, train_score, test_score, test_trades``. Window and part are keys of
    a series, so one sweep analyses all windows; the test part starts anew on its first bar."""
    keys = list(keys)
    rows = valid_close(bars).select(*keys, *NEEDED)
    cut = window_rows(rows, walk_forward(rows, train, test, step, keys), keys)
    wide = [*keys, "train_start", "part"]
    done = materialize(sweep_summary(materialize(cut.select(*wide, *NEEDED), "windows"), sets, wide, base), "window_results")
    best = done.where("part = 'train'").groupBy(*keys, "train_start").agg(
        F.max_by(F.struct("param_id", F.col(score).alias("train_score")), F.struct(F.round(score, 9), -F.col("param_id"))).alias("_b"))
    tested = done.where("part = 'test'").select(*keys, "train_start", "param_id", F.col(score).alias("test_score"), F.col("trades").alias("test_trades"))
    return best.select(*keys, "train_start", "_b.*").join(tested, [*keys, "train_start", "param_id"], "left")


def compare_filters(df: DataFrame, filters: Sequence[tuple], keys: Sequence[str] = KEYS, edge: str | None = None,
                    lags: bool = True, snr: str = "variance") -> DataFrame:
    """Every (name, filter id, params), or with an edge of its own as fourth, on every
    series of ``df`` (idx, n, clean, noisy): one row of metrics per (filter, series). All
    filters go through one pass (``filter_all``), and all metrics read its stored result, so
    the scans don't grow with the filters; a lag is a number per filter."""
    keys, named = list(keys), [(*f, edge)[:4] for f in filters]
    columns = [(f"_f{k}", *f[1:]) for k, f in enumerate(named)]
    wide = materialize(filter_all(df.select(*keys, "idx", "n", "clean", "noisy"), columns, "noisy", keys), "compared")
    each = F.explode(F.array(*[F.struct(F.lit(f[0]).alias("filter"), F.col(c[0]).alias("filtered")) for f, c in zip(named, columns, strict=True)]))
    rows = wide.select(*keys, "idx", "n", "clean", "noisy", each.alias("_e")).select(*keys, "idx", "n", "clean", "noisy", "_e.*")
    res = metrics.all_metrics(rows, [*keys, "filter"], snr)
    if lags:
        told = [(f[0], metrics.filter_lag(df.sparkSession, f[1], f[2])) for f in named]
        res = res.join(F.broadcast(df.sparkSession.createDataFrame(told, "filter string, lag double")), "filter")
    return res

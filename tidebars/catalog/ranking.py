"""Registered queries: metrics, rankings, sweeps, sample comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebars.catalog.base import (
    CAPITAL, EQUITY, HOURLY, PAIRS, ROWS, S, SEGMENTS, SERIES, SMOOTH, SUMMARY, TICKS, VERTEX, bars_sql, calendar_bars, derived_sql, filtered_sql, hourly, indexed,
    ORDER_TICKS, register, stored, table, ticks, trades_sql, trigger_sql, with_,
)
from tidebars.operators import extensions as E
from tidebars.operators import metrics as M
from tidebars.operators.derive import roughness
from tidebars.operators.filters import apply_filter
from tidebars.operators.series import with_index
from tidebars.plans.analysis import Settings, compare_filters, sweep_summary, walk_forward_test
from tidebars.sources.storage import scratch_root, write_ranking

K3 = ("ticker", "timeframe")

# Clean: mean of 21 rows, noisy: the close, filtered: mean of 5 rows.
TRIPLE = (*SERIES, """q AS (SELECT ticker, timeframe, idx, n, close AS noisy,
 round(sum(close) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / 21, 6) AS clean,
 round(sum(close) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS filtered FROM s)""")


def clean_noisy(spark, sf):
    c = apply_filter(indexed(spark, sf), "sma", {"window": 21}, out="clean")
    return c.select(*K3, "idx", "n", F.round("clean", 6).alias("clean"), F.col("close").alias("noisy"))


def triple(spark, sf):
    f = apply_filter(clean_noisy(spark, sf), "sma", {"window": 5}, x="noisy")
    return f.withColumn("filtered", F.round("filtered", 6))


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("error_metrics", with_(*TRIPLE) + """SELECT ticker, timeframe, round(avg(pow(filtered - clean, 2)), 6) AS mse, round(sqrt(avg(pow(filtered - clean, 2))), 6) AS rmse,
round(avg(abs(filtered - clean)), 6) AS mae, round(10 * log10(var_pop(noisy - clean) / var_pop(filtered - clean)), 6) AS snr_imp FROM q GROUP BY ALL""")
def error_metrics(spark, sf):
    return _r(M.error_metrics(triple(spark, sf)), "mse", "rmse", "mae", "snr_imp")


@register("snr_improvement_mse", with_(*TRIPLE) + """SELECT ticker, timeframe, round(10 * log10((avg(pow(clean - noisy, 2)) + 1e-15) / (avg(pow(clean - filtered, 2)) + 1e-15)), 6) AS snr_imp
FROM q GROUP BY ALL""")
def snr_improvement_mse(spark, sf):
    return _r(M.snr_improvement(triple(spark, sf), form="mse"), "snr_imp")


@register("input_snr", with_(*TRIPLE) + "SELECT ticker, timeframe, round(10 * log10(var_pop(clean) / (var_pop(noisy - clean) + 1e-15)), 6) AS snr_in FROM q GROUP BY ALL")
def input_snr(spark, sf):
    return _r(M.input_snr(triple(spark, sf)), "snr_in")


@register("xcorr_lag", with_(*TRIPLE, """ce AS (SELECT ticker, timeframe, idx, filtered - avg(filtered) OVER p AS f, noisy - avg(noisy) OVER p AS m FROM q
 WINDOW p AS (PARTITION BY ticker, timeframe)), cc AS (SELECT a.ticker, a.timeframe, a.idx - b.idx AS lag, sum(a.f * b.m) AS c
 FROM ce a JOIN ce b ON a.ticker = b.ticker AND a.timeframe = b.timeframe GROUP BY ALL)""") + """SELECT ticker, timeframe, lag::BIGINT AS lag FROM cc
QUALIFY row_number() OVER (PARTITION BY ticker, timeframe ORDER BY round(c, 9) DESC, lag) = 1""")
def xcorr_lag(spark, sf):
    return M.xcorr_lag(stored(triple(spark, sf)))


@register("edge_ratio", with_(*TRIPLE) + """SELECT ticker, timeframe, round(avg(abs(clean - filtered)) FILTER (idx < k OR idx >= n - k) / (avg(abs(clean - filtered)) FILTER (idx >= k AND idx < n - k) + 1e-15), 6) AS edge_ratio
FROM (SELECT *, greatest(1, floor(n * 0.05)) AS k FROM q) GROUP BY ALL""")
def edge_ratio(spark, sf):
    return _r(M.edge_ratio(triple(spark, sf)), "edge_ratio")


@register("impulse_lag_ema", with_(*SERIES) + """SELECT ticker, timeframe, round(sum(idx * w) / sum(w) - any_value(pos), 6) AS lag FROM (SELECT ticker, timeframe, idx, pos,
 CASE WHEN idx < pos THEN 0 ELSE (2.0::DOUBLE / 11) * pow(1 - 2.0::DOUBLE / 11, idx - pos) END AS w FROM (SELECT *, floor(n / 4)::BIGINT AS pos FROM s)) GROUP BY ALL""")
def impulse_lag_ema(spark, sf):
    return _r(M.impulse_lag(indexed(spark, sf), "ema", {"span": 10}), "lag")


@register("impulse_lag_sma", with_(*SERIES) + "SELECT DISTINCT ticker, timeframe, 5.0::DOUBLE AS lag FROM s")
def impulse_lag_sma(spark, sf):
    return M.impulse_lag(indexed(spark, sf), "sma", {"window": 11})


@register("minmax", """WITH a AS (SELECT p_type, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY 1)
SELECT p_type, round(1 - (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS price_norm,
round((size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()), 6) AS size_norm FROM a""")
def minmax(spark, sf):
    a = table(spark, sf, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    return _r(M.minmax(a, {"price": False, "size": True}).select("p_type", "price_norm", "size_norm"), "price_norm", "size_norm")


@register("freq_response", with_(*SERIES, """y AS (SELECT *, sum(close) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS f FROM s)""") + """
SELECT ticker, timeframe, b.bin::BIGINT AS bin, round(sqrt(pow(sum(f * cos(2 * pi() * ((idx * b.bin) % n) / n)), 2) + pow(sum(f * sin(2 * pi() * ((idx * b.bin) % n) / n)), 2))
 / (sqrt(pow(sum(close * cos(2 * pi() * ((idx * b.bin) % n) / n)), 2) + pow(sum(close * sin(2 * pi() * ((idx * b.bin) % n) / n)), 2)) + 1e-15), 5) AS response
FROM y JOIN range(10000) b(bin) ON b.bin <= n // 2 GROUP BY ticker, timeframe, b.bin""")
def freq_response(spark, sf):
    y = apply_filter(indexed(spark, sf), "sma", {"window": 5})
    return M.freq_response(y).select(*K3, "bin", F.round("response", 5).alias("response"))


# --- filters against each other -------------------------------------------

FILTERS = [("mean5", "sma", {"window": 5}), ("mean11", "sma", {"window": 11}), ("mean31", "sma", {"window": 31}), ("median5", "median", {"window": 5})]


def _filtered_union() -> str:
    mean = lambda w: f"sum(noisy) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) / {w}"
    med = """list_sort(list_concat(list(noisy) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
 list_resize([]::DOUBLE[], (5 - count(*) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))::BIGINT, 0.0)))[3]"""
    arms = [("mean5", mean(5), 2.0), ("mean11", mean(11), 5.0), ("mean31", mean(31), 15.0), ("median5", med, 2.0)]
    return " UNION ALL ".join(f"SELECT '{n}' AS filter, {lag}::DOUBLE AS lag, ticker, timeframe, idx, n, clean, noisy, {e} AS filtered FROM q" for n, e, lag in arms)


RESULTS = (*TRIPLE, f"u AS ({_filtered_union()})", """u2 AS (SELECT *, filtered - 2 * lag(filtered) OVER w + lag(filtered, 2) OVER w AS bend, greatest(1, floor(n * 0.05)) AS k FROM u
 WINDOW w AS (PARTITION BY filter, ticker, timeframe ORDER BY idx))""", """res AS (SELECT filter, ticker, timeframe, any_value(lag) AS lag, avg(pow(filtered - clean, 2)) AS mse, avg(abs(filtered - clean)) AS mae,
 10 * log10(var_pop(noisy - clean) / var_pop(filtered - clean)) AS snr_imp, sum(bend * bend) AS roughness,
 avg(abs(clean - filtered)) FILTER (idx < k OR idx >= n - k) / (avg(abs(clean - filtered)) FILTER (idx >= k AND idx < n - k) + 1e-15) AS edge_ratio
 FROM u2 GROUP BY filter, ticker, timeframe)""")


def compared(spark, sf):
    return compare_filters(stored(clean_noisy(spark, sf)), FILTERS)


@register("filter_metrics", with_(*RESULTS) + """SELECT filter, ticker, timeframe, lag, round(mse, 6) AS mse, round(mae, 6) AS mae, round(snr_imp, 6) AS snr_imp,
round(roughness, 3) AS roughness, round(edge_ratio, 6) AS edge_ratio FROM res""")
def filter_metrics(spark, sf):
    r = compared(spark, sf).select("filter", *K3, "lag", "mse", "mae", "snr_imp", F.round("roughness", 3).alias("roughness"), "edge_ratio")
    return _r(r, "mse", "mae", "snr_imp", "edge_ratio")


@register("rank_filters", with_(*RESULTS, """me AS (SELECT filter, avg(mse) AS mse, avg(snr_imp) AS snr_imp, avg(lag) AS lag, avg(roughness) AS roughness, avg(edge_ratio) AS edge_ratio FROM res GROUP BY filter)""",
                                """sc AS (SELECT *, ((1 - (mse - min(mse) OVER ()) / (max(mse) OVER () - min(mse) OVER ())) + (snr_imp - min(snr_imp) OVER ()) / (max(snr_imp) OVER () - min(snr_imp) OVER ())
 + (1 - (lag - min(lag) OVER ()) / (max(lag) OVER () - min(lag) OVER ())) + (1 - (roughness - min(roughness) OVER ()) / (max(roughness) OVER () - min(roughness) OVER ()))
 + (1 - (edge_ratio - min(edge_ratio) OVER ()) / (max(edge_ratio) OVER () - min(edge_ratio) OVER ()))) / 5 AS composite FROM me)""") + """
SELECT rank() OVER (ORDER BY composite DESC) AS rank, filter, round(mse, 6) AS mse, round(composite, 6) AS composite FROM sc""")
def rank_filters(spark, sf):
    r = M.rank_filters(compared(spark, sf))
    return _r(r.select(F.col("rank").cast("long").alias("rank"), "filter", "mse", "composite"), "mse", "composite")


@register("ranking_csv", with_(*RESULTS, "me AS (SELECT filter, avg(mse) AS mse FROM res GROUP BY filter)") + "SELECT filter, round(mse, 6) AS mse FROM me")
def ranking_csv(spark, sf):
    path = f"{scratch_root(spark)}/ranking-{uuid.uuid4().hex}"
    write_ranking(M.rank_filters(compared(spark, sf)).select("filter", "mse"), path)
    return spark.read.option("header", True).schema("filter string, mse double").csv(path)


@register("best_filter", with_(*RESULTS) + """SELECT ticker, timeframe, filter, round(mse, 6) AS mse FROM res
QUALIFY row_number() OVER (PARTITION BY ticker, timeframe ORDER BY mse, filter) = 1""")
def best_filter(spark, sf):
    return _r(M.best_filter(compared(spark, sf)), "mse")


# The ten filters of the benchmark with their variants: what they are
# called, parameters and edge.
BENCHMARK = [
    ("SMA", "sma", {"window": 11}), ("EMA", "ema", {"alpha": 0.2}), ("WMA", "wma", {"window": 11, "direction": "newest"}),
    ("ALMA", "alma", {"window": 21, "offset": 0.85, "sigma": 6.0}, "causal"), ("SavGol", "savgol", {"window": 11, "order": 3}),
    ("Kalman", "kalman", {"Q": 0.01, "R": 0.1, "model": "diagonal"}), ("Butter", "butterworth", {"order": 4, "cutoff": 0.15}),
    ("Gauss", "gaussian", {"sigma": 2.0}), ("Median", "median", {"window": 5}), ("LOWESS", "lowess", {"frac": 0.2}),
]


@register("compare_all_filters")
def compare_all_filters(spark, sf):
    """The ten filters of the benchmark on every series."""
    ranked = M.rank_filters(compare_filters(stored(clean_noisy(spark, sf)), BENCHMARK, snr="mse"))
    return _r(ranked.select("rank", "filter", "mse", "snr_imp", "lag", "edge_ratio", "composite"), "mse", "snr_imp", "lag", "edge_ratio", "composite", digits=4)


# --- sweeps ----------------------------------------------------------------

SETS = [{"param_id": i, "k_eps": k, "sigma_min": 0.05, "stop_loss_pct": s} for i, (k, s) in enumerate([(0.05, 1.0), (0.15, 2.0), (0.3, 2.0), (0.3, 5.0)])]


def _sweep_sql() -> str:
    """The whole chain with the parameter set as a part of the ticker."""
    values = ", ".join(f"({p['param_id']}, {p['k_eps']}::DOUBLE, {p['stop_loss_pct']}::DOUBLE)" for p in SETS)
    return with_(*SMOOTH, f"ps AS (SELECT * FROM (VALUES {values}) p(param_id, k_eps, stop_pct))",
                 "f2 AS (SELECT f.* REPLACE (f.ticker || '|' || ps.param_id AS ticker), ps.k_eps, ps.stop_pct FROM f CROSS JOIN ps)",
                 "g2 AS (SELECT g.* REPLACE (g.ticker || '|' || ps.param_id AS ticker), ps.k_eps FROM g CROSS JOIN ps)",
                 trigger_sql(60, k="g.k_eps", source="g2"), ROWS.replace("FROM f JOIN", "FROM f2 f JOIN"),
                 PAIRS, SEGMENTS, VERTEX, trades_sql(stop="b.stop_pct"), CAPITAL, EQUITY, SUMMARY) + """
SELECT split_part(ticker, '|', 1) AS ticker, timeframe, split_part(ticker, '|', 2)::BIGINT AS param_id, trades, wins, round(ln(long_return + 100), 7) AS long_log,
round(ln(short_return + 100), 7) AS short_log, round(long_drawdown, 5) AS long_drawdown FROM summary"""


@register("sweep_summary", _sweep_sql())
def sweep(spark, sf):
    r = sweep_summary(stored(hourly(spark, sf)), SETS, base=HOURLY)
    return r.select(*K3, F.col("param_id").cast("long").alias("param_id"), "trades", "wins", F.round(F.ln(F.col("long_return") + 100), 7).alias("long_log"),
                    F.round(F.ln(F.col("short_return") + 100), 7).alias("short_log"), F.round("long_drawdown", 5).alias("long_drawdown"))


# --- windows, resampling, samples ------------------------------------------

WINDOWS = """wf AS (SELECT ticker, timeframe, m AS train_start, m + INTERVAL 6 MONTH AS test_start, m + INTERVAL 9 MONTH AS test_end FROM
 (SELECT ticker, timeframe, unnest(generate_series(date_trunc('month', min(ts))::TIMESTAMP, max(ts) - INTERVAL 9 MONTH + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m
  FROM bars WHERE timeframe = '1d' GROUP BY ticker, timeframe))"""


@register("walk_forward", with_(ORDER_TICKS, bars_sql("1d"), WINDOWS) + """SELECT w.ticker, w.timeframe, train_start, test_start, test_end,
count(*) FILTER (ts < test_start) AS train_rows, count(*) FILTER (ts >= test_start) AS test_rows
FROM wf w JOIN bars b ON b.ticker = w.ticker AND b.timeframe = w.timeframe AND b.ts >= train_start AND b.ts < test_end GROUP BY ALL""")
def walk_forward(spark, sf):
    daily = stored(calendar_bars(spark, sf).where("timeframe = '1d'"))
    rows = E.window_rows(daily, E.walk_forward(daily))
    return rows.groupBy(*K3, "train_start", "test_start", "test_end").agg(
        F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"))


BOOT = """f0 AS (SELECT *, sum(close) OVER (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS filtered FROM s),
pk AS MATERIALIZED (SELECT f.ticker, f.timeframe, p.path, f.idx, f.filtered,
 ('0x' || substr(md5(concat_ws(':', 42, p.path, f.idx, f.ticker, f.timeframe)), 1, 15))::BIGINT % f.n AS pick FROM f0 f CROSS JOIN range(1000) p(path)),
bo AS (SELECT f.ticker, f.timeframe, f.path, f.idx, f.filtered + d.close - d.filtered AS close FROM pk f
 JOIN f0 d ON d.ticker = f.ticker AND d.timeframe = f.timeframe AND d.idx = f.pick),
bf AS (SELECT *, sum(close) OVER (PARTITION BY ticker, timeframe, path ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS y FROM bo),
br AS (SELECT ticker, timeframe, path, sum(pow(bend, 2)) AS roughness FROM (SELECT *, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS bend FROM bf
 WINDOW w AS (PARTITION BY ticker, timeframe, path ORDER BY idx)) GROUP BY ALL)"""


@register("bootstrap", with_(*SERIES, BOOT) + """SELECT ticker, timeframe, round(quantile_cont(roughness, 0.05), 3) AS q5, round(quantile_cont(roughness, 0.5), 3) AS q50,
round(quantile_cont(roughness, 0.95), 3) AS q95 FROM br GROUP BY ALL""")
def bootstrap(spark, sf):
    """A thousand disturbed paths per series, smoothed: how rough they stay."""
    base = apply_filter(indexed(spark, sf), "sma", {"window": 11}).withColumn("residual", F.col("close") - F.col("filtered"))
    paths = E.bootstrap(stored(base.select(*K3, "idx", "n", "filtered", "residual")))
    smooth = apply_filter(paths, "sma", {"window": 5}, keys=[*K3, "path"])
    return _r(E.path_quantiles(roughness(smooth, keys=[*K3, "path"]), "roughness"), "q5", "q50", "q95", digits=3)


WINDOWED = """bars AS (SELECT b.* REPLACE (b.ticker || '|' || strftime(train_start, '%Y-%m-%d') || '|' || CASE WHEN b.ts < test_start THEN 'train' ELSE 'test' END AS ticker)
 FROM b0 b JOIN wf ON wf.ticker = b.ticker AND wf.timeframe = b.timeframe AND b.ts >= train_start AND b.ts < test_end)"""
WINDOW_SETS = [{"param_id": i, "k_eps": k, "sigma_min": 0.05, "stop_loss_pct": s} for i, (k, s) in enumerate([(0.05, 1.0), (0.4, 30.0), (0.9, 5.0)])]


def _windows_sql() -> str:
    values = ", ".join(f"({p['param_id']}, {p['k_eps']}::DOUBLE, {p['stop_loss_pct']}::DOUBLE)" for p in WINDOW_SETS)
    return with_(ORDER_TICKS, bars_sql("1d", name="b0"), WINDOWS.replace("FROM bars", "FROM b0").replace("INTERVAL 1 MONTH)", "INTERVAL 6 MONTH)"), WINDOWED, S, filtered_sql(3), derived_sql(),
                 f"ps AS (SELECT * FROM (VALUES {values}) p(param_id, k_eps, stop_pct))",
                 "f2 AS (SELECT f.* REPLACE (f.ticker || '|' || ps.param_id AS ticker), ps.k_eps, ps.stop_pct FROM f CROSS JOIN ps)",
                 "g2 AS (SELECT g.* REPLACE (g.ticker || '|' || ps.param_id AS ticker), ps.k_eps FROM g CROSS JOIN ps)",
                 trigger_sql(20, k="g.k_eps", source="g2"), ROWS.replace("FROM f JOIN", "FROM f2 f JOIN"),
                 PAIRS, SEGMENTS, VERTEX, trades_sql(stop="b.stop_pct"), CAPITAL, EQUITY, SUMMARY,
                 """sm AS (SELECT split_part(ticker, '|', 1) AS ticker, timeframe, split_part(ticker, '|', 2)::TIMESTAMP AS train_start, split_part(ticker, '|', 3) AS part,
 split_part(ticker, '|', 4)::BIGINT AS param_id, coalesce(trades, 0) AS trades, coalesce(total_return, 0) AS total_return FROM (SELECT DISTINCT ticker, timeframe FROM f2) LEFT JOIN summary USING (ticker, timeframe))""") + """
SELECT a.ticker, a.timeframe, a.train_start, a.param_id, round(sign(a.total_return) * ln(1 + abs(a.total_return)), 6) AS train_log,
round(sign(b.total_return) * ln(1 + abs(b.total_return)), 6) AS test_log, b.trades AS test_trades
FROM (SELECT * FROM sm WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY ticker, timeframe, train_start ORDER BY round(total_return, 9) DESC, param_id) = 1) a
LEFT JOIN sm b ON b.part = 'test' AND b.ticker = a.ticker AND b.timeframe = a.timeframe AND b.train_start = a.train_start AND b.param_id = a.param_id"""


@register("walk_forward_test", _windows_sql())
def walk_forward_best(spark, sf):
    """Per window the set that did best in six months, and its next three."""
    daily = stored(calendar_bars(spark, sf).where("timeframe = '1d'"))
    r = walk_forward_test(daily, WINDOW_SETS, base=Settings("sma", {"window": 3}, span=20, decimals=6), step=6)
    log = lambda c: F.round(F.signum(c) * F.log1p(F.abs(c)), 6)
    return r.select(*K3, "train_start", F.col("param_id").cast("long").alias("param_id"), log("train_score").alias("train_log"), log("test_score").alias("test_log"), "test_trades")


HALVES = (TICKS, "a AS (SELECT * FROM ticks WHERE ts < TIMESTAMP '2024-01-16')", "b AS (SELECT * FROM ticks WHERE ts >= TIMESTAMP '2024-01-16')")


def halves(spark, sf):
    t = ticks(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return t.where(F.col("ts") < cut), t.where(F.col("ts") >= cut)


@register("ks_distance", with_(*HALVES, "v AS (SELECT ticker, price, count_if(w = 'a') AS ca, count_if(w = 'b') AS cb FROM (SELECT ticker, price, 'a' AS w FROM a UNION ALL SELECT ticker, price, 'b' FROM b) GROUP BY ALL)") + """
SELECT ticker, round(max(abs(fa / na - fb / nb)), 8) AS ks FROM (SELECT ticker, sum(ca) OVER w AS fa, sum(cb) OVER w AS fb, sum(ca) OVER (PARTITION BY ticker) AS na, sum(cb) OVER (PARTITION BY ticker) AS nb
FROM v WINDOW w AS (PARTITION BY ticker ORDER BY price)) GROUP BY ticker""")
def ks_distance(spark, sf):
    return _r(M.ks(*halves(spark, sf), "price", ["ticker"]), "ks", digits=8)


@register("psi", with_(*HALVES, "v AS (SELECT ticker, floor(price / 20) AS k, count_if(w = 'a') AS ca, count_if(w = 'b') AS cb FROM (SELECT ticker, price, 'a' AS w FROM a UNION ALL SELECT ticker, price, 'b' FROM b) GROUP BY ALL)") + """
SELECT ticker, round(sum((pa - pb) * ln(pa / pb)), 8) AS psi FROM (SELECT ticker, greatest(ca / sum(ca) OVER (PARTITION BY ticker), 1e-4) AS pa, greatest(cb / sum(cb) OVER (PARTITION BY ticker), 1e-4) AS pb FROM v) GROUP BY ticker""")
def psi(spark, sf):
    return _r(M.psi(*halves(spark, sf), F.floor(F.col("price") / 20), ["ticker"]), "psi", digits=8)

"""Registered queries: filters on series with missing values, and a user's filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.base import ORACLES, SERIES, S, indexed, register, stored, with_
from tidebars.catalog.smoothing import KALMAN_SQL
from tidebars.operators.extensions import dema as dema_of
from tidebars.operators.filters import REGISTRY, FilterSpec, apply_filter, register_filter
from tidebars.operators.lowess import lowess
from tidebars.operators.metrics import xcorr_lag

# From row 61 on, 15 of 97 rows have no close, and single ones besides.
HOLE = "idx % 97 BETWEEN 61 AND 75 OR idx % 23 = 22 AND idx > 61"
HOLED = (*SERIES[:-1], S.replace("s AS (", "s0 AS (", 1), f"s AS (SELECT * REPLACE (CASE WHEN NOT ({HOLE}) THEN close END AS close) FROM s0)")
SEEN = (*SERIES[:-1], S.replace("s AS (", "s0 AS (", 1), f"""s AS (SELECT * EXCLUDE (idx, n), idx AS row, row_number() OVER (PARTITION BY ticker, timeframe ORDER BY idx) - 1 AS idx,
 count(*) OVER (PARTITION BY ticker, timeframe) AS n FROM s0 WHERE NOT ({HOLE}))""")
EMA_STEP = """seen AS (SELECT *, row_number() OVER w AS r, idx - lag(idx) OVER w AS gap FROM s WHERE close IS NOT NULL WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx)),
e AS (SELECT ticker, timeframe, idx, r, close AS y FROM seen WHERE r = 1 UNION ALL
 SELECT s.ticker, s.timeframe, s.idx, s.r, (pow(1 - {a}, s.gap) * e.y + {a} * s.close) / (pow(1 - {a}, s.gap) + {a})
 FROM e JOIN seen s ON s.ticker = e.ticker AND s.timeframe = e.timeframe AND s.r = e.r + 1)"""


def holed(spark, sf):
    rows = indexed(spark, sf)
    hole = (F.col("idx") % 97).between(61, 75) | ((F.col("idx") % 23 == 22) & (F.col("idx") > 61))
    return rows.withColumn("close", F.when(~hole, F.col("close")))


def _out(df, c="filtered"):
    return df.select("ticker", "timeframe", "idx", F.round(c, 6).alias(c))


@register("filter_ema_holes", with_(*HOLED, EMA_STEP.format(a="(2.0::DOUBLE / 6)")) + """SELECT s.ticker, s.timeframe, s.idx,
round(last_value(e.y IGNORE NULLS) OVER (PARTITION BY s.ticker, s.timeframe ORDER BY s.idx), 6) AS filtered FROM s LEFT JOIN e USING (ticker, timeframe, idx)""")
def filter_ema_holes(spark, sf):
    return _out(apply_filter(stored(holed(spark, sf)), "ema", {"span": 5}))


@register("filter_ema_holes_chunked", ORACLES["filter_ema_holes"])
def filter_ema_holes_chunked(spark, sf):
    """Chunks far shorter than the series, some with hardly a value."""
    return _out(apply_filter(stored(holed(spark, sf)), "ema", {"span": 5}, chunk_rows=8))


@register("filter_kalman_holes", with_(*HOLED, KALMAN_SQL.format(q="0.01::DOUBLE", r="1.0::DOUBLE")) + "SELECT ticker, timeframe, idx, round(pos, 6) AS filtered FROM kf")
def filter_kalman_holes(spark, sf):
    return _out(apply_filter(stored(holed(spark, sf)), "kalman", {"Q": 0.01, "R": 1.0}, chunk_rows=100))


@register("filter_butterworth_holes", with_(*HOLED) + """SELECT ticker, timeframe, idx, NULL::DOUBLE AS filtered FROM s
WHERE (ticker, timeframe) IN (SELECT (ticker, timeframe) FROM s WHERE close IS NULL)""")
def filter_butterworth_holes(spark, sf):
    return _out(apply_filter(stored(holed(spark, sf)), "butterworth", {"order": 4, "cutoff": 0.15}, chunk_rows=200))


def _seen_sql(name: str) -> str:
    """The SQL of ``name`` over the seen rows only, put back on all rows."""
    body, last = ORACLES[name].replace(S, SEEN[-2] + ", " + SEEN[-1]).rsplit("SELECT ticker, timeframe, idx, round(", 1)
    return body + f"""SELECT s0.ticker, s0.timeframe, s0.idx, r.filtered FROM s0 LEFT JOIN s ON s.ticker = s0.ticker AND s.timeframe = s0.timeframe AND s.row = s0.idx
LEFT JOIN (SELECT ticker, timeframe, idx, round({last}) r ON r.ticker = s.ticker AND r.timeframe = s.timeframe AND r.idx = s.idx"""


@register("filter_lowess_holes", _seen_sql("filter_lowess_plain"))
def filter_lowess_holes(spark, sf):
    return _out(lowess(stored(holed(spark, sf)), params={"frac": 0.1, "passes": 0, "rule": "round"}))


@register("filter_lowess_holes_long", _seen_sql("filter_lowess_robust"))
def filter_lowess_holes_long(spark, sf):
    """The way for series of any length, three re-weighting passes."""
    return _out(lowess(stored(holed(spark, sf)), params={"frac": 0.1}, short_rows=10))


@register("dema_holes", with_(*HOLED, EMA_STEP.format(a="(2.0::DOUBLE / 11)"), """f AS (SELECT s.ticker, s.timeframe, s.idx,
 last_value(e.y IGNORE NULLS) OVER (PARTITION BY s.ticker, s.timeframe ORDER BY s.idx) AS e1 FROM s LEFT JOIN e USING (ticker, timeframe, idx))""",
                              """g AS (SELECT *, e1 AS e2 FROM f WHERE idx = 0 UNION ALL
 SELECT f.*, (2.0::DOUBLE / 11) * f.e1 + (1 - 2.0::DOUBLE / 11) * g.e2 FROM g JOIN f ON f.ticker = g.ticker AND f.timeframe = g.timeframe AND f.idx = g.idx + 1)""")
          + "SELECT ticker, timeframe, idx, round(2 * e1 - e2, 6) AS dema FROM g")
def dema_holes(spark, sf):
    return _out(dema_of(stored(holed(spark, sf)), 10), "dema")


@register("xcorr_lag_holes", with_(*HOLED, """v AS (SELECT ticker, timeframe, close AS x, lag(close, 3) OVER (PARTITION BY ticker, timeframe ORDER BY idx) AS y, idx FROM s)""",
                                   """k AS (SELECT *, row_number() OVER (PARTITION BY ticker, timeframe ORDER BY idx) AS i, x - avg(x) OVER p AS a, y - avg(y) OVER p AS b
 FROM v WHERE x IS NOT NULL AND y IS NOT NULL WINDOW p AS (PARTITION BY ticker, timeframe))""",
                                   """c AS (SELECT f.ticker, f.timeframe, f.i - n.i AS lag, round(sum(f.b * n.a), 9) AS c FROM k f JOIN k n ON n.ticker = f.ticker AND n.timeframe = f.timeframe
 GROUP BY ALL)""") + "SELECT ticker, timeframe, arg_max(lag, (c, -lag))::BIGINT AS lag FROM c GROUP BY ALL")
def xcorr_lag_holes(spark, sf):
    from pyspark.sql import Window

    late = F.lag("close", 3).over(Window.partitionBy("ticker", "timeframe").orderBy("idx"))
    return xcorr_lag(stored(holed(spark, sf).withColumns({"noisy": F.col("close"), "filtered": late})))


@register("user_filter", with_(*SERIES) + """SELECT ticker, timeframe, idx, round((max(close) OVER w + min(close) OVER w) / 2, 6) AS filtered FROM s
WINDOW w AS (PARTITION BY ticker, timeframe ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def user_filter(spark, sf):
    """A filter that a user adds: the middle of the range around each row."""
    def middle(cut, x, out, p, w, edge):
        around = w.rowsBetween(-int(p["half"]), int(p["half"]))
        return cut.withColumn(out, (F.max(x).over(around) + F.min(x).over(around)) / 2)

    reach = lambda p, edge: (int(p["half"]), int(p["half"]), 0)
    register_filter(FilterSpec("midrange", "Middle of the range", "window", middle, reach, {"half": (1, 50, 1, 3)}))
    try:
        return _out(apply_filter(indexed(spark, sf), "midrange"))
    finally:
        REGISTRY.pop("midrange")

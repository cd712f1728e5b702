"""Parabolas over signal stretches and their extrapolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.scalars import poly_at
from tidebars.operators.align import asof_backward
from tidebars.operators.series import CHUNK_ROWS, chunk_of
from tidebars.schema import KEYS


def segment_rows(bars: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS, x: str = "filtered",
                 chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Rows of every pair, both ends included. Pairs tile the axis, so a row
    finds its pair by an as-of look-up on the start; the row that ends one pair
    and starts the next is emitted for both. No range join."""
    keys = list(keys)
    cols = ["pair_id", "start_idx", "end_idx", "y_end"]
    right = pairs.select(*keys, F.col("start_idx").alias("idx"), "pair_id", "start_idx", "end_idx",
                         *(["y_end"] if "y_end" in pairs.columns else [F.lit(None).cast("double").alias("y_end")]))
    left = bars.select(*keys, "idx", x)
    found = asof_backward(left, right, keys, "idx", cols, chunk_of(chunk_rows=chunk_rows))
    inner = found.where(F.col("idx") < F.col("end_idx"))
    at_end = F.col("end_idx").alias("idx")
    if "y_end" in pairs.columns:
        ends = pairs.select(*keys, at_end, F.col("y_end").alias(x), "pair_id", "start_idx", "end_idx", "y_end")
    else:
        ends = pairs.select(*keys, at_end, "pair_id", "start_idx", "end_idx").join(left, [*keys, "idx"]).withColumn("y_end", F.col(x))
    return inner.unionByName(ends.select(*inner.columns))


def fit_pairs(rows: DataFrame, mode: str = "parabola", keys: Sequence[str] = KEYS, x: str = "filtered",
              min_span: int = 3) -> DataFrame:
    """One parabola per pair from the rows of ``segment_rows``. ``parabola``
    puts the vertex on the last row and fits the curvature only, ``poly2`` is a
    free quadratic. Both are plain sums per pair (partial sums before the
    shuffle), taken around the last row. Pairs that span fewer than
    ``min_span`` rows and failed fits are dropped."""
    keys = list(keys)
    d = (F.col("idx") - F.col("end_idx")).cast("double")
    y = F.col(x) - F.col("y_end")
    d2 = d * d
    if mode == "parabola":
        sums = [F.sum(d2 * d2).alias("_s4"), F.sum(d2 * y).alias("_t2")]
    else:
        sums = [F.sum(F.lit(1.0)).alias("_s0"), F.sum(d).alias("_s1"), F.sum(d2).alias("_s2"),
                F.sum(d2 * d).alias("_s3"), F.sum(d2 * d2).alias("_s4"),
                F.sum(y).alias("_t0"), F.sum(d * y).alias("_t1"), F.sum(d2 * y).alias("_t2")]
    whole = F.count(x) == F.count(F.lit(1))
    g = (
        rows.where(F.col("end_idx") - F.col("start_idx") >= min_span)
        .groupBy(*keys, "pair_id", "start_idx", "end_idx", "y_end").agg(*sums, whole.alias("_whole"))
        .where("_whole")
    )
    end = F.col("end_idx").cast("double")
    if mode == "parabola":
        g = g.where("_s4 >= 1e-12").select(
            *keys, "pair_id", "start_idx", "end_idx", (F.col("_t2") / F.col("_s4")).alias("a"),
            F.lit(0.0).alias("b"), F.col("y_end").alias("c"), end.alias("x0"))
        return g.where("a is not null")
    s0, s1, s2, s3, s4 = (F.col(f"_s{i}") for i in range(5))
    t0, t1, t2 = (F.col(f"_t{i}") for i in range(3))
    # Means taken out first: d^2 and d against their covariances.
    c11, c12, c22 = s2 - s1 * s1 / s0, s3 - s1 * s2 / s0, s4 - s2 * s2 / s0
    u1, u2 = t1 - s1 * t0 / s0, t2 - s2 * t0 / s0
    det = c11 * c22 - c12 * c12
    qa = F.try_divide(c11 * u2 - c12 * u1, det)
    qb = F.try_divide(c22 * u1 - c12 * u2, det)
    g = g.withColumn("a", qa).withColumn("_b", qb)
    g = g.withColumn("_c", (t0 - F.col("_b") * s1 - F.col("a") * s2) / s0 + F.col("y_end"))
    return g.where("a is not null").select(
        *keys, "pair_id", "start_idx", "end_idx", "a",
        (F.col("_b") - 2.0 * F.col("a") * end).alias("b"),
        (F.col("_c") - F.col("_b") * end + F.col("a") * end * end).alias("c"),
        F.lit(None).cast("double").alias("x0"))


def at(x: Column) -> Column:
    return poly_at(F.col("a"), F.col("b"), F.col("c"), F.col("x0"), x)


def fitted(rows: DataFrame, fits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    keys = list(keys)
    joined = rows.join(fits.select(*keys, "pair_id", "a", "b", "c", "x0"), [*keys, "pair_id"])
    return joined.withColumn("y_fit", at(F.col("idx").cast("double"))).drop("a", "b", "c", "x0")


def extrapolate(fits: DataFrame, n_ext: int = 8) -> DataFrame:
    """``n_ext`` predicted rows per fit, starting on the last row of the pair."""
    steps = F.explode(F.sequence(F.col("end_idx"), F.col("end_idx") + n_ext - 1))
    return fits.withColumn("idx", steps).withColumn("y_pred", at(F.col("idx").cast("double")))


def direction(fits: DataFrame, n_ext: int | str = 8) -> DataFrame:
    """``up``: the last predicted value is above the first (NULL for n_ext < 2)."""
    steps = F.col(n_ext) if isinstance(n_ext, str) else F.lit(n_ext)
    first = at(F.col("end_idx").cast("double"))
    last = at((F.col("end_idx") + steps - 1).cast("double"))
    return fits.withColumn("up", F.when(steps >= 2, last > first))


def attach_fit(pairs: DataFrame, fits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs with the fit that ends where they end."""
    return pairs.join(fits.select(*keys, "end_idx", "a", "b", "c", "x0"), [*keys, "end_idx"])


def pred_residual(fits: DataFrame, bars: DataFrame, n_ext: int = 8, keys: Sequence[str] = KEYS,
                  x: str = "filtered") -> DataFrame:
    """Predicted minus last filtered value on every extrapolated row."""
    keys = list(keys)
    base = bars.select(*keys, F.col("idx").alias("end_idx"), F.col(x).alias("_base"))
    return extrapolate(fits.join(base, [*keys, "end_idx"]), n_ext).withColumn(
        "residual", F.col("y_pred") - F.col("_base")).drop("_base")

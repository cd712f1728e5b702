"""Quality of a filtered series and ranking of filters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.scalars import known
from tidebars.functions.taps import bell, odd
from tidebars.operators.derive import roughness
from tidebars.operators.filters import apply_filter, defaults
from tidebars.operators.series import scan, seen_only
from tidebars.operators.spectrum import BLOCK, correlation, spectrum
from tidebars.schema import KEYS
from tidebars.sources.storage import materialize


def valid_rows(df: DataFrame, clean: str = "clean", noisy: str = "noisy", filtered: str = "filtered") -> DataFrame:
    """Rows on which all three series are known: the convention every metric
    and every user function follows."""
    return df.where(known(clean).isNotNull() & known(noisy).isNotNull() & known(filtered).isNotNull())


def _enough(c: Column) -> Column:
    return F.when(F.count(F.lit(1)) >= 3, c)


def error_metrics(df: DataFrame, keys: Sequence[str] = KEYS, clean: str = "clean", noisy: str = "noisy",
                  filtered: str = "filtered") -> DataFrame:
    """MSE, RMSE, MAE and SNR improvement; NULL for fewer than three rows."""
    r = F.col(filtered) - F.col(clean)
    gain = F.try_divide(F.var_pop(F.col(noisy) - F.col(clean)), F.var_pop(r))
    return valid_rows(df, clean, noisy, filtered).groupBy(*keys).agg(
        _enough(F.avg(r * r)).alias("mse"),
        _enough(F.sqrt(F.avg(r * r))).alias("rmse"),
        _enough(F.avg(F.abs(r))).alias("mae"),
        _enough(F.when(F.var_pop(r) > 1e-12, F.log10(gain) * 10.0).otherwise(99.0)).alias("snr_imp"),
    )


def snr_improvement(df: DataFrame, keys: Sequence[str] = KEYS, form: str = "variance", clean: str = "clean",
                    noisy: str = "noisy", filtered: str = "filtered") -> DataFrame:
    """``form`` variance: ratio of error variances, 99 for a perfect result;
    mse: ratio of mean square errors with a 1e-15 guard on both."""
    if form == "variance":
        return error_metrics(df, keys, clean, noisy, filtered).select(*keys, "snr_imp")
    before = F.avg((F.col(noisy) - F.col(clean)) * (F.col(noisy) - F.col(clean))) + 1e-15
    after = F.avg((F.col(filtered) - F.col(clean)) * (F.col(filtered) - F.col(clean))) + 1e-15
    return df.groupBy(*keys).agg((F.log10(before / after) * 10.0).alias("snr_imp"))


def input_snr(df: DataFrame, keys: Sequence[str] = KEYS, clean: str = "clean", noisy: str = "noisy") -> DataFrame:
    noise = F.var_pop(F.col(noisy) - F.col(clean)) + 1e-15
    level = F.var_pop(clean)
    return df.groupBy(*keys).agg(F.when(level > 1e-15, F.log10(level / noise) * 10.0).otherwise(0.0).alias("snr_in"))


def xcorr_lag(df: DataFrame, keys: Sequence[str] = KEYS, noisy: str = "noisy", filtered: str = "filtered",
              max_lag: int | None = None, block: int = BLOCK) -> DataFrame:
    """Lag at which filtered and noisy correlate best, the smallest of equal
    ones, out of all or of those up to ``max_lag``. The sums of all lags come from Fourier
    transforms, so the rows grow with the length of a series, not with its square. Rows
    on which either is missing are left out before; fewer than three rows have lag 0."""
    keys = list(keys)
    every = df.select(*keys).distinct()
    both = known(noisy).isNotNull() & known(filtered).isNotNull()
    df = seen_only(df.select(*keys, "idx", "n", noisy, filtered), keys, both)
    means = df.groupBy(*keys).agg(F.avg(filtered).alias("_mf"), F.avg(noisy).alias("_mn"))
    rows = df.where("n >= 3").join(means, keys).select(
        *keys, "idx", "n", (F.col(filtered) - F.col("_mf")).alias("_f"), (F.col(noisy) - F.col("_mn")).alias("_n"))
    reach = F.col("n") - 1 if max_lag is None else F.least(F.col("n") - 1, F.lit(max_lag))
    sums = correlation(rows, keys, "_f", "_n", block).join(rows.select(*keys, "n").distinct(), keys).where(F.abs("lag") <= reach)
    best = sums.groupBy(*keys).agg(F.max_by("lag", F.struct(F.round("c", 9), -F.col("lag"))).alias("lag"))
    return every.join(best, keys, "left").withColumn("lag", F.coalesce("lag", F.lit(0).cast("long")))


def edge_ratio(df: DataFrame, frac: float = 0.05, keys: Sequence[str] = KEYS, clean: str = "clean",
               filtered: str = "filtered") -> DataFrame:
    """Mean error of the first and last ``frac`` rows over that of the rest."""
    k = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(frac)))
    at_edge = (F.col("idx") < k) | (F.col("idx") >= F.col("n") - k)
    err = F.abs(F.col(clean) - F.col(filtered))
    known_rows = df.where(known(clean).isNotNull() & known(filtered).isNotNull())
    return known_rows.groupBy(*keys).agg(
        (F.avg(F.when(at_edge, err)) / (F.avg(F.when(~at_edge, err)) + 1e-15)).alias("edge_ratio"))


def all_metrics(df: DataFrame, keys: Sequence[str] = KEYS, snr: str = "variance") -> DataFrame:
    """Error metrics, roughness and edge ratio of (clean, noisy, filtered); ``snr`` is the
    form of the SNR improvement."""
    keys = list(keys)
    errors = error_metrics(df, keys)
    if snr != "variance":
        errors = errors.drop("snr_imp").join(snr_improvement(df, keys, snr), keys)
    return errors.join(roughness(df, "filtered", keys=keys), keys).join(edge_ratio(df, keys=keys), keys)


# Lag of filters whose delay is known, in windows of w rows.
_HALF_WINDOW = ("sma", "wma", "savgol", "median")
_ZERO_PHASE = ("gaussian", "butterworth", "lowess")
# Rows of the probe of other filters, whose impulse stands at a quarter.
PROBE_ROWS = 2000


def filter_lag(spark: SparkSession, filter_id: str, params: dict | None = None) -> float:
    """Delay of a filter, which is a property of the filter alone: half the window for
    symmetric windows, zero for zero-phase filters, the centre of its weights for ALMA,
    else the centroid of the response to a unit impulse."""
    p = {**defaults(filter_id), **(params or {})}
    if filter_id in _HALF_WINDOW:
        return (odd(int(p["window"])) - 1) / 2.0
    if filter_id in _ZERO_PHASE:
        return 0.0
    if filter_id == "alma":
        width = odd(int(p["window"]))
        return float(np.arange(width) @ bell(width, p["offset"] * (width - 1), width / max(p["sigma"], 1e-6)))
    pos = PROBE_ROWS // 4
    probe = spark.range(PROBE_ROWS).select(F.lit("probe").alias("ticker"), F.col("id").alias("idx"), F.lit(PROBE_ROWS).cast("long").alias("n"),
                                           F.when(F.col("id") == pos, 1.0).otherwise(0.0).alias("x"))
    weight = F.abs("filtered")
    out = apply_filter(probe, filter_id, params, x="x", keys=["ticker"])
    centroid = out.agg(F.try_divide(F.sum(F.col("idx") * weight), F.sum(weight)) - pos).first()[0]
    return max(0.0, centroid or 0.0)


def impulse_lag(series: DataFrame, filter_id: str, params: dict | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """``filter_lag`` for every series."""
    return series.select(*keys).distinct().withColumn("lag", F.lit(filter_lag(series.sparkSession, filter_id, params)))


def minmax(df: DataFrame, cols: dict[str, bool], suffix: str = "_norm") -> DataFrame:
    """Scale columns to 0..1, 1 being best; the flag says that higher is
    better. A constant column gives 1. Extremes come from one aggregate row."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = df.crossJoin(F.broadcast(ends))
    for c, higher in cols.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        part = F.try_divide(F.col(c) - lo, hi - lo)
        out = out.withColumn(c + suffix, F.when(hi - lo < 1e-15, 1.0).otherwise(part if higher else 1.0 - part))
    return out.select(*df.columns, *[c + suffix for c in cols])


# Metrics of the composite score, and whether higher is better.
SCORED = {"mse": False, "snr_imp": True, "lag": False, "roughness": False, "edge_ratio": False}


def rank_filters(results: DataFrame, scored: dict[str, bool] = SCORED) -> DataFrame:
    """``results``: one row per (filter, series). Means per filter, composite
    of the scaled means, rank. Ranks a handful of filters."""
    means = results.groupBy("filter").agg(*[F.avg(c).alias(c) for c in scored])
    scaled = minmax(means, scored)
    composite = sum((F.col(f"{c}_norm") for c in scored), F.lit(0.0)) / float(len(scored))
    scaled = scaled.withColumn("composite", composite)
    place = F.rank().over(Window.orderBy(F.round("composite", 9).desc(), "filter"))
    return scaled.withColumn("rank", place).select("rank", "filter", *scored, "composite")


def best_filter(results: DataFrame, by: Sequence[str] = KEYS, score: str = "mse", order: str = "filter") -> DataFrame:
    """Filter with the smallest error per series; ties go to the smaller
    ``order``."""
    return results.groupBy(*by).agg(
        F.min_by("filter", F.struct(score, order)).alias("filter"), F.min(score).alias(score))


def freq_response(df: DataFrame, keys: Sequence[str] = KEYS, x: str = "close", filtered: str = "filtered",
                  bins: Sequence[int] | None = None, block: int = BLOCK) -> DataFrame:
    """Magnitude of the filtered over the input spectrum per frequency bin, up to half the
    length of the series or for ``bins`` only; missing values count as zero."""
    keys = list(keys)
    wanted = F.col("bin") <= F.floor(F.col("n") / 2) if bins is None else F.col("bin").isin(list(bins))
    rows = df.select(*keys, "idx", "n", F.col(x).alias("_x"), F.col(filtered).alias("_y"))
    found = spectrum(rows, keys, ["_x", "_y"], block).where(wanted)
    mag = lambda v: F.sqrt(F.col(f"{v}_re") * F.col(f"{v}_re") + F.col(f"{v}_im") * F.col(f"{v}_im"))
    return found.select(*keys, "bin", (F.col("bin") / F.col("n")).alias("freq"), (mag("_y") / (mag("_x") + 1e-15)).alias("response"))


def ks(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples. Equal values are counted
    together first; the running shares go over ranges of the distinct values, whose sums
    are carried on, so no task sorts a whole sample."""
    keys = list(keys)
    sides = a.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    tally = sides.groupBy(*keys, "_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    # As many ranges as the values need; equal values and keys are in one, in order.
    ranges = materialize(tally.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    upto = scan(ranges, keys, F.col("_part"), ["_v"], {"_ca": ("sum", F.col("_a"), False), "_cb": ("sum", F.col("_b"), False)})
    sizes = ranges.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    return upto.join(sizes, keys).groupBy(*keys).agg(F.max(F.abs(F.col("_ca") / F.col("_na") - F.col("_cb") / F.col("_nb"))).alias("ks"))


def psi(a: DataFrame, b: DataFrame, bucket: Column, keys: Sequence[str] = KEYS, floor: float = 1e-4) -> DataFrame:
    """Population stability index over ``bucket``: shares of both samples,
    empty shares raised to ``floor``."""
    keys = list(keys)
    sides = a.select(*keys, bucket.alias("_k"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, bucket.alias("_k"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    shares = sides.groupBy(*keys, "_k").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    total = shares.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    pa = F.greatest(F.try_divide(F.col("_a"), F.col("_na")), F.lit(floor))
    pb = F.greatest(F.try_divide(F.col("_b"), F.col("_nb")), F.lit(floor))
    return shares.join(total, keys).groupBy(*keys).agg(F.sum((pa - pb) * F.ln(pa / pb)).alias("psi"))

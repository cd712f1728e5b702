"""Fourier transforms of series, in two steps of bounded groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that one group of a step has at most; a power of two.
BLOCK = 65_536


def _parts(values: Sequence[str]) -> list[str]:
    return [f"{v}_{p}" for v in values for p in ("re", "im")]


def _step(rows: DataFrame, keys: Sequence[str], group: str, place: str, size: str, out: str, values: Sequence[str], sign: int, turned: bool) -> DataFrame:
    """Transforms within each group; ``out`` takes the place of ``place``. ``turned``:
    results are multiplied by the twiddle factors between the steps."""
    kept = [*keys, "size", "n1", "n2", group]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in _parts(values)]])

    def each(t: pa.Table) -> pa.Table:
        n, g, total = (t.column(c)[0].as_py() for c in (size, group, "size"))
        at, k = t.column(place).to_numpy(), np.arange(n)
        turn = np.exp(sign * 2j * np.pi * (g * k % total) / total) if turned else 1.0
        columns = []
        for v in values:
            z = np.zeros(n, complex)
            z[at] = t.column(f"{v}_re").to_numpy() + 1j * t.column(f"{v}_im").to_numpy()
            z = (np.fft.fft(z) if sign < 0 else np.fft.ifft(z, norm="forward")) * turn
            columns += [pa.array(z.real.copy()), pa.array(z.imag.copy())]
        head = t.select(kept).take(pa.array(np.zeros(n, np.int64)))
        return pa.Table.from_arrays([*head.columns, pa.array(k), *columns], schema.fieldNames())

    return rows.groupBy(*keys, group).applyInArrow(each, schema)


def first_size(size: Column, block: int) -> Column:
    """The largest divisor of ``size`` that a group may have as many rows as."""
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(block).cast("long")), lambda d: size % d == 0)
    return F.when(size <= block, size).otherwise(F.array_max(divisors)).cast("long")


def fourier(rows: DataFrame, keys: Sequence[str], values: Sequence[str], inverse: bool = False, block: int = BLOCK) -> DataFrame:
    """Transform of each series over ``idx`` 0 .. ``size`` - 1 (rows that are not there are
    zero); columns ``v_re`` and ``v_im`` for each of ``values``, at ``idx`` again. The inverse
    isn't divided by ``size``.

    ``size`` = n1 * n2: rows with equal ``idx % n2`` are transformed over n1 rows, turned,
    and rows with equal place then over n2 rows. So a series of any length meets in groups
    of at most ``block`` rows, and each step has ``size`` rows. A series that fits into one
    group needs the first step only."""
    keys, sign = list(keys), 1 if inverse else -1
    sized = rows.select(*keys, "size").distinct().withColumn("n1", first_size(F.col("size"), block)).withColumn("n2", F.expr("size div n1"))
    rows = rows.select(*keys, "idx", *_parts(values)).join(sized, keys).withColumns({"_t1": F.expr("idx div n2"), "_t2": F.expr("idx % n2")})
    once = _step(rows, keys, "_t2", "_t1", "n1", "_k1", values, sign, turned=True)
    twice = _step(once.where("n2 > 1"), keys, "_k1", "_t2", "n2", "_k2", values, sign, turned=False)
    whole = [*keys, "size", "idx", *_parts(values)]
    return once.where("n2 = 1").withColumn("idx", F.col("_k1")).select(whole).unionByName(
        twice.withColumn("idx", F.col("_k1") + F.col("n1") * F.col("_k2")).select(whole))


def times(a: str, b: str, conjugate: bool = False) -> tuple[Column, Column]:
    """Product of two complex values, the second one conjugated on request."""
    re, im, c, d = F.col(f"{a}_re"), F.col(f"{a}_im"), F.col(f"{b}_re"), F.col(f"{b}_im")
    d = -d if conjugate else d
    return re * c - im * d, re * d + im * c


def padded(length: Column) -> Column:
    """The least power of two that is not below ``length``."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(length))).cast("long")


def correlation(rows: DataFrame, keys: Sequence[str], first: str, second: str, block: int = BLOCK) -> DataFrame:
    """``lag, c`` for every lag: sum over idx of first[idx] * second[idx - lag], by one
    transform of both padded columns and one back."""
    keys = list(keys)
    size = padded(2 * F.col("n") - 1).alias("size")
    none = F.lit(0.0)
    spread = rows.select(*keys, "idx", size, F.col(first).alias("a_re"), none.alias("a_im"), F.col(second).alias("b_re"), none.alias("b_im"))
    there = fourier(spread, keys, ["a", "b"], block=block)
    re, im = times("a", "b", conjugate=True)
    back = fourier(there.select(*keys, "size", "idx", re.alias("c_re"), im.alias("c_im")), keys, ["c"], inverse=True, block=block)
    lag = F.when(F.col("idx") * 2 < F.col("size"), F.col("idx")).otherwise(F.col("idx") - F.col("size"))
    return back.select(*keys, lag.alias("lag"), (F.col("c_re") / F.col("size")).alias("c"))


def spectrum(rows: DataFrame, keys: Sequence[str], values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``bin, n`` and ``v_re, v_im``: the transform of real columns at the n frequencies of
    each series. A length that doesn't split into two sizes of at most ``block`` (a prime,
    say) is turned into a correlation with a chirp, whose padded length does."""
    keys = list(keys)
    lengths = rows.select(*keys, "n").distinct().withColumn("_splits", first_size(F.col("n"), block) * block >= F.col("n"))
    rows = rows.select(*keys, "idx", *values).join(lengths, keys)
    real = [c for v in values for c in (F.coalesce(F.col(v), F.lit(0.0)).alias(f"{v}_re"), F.lit(0.0).alias(f"{v}_im"))]
    plain = fourier(rows.where("_splits").select(*keys, "idx", F.col("n").alias("size"), *real), keys, values, block=block)
    plain = plain.select(*keys, F.col("idx").alias("bin"), F.col("size").alias("n"), *_parts(values))
    # bin * idx = (bin^2 + idx^2 - (bin - idx)^2) / 2; squares are reduced to whole turns first
    angle = lambda c: F.expr(f"pi() * (({c} * {c}) % (2 * n)) / n")
    odd = rows.where("NOT _splits").withColumns({"size": padded(2 * F.col("n") - 1), "_w": angle("idx")})
    bent = [c for v in values for c in ((F.col(v) * F.cos("_w")).alias(f"{v}_re"), (-F.col(v) * F.sin("_w")).alias(f"{v}_im"))]
    chirp = [F.cos("_w").alias("_c_re"), F.sin("_w").alias("_c_im")]
    mirrored = odd.where("idx > 0").select(*keys, (F.col("size") - F.col("idx")).alias("idx"), "size", *[F.lit(0.0).alias(c) for c in _parts(values)], *chirp)
    there = fourier(odd.select(*keys, "idx", "size", *bent, *chirp).unionByName(mirrored), keys, [*values, "_c"], block=block)
    products = [c for v in values for c in zip(times(v, "_c"), (f"{v}_re", f"{v}_im"), strict=True)]
    back = fourier(there.select(*keys, "size", "idx", *[c.alias(name) for c, name in products]), keys, values, inverse=True, block=block)
    back = back.join(lengths, keys).where("idx < n").withColumn("_w", angle("idx")).withColumns({"_c_re": F.cos("_w"), "_c_im": -F.sin("_w")})
    turned = [(c / F.col("size")).alias(name) for v in values for c, name in zip(times(v, "_c"), (f"{v}_re", f"{v}_im"), strict=True)]
    return plain.unionByName(back.select(*keys, F.col("idx").alias("bin"), "n", *turned))

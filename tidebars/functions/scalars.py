"""Column expressions: cleaning, dates, text and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column | str) -> Column:
    """NaN and NULL both become NULL, so comparisons are never true for them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def normalize_symbol(market: Column, code: Column) -> Column:
    """Exchange symbol of a local code; a blank code raises."""
    bare = F.trim(code)
    cn = F.concat(code, F.when(F.substring(code, 1, 1) == "6", ".SS").otherwise(".SZ"))
    hk = F.concat(F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code), F.lit(".HK"))
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", F.raise_error(F.lit("empty ticker code")))
        .when(market == "CN", cn)
        .when(market == "HK", hk)
        .otherwise(F.upper(code))
    )


def category_of(name: Column) -> Column:
    return (
        F.when(name.endswith("_DP"), "dual")
        .when(name.endswith("_QS"), "quick")
        .otherwise("single")
    )


def wall_clock(ts: Column, zone: Column | str | None = None) -> Column:
    """Drop the zone and keep the local clock reading."""
    if zone is not None:
        ts = F.from_utc_timestamp(ts, zone)
    return ts.cast("timestamp_ntz")


def text_wall_clock(text: Column) -> Column:
    """ISO text with or without an offset to its local clock reading."""
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.regexp_replace(bare, "T", " ").cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def clock_micros(ts: Column) -> Column:
    """Microseconds since 1970 as the clock on the wall shows them: the session's time
    zone and its summer time play no part."""
    t = ts.cast("timestamp_ntz")
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return days * 86_400_000_000 + (F.hour(t).cast("long") * 60 + F.minute(t)) * 60_000_000 + second


def start_of(unit: str, ts: Column) -> Column:
    """Start of the minute, hour, day, week (Monday), month, quarter or year on the wall
    clock."""
    t = ts.cast("timestamp_ntz")
    second = F.date_part(F.lit("SECOND"), t)
    if unit == "minute":
        return t - F.make_dt_interval(secs=second)
    if unit == "hour":
        return t - F.make_dt_interval(mins=F.minute(t), secs=second)
    day = F.to_date(t)
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def julian_day(ts: Column) -> Column:
    """Julian day number with fraction."""
    return clock_micros(ts) / F.lit(86_400_000_000.0) + F.lit(2_440_587.5)


def minus_days(ts: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return ts - F.make_dt_interval(days=days)


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def fixed4(c: Column) -> Column:
    """Four decimals as text without grouping, rounded half even on the exact
    decimal expansion like C formatting."""
    return F.format_string("%.4f", c)


def net_position(higher: Column, lower: Column) -> Column:
    """Follow the lower signal without a higher one, hold in full when both
    agree and half the higher position when they do not."""
    return (
        F.when(higher == 0, lower.cast("double"))
        .when(higher == lower, higher.cast("double"))
        .otherwise(higher * F.lit(0.5))
    )


def poly_at(a: Column, b: Column, c: Column, x0: Column, x: Column) -> Column:
    """Parabola value; ``x0`` NULL means that x is measured from zero."""
    d = x - F.coalesce(x0, F.lit(0.0))
    return (a * d + b) * d + c

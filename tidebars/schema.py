"""Schemas, the timeframe dimension and the schema check used on ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEYS = ["ticker", "timeframe"]

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

TICKS = T.StructType(
    [
        T.StructField("tick_id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

# Timeframe code, rank, next higher code, expected days between
# bars (None: gaps are not checked), look-back in days (None: keep all).
TIMEFRAMES = [
    ("1m", 0, "5m", 1 / 1440, 7),
    ("5m", 1, "15m", 5 / 1440, 60),
    ("15m", 2, "60m", 15 / 1440, 60),
    ("60m", 3, "1d", 1 / 24, 730),
    ("1d", 4, "1wk", 1.0, None),
    ("1wk", 5, "1mo", None, None),
    ("1mo", 6, "3mo", None, None),
    ("3mo", 7, None, None, None),
]

# Labels used in stored parameter files.
TIMEFRAME_LABELS = {
    "1分钟": "1m", "5分钟": "5m", "15分钟": "15m", "60分钟": "60m",
    "日线": "1d", "周线": "1wk", "月线": "1mo", "季线": "3mo",
}


def tf_dim(spark: SparkSession) -> DataFrame:
    """The eight-row timeframe dimension; small enough to broadcast anywhere."""
    return spark.createDataFrame(
        TIMEFRAMES,
        "timeframe string, rank int, higher_tf string, expected_days double, lookback_days int",
    )


def validate_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Return ``df`` with exactly the columns of ``schema``; raise when one is
    missing or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: {'missing' if f.name not in have else have[f.name].simpleString()}"
        f", expected {f.dataType.simpleString()}"
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    if problems:
        raise ValueError("schema mismatch: " + "; ".join(problems))
    return df.select(*schema.fieldNames())

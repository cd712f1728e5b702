"""Column expressions and small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that separates words, and the words themselves.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_column(text: str) -> Column:
    """The text; a missing one is empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def keyed_texts(sets: DataFrame, key: str, text: str) -> DataFrame:
    """Only key and text, so other columns of ``sets`` can have any name."""
    return sets.select(F.col(f"`{key}`").alias("key"), text_column(text).alias("text"))


def boxed(sets: DataFrame, text: str) -> DataFrame:
    """The whole row as one struct beside its text: columns an operator adds
    meanwhile can't clash with the row's own."""
    return sets.select(F.struct(*[F.col(f"`{c}`") for c in sets.columns]).alias("row"), text_column(text).alias("text"))


def held(c: Column) -> Column:
    """The value as it is, computed once: what uses it, a filter further up too, can't
    have the expression put in its place, where a function over an array would compute
    it for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, c)

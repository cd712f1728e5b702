"""Series layout: row index, bounded chunks with halo rows, bucketed scans.

A series is a set of rows with equal ``keys``. No operator sorts or collects a
whole series in one task: rows are cut into chunks of ``CHUNK_ROWS`` (or into
calendar buckets), what crosses a cut is either copied there (halo) or carried
over as one summary row per chunk (scan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.scalars import start_of
from tidebars.schema import KEYS

CHUNK_ROWS = 65_536


def with_index(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "ts",
               bucket: str = "month") -> DataFrame:
    """Add ``idx`` (0, 1, ...) and ``n``, the length of the series.

    Rows are numbered inside calendar buckets; the bucket offsets come from a
    count per bucket. A bar series holds at most one row per step of its
    timeframe, so a month has at most 44,640 rows. Choose a finer ``bucket``
    for denser input.
    """
    keys = list(keys)
    df = df.withColumn("_bucket", start_of(bucket, F.col(order)))
    span = Window.partitionBy(*keys)
    before = span.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        df.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("n", F.sum("_rows").over(span))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        df.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(counts, [*keys, "_bucket"])
        .withColumn("idx", (F.col("_start") + F.col("_pos")).cast("long"))
        .drop("_bucket", "_pos", "_start")
    )


def index_bounded(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """``idx`` and ``n`` for input whose series are known to be short, such as
    the result of ``latest_n``."""
    span = Window.partitionBy(*keys)
    return df.withColumn("n", F.count(F.lit(1)).over(span.orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).withColumn(
        "idx", (F.row_number().over(span.orderBy(order)) - 1).cast("long"))


def chunked(df: DataFrame, before: int = 0, after: int = 0,
            chunk_rows: int | None = CHUNK_ROWS, mirror: int = 0) -> DataFrame:
    """Assign every row to its chunk and copy border rows to the neighbours
    that look up to ``before`` rows back or ``after`` rows ahead. Copies have
    ``core`` = false. ``mirror`` adds that many reflected rows beyond both ends
    of the series (index -1 repeats row 0, and so on). ``chunk_rows`` None says
    that every series is short enough for one chunk, see ``chunk_limit``."""
    if not mirror and chunk_rows is None:
        return df.withColumns({"chunk": F.lit(0).cast("long"), "core": F.lit(True)})
    place = F.col("idx")
    if mirror:
        inside = (F.col("idx") >= mirror) & (F.col("idx") < F.col("n") - mirror)
        turns = F.floor(F.lit(mirror).cast("long") / (F.col("n") * 2)).cast("long") + 1
        folded = F.flatten(F.transform(
            F.sequence(-turns, turns),
            lambda k: F.array(F.col("idx") + k * F.col("n") * 2,
                              F.col("n") * 2 - 1 - F.col("idx") + k * F.col("n") * 2),
        ))
        folded = F.filter(folded, lambda p: (p >= -mirror) & (p < F.col("n") + mirror))
        df = df.withColumn("_place", F.explode(F.when(inside, F.array("idx")).otherwise(folded)))
        place = F.col("_place")
    if chunk_rows is None:
        return df.withColumns({"chunk": F.lit(0).cast("long"), "core": place == F.col("idx"), "idx": place}).drop("_place")
    c = F.lit(chunk_rows).cast("long")
    last = F.expr(f"(n - 1) div {chunk_rows}")
    first_use = F.greatest(F.lit(0).cast("long"), F.floor((place - after) / c).cast("long"))
    last_use = F.least(last, F.floor((place + before) / c).cast("long"))
    uses = F.sequence(F.least(first_use, last), F.greatest(last_use, F.lit(0).cast("long")))
    return (
        df.withColumn("chunk", F.explode(uses))
        .withColumns({
            "core": (place == F.col("idx")) & (F.col("chunk") == F.floor(F.col("idx") / c)),
            "idx": place,
        })
        .drop("_place")
    )


def chunk_limit(df: DataFrame, chunk_rows: int | None = CHUNK_ROWS) -> int | None:
    """``chunk_rows`` when some series is longer, else None: then nothing has to
    be carried between chunks. One small action; hand in a stored table."""
    if chunk_rows is None or df.select("n").where(F.col("n") > chunk_rows).isEmpty():
        return None
    return chunk_rows


def in_chunk(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys, "chunk").orderBy("idx")


def core_rows(df: DataFrame) -> DataFrame:
    return df.where("core").drop("chunk", "core")


# How a local running value and the value carried from earlier buckets combine.
_JOINED = {
    "last": lambda carried, local: F.coalesce(local, carried),
    "max": lambda carried, local: F.greatest(local, carried),
    "sum": lambda carried, local: F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)),
    "product": lambda carried, local: F.coalesce(local, F.lit(1.0)) * F.coalesce(carried, F.lit(1.0)),
}


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"max": F.max, "sum": F.sum, "product": F.product}[kind](value).over(window)


def _total(kind: str, value: Column, order: Column, reverse: bool) -> Column:
    if kind == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(value, F.when(value.isNotNull(), order))
    return {"max": F.max, "sum": F.sum, "product": F.product}[kind](value)


def scan(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence[str],
         outs: dict[str, tuple[str, Column, bool]], reverse: bool = False) -> DataFrame:
    """Running values over whole series, in bounded tasks.

    ``outs`` maps an output column to (kind, value, exclusive) with kind
    ``last`` (last non-null value), ``max``, ``sum`` or ``product``; exclusive
    leaves the current row out. ``reverse`` runs from the end of the series.
    Each bucket is scanned on its own, one summary row per bucket is carried
    to the later ones and joined back, so ``df`` is read twice (only the
    columns that the summary needs the second time): hand in a stored table.
    Without a ``bucket`` (series known to be short) there is nothing to carry.
    """
    keys = list(keys)
    turn = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    if bucket is None:
        whole = Window.partitionBy(*keys).orderBy(*[turn(c) for c in order])
        return df.withColumns({
            name: _JOINED[kind](F.lit(None), _over(kind, value, whole.rowsBetween(
                Window.unboundedPreceding, -1 if exclusive else Window.currentRow)))
            for name, (kind, value, exclusive) in outs.items()})
    df = df.withColumn("__bucket", bucket)
    local = Window.partitionBy(*keys, "__bucket").orderBy(*[turn(c) for c in order])
    across = Window.partitionBy(*keys).orderBy(turn("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*[F.col(c) for c in order])
    totals = df.groupBy(*keys, "__bucket").agg(
        *[_total(kind, value, rank, reverse).alias(f"_t_{name}") for name, (kind, value, _) in outs.items()]
    )
    carried = totals.select(
        *keys, "__bucket",
        *[_over(kind, F.col(f"_t_{name}"), across).alias(f"_c_{name}") for name, (kind, _, _) in outs.items()],
    )
    df = df.withColumns({
        f"_l_{name}": _over(kind, value, local.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow))
        for name, (kind, value, exclusive) in outs.items()})
    joined = df.join(carried, [*keys, "__bucket"]).withColumns({
        name: _JOINED[kind](F.col(f"_c_{name}"), F.col(f"_l_{name}")) for name, (kind, _, _) in outs.items()})
    return joined.drop("__bucket", *[f"_{p}_{name}" for name in outs for p in "lc"])


def seen_only(df: DataFrame, keys: Sequence[str], seen: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows for which ``seen`` holds, numbered anew in ``idx`` and ``n``; the old
    number is kept as ``_row``. Read twice, so hand in a stored table."""
    keys = list(keys)
    rows = df.where(seen).withColumn("__bucket", chunk_of(chunk_rows=chunk_rows))
    span = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("_rows")).withColumns({
        "_start": F.coalesce(F.sum("_rows").over(span.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("_rows").over(span)}).drop("_rows")
    place = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy("idx")) - 1
    return (rows.drop("n").withColumn("_pos", place).join(counts, [*keys, "__bucket"])
            .withColumns({"_row": F.col("idx"), "idx": (F.col("_start") + F.col("_pos")).cast("long")})
            .drop("_pos", "_start", "__bucket"))


def chunk_of(idx: str = "idx", chunk_rows: int | None = CHUNK_ROWS) -> Column | None:
    return None if chunk_rows is None else F.floor(F.col(idx) / F.lit(chunk_rows)).cast("long")

"""Merkle manifest of stored rows: leaves by row, subroots by series, one root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.schema import BARS, KEYS
from tidebars.sources.storage import materialize

FAN_OUT = 16


def leaf_digest(fields: Sequence[Column | str]) -> Column:
    """SHA-256 (lower-case hex) of the fields one after the other, each as its length in
    bytes, a colon and the value as text; ``-`` if it is missing."""
    def told(field: Column | str) -> Column:
        value = (F.col(f"`{field}`") if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[told(f) for f in fields]), 256)


def proof_digest(path: Column | str) -> Column:
    """Digest of the siblings along a path, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded_root(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf leads to with the siblings of a path."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``tree`` (a number that follows the order of ``series``), ``pos`` and ``n`` (place in
    the series and its length) for rows with a struct ``series``. Rows are dealt by ranges,
    so a series of any length spans as many tasks as it needs; each range is counted and
    only these counts are added up along a series."""
    keys = ["series", *order, "_seen"]
    dealt = rows.withColumn("_seen", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(dealt.drop("_seen", *order).withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy("series", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy("series")
    starts = counts.select("series", "_part", "_first",
                           F.coalesce(F.sum("_rows").over(along.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                           F.sum("_rows").over(along).alias("n"), F.min("_first").over(along).alias("tree"))
    return placed.withColumn("_part", part).join(starts, ["series", "_part"]).withColumn(
        "pos", F.col("_at") - F.col("_first") + F.col("_start")).drop("_part", "_at", "_first", "_start")


def _with_siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """``before`` and ``after``: the digests of a node's run left and right of it."""
    slots = nodes.withColumns({"run": F.floor(F.col("pos") / fan_out), "_slot": F.col("pos") % fan_out})
    sized = slots.withColumn("_size", F.least(F.lit(fan_out).cast("long"), F.col("n") - F.col("run") * fan_out))
    # Written as SQL: thirty windows take the driver a second each time as objects.
    over = "OVER (PARTITION BY tree, run ORDER BY pos)"
    left = ", ".join(f"CASE WHEN _slot >= {k} THEN lag(h, {k}) {over} END" for k in range(fan_out - 1, 0, -1))
    right = ", ".join(f"CASE WHEN _slot + {k} < _size THEN lead(h, {k}) {over} END" for k in range(1, fan_out))
    return sized.selectExpr("*", f"concat_ws('', {left}) AS before", f"concat_ws('', {right}) AS after").drop("_size")


def _climb(leaves: DataFrame, fan_out: int) -> list[DataFrame]:
    """Nodes (``tree, n, pos, h``) level by level until every tree has ended in one node."""
    levels = [leaves]
    longest = leaves.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        grown = _with_siblings(levels[-1].where("n > 1").select("tree", "n", "pos", "h"), fan_out).where("_slot = 0")
        levels.append(materialize(grown.select("tree", F.ceil(F.col("n") / fan_out).alias("n"), F.col("run").alias("pos"),
                                               F.sha2(F.concat("h", "after"), 256).alias("h")), "level"))
        longest = -(-longest // fan_out)
    return levels


def _ends(levels: list[DataFrame]) -> DataFrame:
    """The last node of every tree with its level."""
    found = None
    for k, nodes in enumerate(levels):
        own = nodes.where("n = 1").select("tree", F.lit(k).alias("level"), "h")
        found = own if found is None else found.unionByName(own)
    return found


def _descend(levels: list[DataFrame], ends: DataFrame, carried: Sequence[str], fan_out: int) -> DataFrame:
    """Level 0 with ``path``: siblings of the node, of its parent and so on, then what
    ``ends`` (``tree, level, path`` and ``carried``) holds for the tree's last node."""
    above = None
    for k in reversed(range(len(levels))):
        up = ends.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("run"), "path", *carried)
        if above is not None:
            up = up.unionByName(above.select("tree", F.col("pos").alias("run"), "path", *carried))
        nodes = _with_siblings(levels[k], fan_out).join(up, ["tree", "run"])
        own = F.concat(F.array(F.struct("before", "after")), "path")
        above = nodes.withColumn("path", F.when(F.col("n") > 1, own).otherwise(F.col("path"))).drop("before", "after", "run", "_slot")
        if k:
            above = materialize(above.select("tree", "pos", "path", *carried), "paths")
    return above


def merkle_manifest(bars: DataFrame, fields: Sequence[str] = tuple(BARS.fieldNames()), series: Sequence[str] = tuple(KEYS),
                    order: Sequence[str] = ("ts",), keep: Sequence[str] = (*KEYS, "ts"), fan_out: int = FAN_OUT) -> DataFrame:
    """Manifest of stored bars: one row per bar with ``row`` (a struct of the columns
    ``keep``), ``leaf``, ``subroot``, ``root`` and ``path``.

    A leaf is the digest of ``fields`` (``leaf_digest``). The leaves of a series ascend by
    ``order``; while it has several nodes, every ``fan_out`` consecutive ones (the last run
    may be shorter, down to one) become the digest of their digests. What remains is the
    series' ``subroot``, a lone leaf itself; subroots in the order of ``series`` give the
    ``root`` in the same way. ``path`` has a struct (``before``, ``after``) of sibling digests
    per level up to the root, which ``folded_root`` and ``proof_digest`` read: whoever holds one
    bar and its path can check it against the root alone.

    Per level, lag and lead columns at fixed offsets, masked by a node's slot and its run's
    length, give the siblings, and first children hash their parents. Only digests and
    ``keep`` are shuffled. A missing value of ``series`` is a series of its own and comes
    first, as missing values of ``order`` do; bars with equal order ascend by leaf and
    equal bars each have a place of their own. An empty table gives no rows. Other columns
    may have any names. Texts compare by their UTF-8 bytes. Any other table will do, if the four
    column lists are given.
    """
    named = lambda cs: F.struct(*[F.col(f"`{c}`") for c in cs]) if cs else F.struct(F.lit(0).alias("_"))
    rows = bars.select(named(series).alias("series"), named(order).alias("_order"), leaf_digest(fields).alias("h"), named(keep).alias("row"))
    rows = rows.withColumn("_leaf", F.col("h"))
    levels = _climb(_numbered(rows, ["_order", "_leaf"]).drop("series"), fan_out)
    tops = _ends(levels).select(F.struct(F.lit(0)).alias("series"), "tree", "level", "h").withColumns({"_order": F.col("tree"), "member": F.struct("tree", "level")}).drop("tree", "level")
    uppers = _climb(_numbered(tops, ["_order"]).drop("series"), fan_out)
    root = _ends(uppers).select("tree", "level", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("h").alias("root"))
    ends = _descend(uppers, root, ["root"], fan_out).select("member.tree", "member.level", "path", F.col("h").alias("subroot"), "root")
    ends = materialize(ends, "ends")
    return _descend(levels, ends, ["subroot", "root"], fan_out).select("row", F.col("h").alias("leaf"), "subroot", "root", "path")

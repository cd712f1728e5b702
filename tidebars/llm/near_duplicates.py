"""Near-duplicates: SimHash fingerprints, deletion variants, connected classes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.llm.texts import keyed_texts, text_column
from tidebars.sources.storage import materialize

SHINGLE = 3
SEED = 42
# Runs of one variant up to this many different fingerprints are compared directly.
DIRECT = 2048
_AT_ONCE = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' hashes at each bit, as a signed number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        part = words[at:min(at + _AT_ONCE, n) + shingle - 1] if n > 1 else words
        rows = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*[part[k:] for k in range(shingle)], strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in rows), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(sets: DataFrame, key: str = "name", text: str = "description", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fingerprint`` (64 bits as a long) of every text; missing texts
    are empty, and an empty text has the fingerprint zero."""
    rows = keyed_texts(sets, key, text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), prints], names=["key", "fingerprint"])

    schema = T.StructType([rows.schema["key"], T.StructField("fingerprint", T.LongType())])
    return rows.mapInArrow(each, schema).withColumnRenamed("key", key)


def _first_variants(prints: DataFrame) -> DataFrame:
    """64 rows a fingerprint: segment, deleted bit and the rest of the segment in one
    number. Two fingerprints at two bits or fewer differ by at most one bit in one of
    the two segments, so they share a variant."""
    segment = lambda s: F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    keys = [segment(s).bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << i)).cast("long")).bitwiseOR(F.lit((s << 37) | (i << 32)).cast("long"))
            for s in (0, 1) for i in range(32)]
    return prints.select(F.explode(F.array(*keys)).alias("k"), F.lit(0).cast("long").alias("m"), "fp")


def _finer_variants(hot: DataFrame, level: int) -> DataFrame:
    """Variants of what the coarser variant leaves open: 32 bits at level 2, cut into
    halves of 16; 16 bits at level 3, cut into halves of 8."""
    bits = 16 if level == 2 else 8
    mask = (1 << bits) - 1
    rest = F.when(F.shiftright("k", 37) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    if level == 3:
        lower = F.shiftright("m", 20).bitwiseAND(F.lit(1).cast("long")) == 0
        rest = F.when(lower, F.shiftrightunsigned(rest, 16)).otherwise(rest).bitwiseAND(F.lit(0xFFFF).cast("long"))
    width = bits + (4 if level == 2 else 3)
    keys = [F.shiftrightunsigned("rest", bits * h).bitwiseAND(F.lit(mask & ~(1 << i)).cast("long"))
            .bitwiseOR(F.lit((h << width) | (i << bits)).cast("long")) for h in (0, 1) for i in range(bits)]
    finer = hot.select("k", "m", "fp", rest.alias("rest"))
    return finer.select("k", F.shiftleft("m", width + 1).alias("m0"), "fp", F.explode(F.array(*keys)).alias("v")).select(
        "k", F.col("m0").bitwiseOR(F.col("v")).alias("m"), "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what earlier links have not joined yet."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def _compare(k: np.ndarray, run: np.ndarray, left: np.ndarray, fp: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links within runs. ``left``: rows of the run from here on. A link whose segment
    is equal counts at the first variant only."""
    a: list[int] = []
    b: list[int] = []
    for d in range(1, int(left.max(initial=1))):
        i = np.flatnonzero(left > d)
        x = fp[i] ^ fp[i + d]
        hit = np.bitwise_count(x.view(np.uint64)) <= bits
        i, x = i[hit], x[hit].view(np.uint64)
        if len(i):
            seg, bit = (k[i] >> 37).astype(np.uint64), ((k[i] >> 32) & 31).astype(np.uint64)
            part = (x >> (seg * np.uint64(32))) & np.uint64(0xFFFFFFFF)
            first = (part == (np.uint64(1) << bit)) | ((part == 0) & (bit == 0))
            p, q = _forest(fp[i[first]], fp[i[first] + d])
            a += p
            b += q
    return _forest(np.array(a, np.int64), np.array(b, np.int64)) if a else (a, b)


def _walk(batches: Iterable[pa.RecordBatch], bits: int, direct: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by variant, run by run: links of short runs, rows of long ones. At
    most a batch and a short run are held."""
    kept = [np.empty(0, np.int64)] * 3
    hot = None

    def rows(kind: int, k, m, a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(x, pa.int64()) for x in (k, m, a, b)]], names=["kind", "k", "m", "a", "b"])

    def ended(k, m, f) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
        sizes = np.diff(np.r_[starts, len(k)])
        run = np.repeat(np.arange(len(starts)), sizes)
        long = sizes[run] > direct
        if long.any():
            yield rows(1, k[long], m[long], f[long], f[long])
        small = ~long & (sizes[run] > 1)
        if small.any():
            left = (starts + sizes)[run] - np.arange(len(k))
            p, q = _compare(k[small], run[small], left[small], f[small], bits)
            if p:
                zero = np.zeros(len(p), np.int64)
                yield rows(0, zero, zero, p, q)

    for b in batches:
        k, m, f = (np.concatenate([old, b.column(c).to_numpy(zero_copy_only=False)]) for c, old in enumerate(kept))
        if hot is not None:
            same = (k == hot[0]) & (m == hot[1])
            if same.any():
                yield rows(1, k[same], m[same], f[same], f[same])
            k, m, f = k[~same], m[~same], f[~same]
        if not len(k):
            kept = [k, m, f]
            continue
        change = np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1]))
        at = int(change[-1]) + 1 if len(change) else 0
        yield from ended(k[:at], m[:at], f[:at])
        kept = [k[at:], m[at:], f[at:]]
        if len(kept[0]) > direct:
            hot = (kept[0][0], kept[1][0])
            yield rows(1, kept[0], kept[1], kept[2], kept[2])
            kept = [x[:0] for x in kept]
    yield from ended(*kept)


def links(prints: DataFrame, bits: int = 2, direct: int = DIRECT) -> DataFrame:
    """Links (``a``, ``b``) between different fingerprints (column ``fp``, no row twice)
    that connect exactly those that chains of links at ``bits`` or fewer differing bits
    connect; of links within one run only as many as connect it are listed.

    A variant that over ``direct`` fingerprints share is cut further by variants of the
    bits it leaves open. After three cuts 11 bits are open, so a run has at most 2,048
    fingerprints and is compared directly. No link is lost and no group multiplied out.
    """
    if not 0 <= bits <= 2:
        raise ValueError("two segments cover two differing bits at most")
    found = None
    rows = _first_variants(prints)
    for level in (1, 2, 3):
        most = direct if level < 3 else 1 << 62
        part = rows.repartition("k", "m").sortWithinPartitions("k", "m", "fp").mapInArrow(
            lambda batches, most=most: _walk(batches, bits, most), "kind int, k long, m long, a long, b long")
        part = materialize(part, "variants")
        own = part.where("kind = 0").select("a", "b")
        found = own if found is None else found.unionByName(own)
        hot = part.where("kind = 1").select("k", "m", F.col("a").alias("fp"))
        if level == 3 or hot.isEmpty():
            return found.distinct()
        rows = _finer_variants(hot, level + 1)
    return found


def classes(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its class) for every node of ``edges``
    (``a``, ``b``): large and small stars until nothing changes. A star's centre only
    receives minima, so classes of any size pass; each round is a written table."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now


def near_duplicates(sets: DataFrame, key: str = "name", text: str = "description", shingle: int = SHINGLE, bits: int = 2,
                    direct: int = DIRECT) -> DataFrame:
    """Class of every parameter set's description.

    One row per input row: ``key``, ``fingerprint`` (long) and ``component`` (smallest
    key of the class; keys that are missing count last). Fingerprints link at ``bits``
    or fewer differing bits, and classes are what chains of links connect. Missing
    and empty texts have the fingerprint zero and link like any other; shorter texts
    than ``shingle`` words count as one shingle; other columns are left out.
    """
    prints = materialize(fingerprints(sets, key, text, shingle).select(F.col(f"`{key}`").alias("key"), F.col("fingerprint").alias("fp")), "prints")
    each = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")), "each")
    roots = classes(links(each.select("fp"), bits, direct)).withColumnRenamed("node", "fp")
    placed = each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(least, "root").select("fp", "component")
    return prints.join(named, "fp").select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component")


def keep_one(sets: DataFrame, key: str = "name", text: str = "description", find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """``sets`` with one row of each class that ``find`` gives: the one with the smallest
    key, then the smallest hash of its text; of rows with equal keys and texts any one."""
    identity = F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(text_column(text)).alias("hash"))
    found = find(sets.select(identity.alias("name"), text_column(text).alias("description")), **options)
    stay = found.where(F.col("name") == F.col("component")).select(
        F.col("name.key").alias("_stay_key"), F.col("name.hash").alias("_stay_hash")).distinct()
    rows = sets.select(F.struct(*[F.col(f"`{c}`") for c in sets.columns]).alias("row"), F.col(f"`{key}`").alias("_key"), F.xxhash64(text_column(text)).alias("_hash"))
    kept = rows.join(stay, F.col("_key").eqNullSafe(F.col("_stay_key")) & (F.col("_hash") == F.col("_stay_hash")), "left_semi")
    one = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_key", "_hash"))
    return kept.withColumn("_one", one).where("_one = 1").select("row.*")

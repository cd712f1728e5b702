"""Best-fit packing of tokenised texts by exact complements."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.llm.texts import keyed_texts
from tidebars.sources.storage import materialize

LENGTH = 2048
END = 0
_ROWS_AT_ONCE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks_path: str, pattern: str, special: dict[str, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=special)


def pieces(sets: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], key: str = "name", text: str = "description",
           length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of at most ``length`` tokens: ``key, piece, start, length, ids_crc32``.

    A text's ids, then ``end``. Longer ones are cut into pieces of ``length``, the first
    may be shorter. The strings of ``special`` in a text are their own ids. Missing
    texts are empty and have one piece of one token. Files are read on the executors
    from ``ranks_path``.
    """
    rows = keyed_texts(sets, key, text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern, special)
        for b in batches:
            at, starts, sizes, sums, number = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.append(enc.encode_to_numpy(t.as_py(), allowed_special="all"), end).astype("<u4")
                first = len(ids) % length or length
                for k, start in enumerate([0, *range(first, len(ids), length)]):
                    stop = min(start + length, len(ids)) if k else min(first, len(ids))
                    at.append(i)
                    number.append(k)
                    starts.append(start)
                    sizes.append(stop - start)
                    sums.append(zlib.crc32(ids[start:stop].tobytes()))
            keys = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, sizes, sums)]],
                                             names=["key", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([rows.schema["key"], T.StructField("piece", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    return rows.mapInArrow(each, schema).withColumnRenamed("key", key)


def _pair(left: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two available lengths with this sum, the longest one possible first."""
    if total < 2:
        return None
    a = np.arange(total // 2, total)  # the longer of the two
    b = total - a
    ok = (a >= b) & (b > 0) & (left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1))
    hit = np.flatnonzero(ok)
    return (int(a[hit[-1]]), int(b[hit[-1]])) if len(hit) else None


def _filling(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with exactly this sum."""
    if left[gap] > 0:
        return [gap]
    two = _pair(left, gap)
    if two:
        return list(two)
    # Sums of two available lengths; a triple is a length whose rest is such a sum.
    for a in np.flatnonzero(left[1:gap - 1])[::-1] + 1:
        left[a] -= 1
        two = _pair(left, gap - int(a)) if gap - a <= 2 * a else None
        left[a] += 1
        if two:
            return [int(a), *two]
    return None


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, how many of them), from how many pieces have each length.

    Longest first, each piece's gap is filled exactly by one, two or three lengths in
    stock, as often as stock allows; what has no exact filling goes, longest first,
    into the fullest sequence that holds it. Work and result are bounded by
    ``length``, not by the number of pieces: a step uses up a length or a kind of
    sequence.
    """
    left = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    done: list[tuple[list[int], int]] = []
    for size in range(length, 0, -1):
        while left[size]:
            left[size] -= 1
            rest = _filling(left, length - size) if size < length else []
            left[size] += 1
            if rest is None:
                break
            kind = [size, *rest]
            need = {s: kind.count(s) for s in kind}
            times = min(int(left[s]) // n for s, n in need.items())
            for s, n in need.items():
                left[s] -= n * times
            done.append((kind, times))
    kinds: dict[int, list[tuple[list[int], int]]] = {}  # by gap
    for size in range(length, 0, -1):
        n = int(left[size])
        while n:
            gap = min((g for g, k in kinds.items() if g >= size and k), default=None)
            if gap is None:
                fit = length // size  # new sequences of this length only
                full, more = divmod(n, fit)
                for m, times in ((fit, full), (more, 1)):
                    if m and times:
                        kinds.setdefault(length - m * size, []).append(([size] * m, times))
                n = 0
            else:
                kind, times = kinds[gap].pop()
                m = min(gap // size, max(1, n // times))
                use = min(times, n // m)
                if use < times:
                    kinds[gap].append((kind, times - use))
                kinds.setdefault(gap - m * size, []).append((kind + [size] * m, use))
                n -= m * use
    return done + [k for v in kinds.values() for k in v]


def _slots(kinds: list[tuple[list[int], int]]) -> np.ndarray:
    """Columns (length, first rank, offset, first sequence), by length and rank: the
    pieces of a length, numbered, take the places for it in turn."""
    taken: dict[int, int] = {}
    out, first = [], 0
    for kind, times in kinds:
        offset = 0
        for size in kind:
            out.append((size, taken.get(size, 0), offset, first))
            taken[size] = taken.get(size, 0) + times
            offset += size
        first += times
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, key: str = "name", length: int = LENGTH) -> DataFrame:
    """``cut`` (``key, piece, length`` and more) with ``sequence_id`` and ``offset``.

    Only how many pieces have each length, ``length`` numbers at most, passes the
    driver. Pieces are numbered within their length in buckets plus a prefix over
    bucket counts, so a length that a third of all pieces have is no single group.
    Repeated rows are pieces of their own.
    """
    cut = materialize(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = _slots(plan(counts, length))
    buckets = sum(counts.values()) // _ROWS_AT_ONCE + 1
    place = cut.withColumn("_bucket", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece"), F.lit(buckets)))
    sizes = place.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(F.col(f"`{key}`"), "piece")) - 1
    ranked = place.withColumn("_own", own).join(before, ["length", "_bucket"]).select(
        *cut.columns, (F.col("_own") + F.col("_before")).alias("_rank"))
    names = cut.columns
    at_length = names.index("length")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One number orders (length, rank): ranks stay below 2**44.
        order = (slots[:, 0] << 44) | slots[:, 1]
        for b in batches:
            size, rank = b.column(at_length).to_numpy(), b.column(len(names)).to_numpy()
            s = slots[np.searchsorted(order, (size << 44) | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 2])], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(each, schema)


def pack_sets(sets: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], key: str = "name", text: str = "description",
              length: int = LENGTH, end: int = END) -> DataFrame:
    """Parameter sets' descriptions, tokenised, in as few sequences of ``length`` tokens
    as the method finds: ``key, piece, start, length, ids_crc32, sequence_id, offset``.
    An empty table gives no rows; other columns are left out."""
    return pack(pieces(sets, ranks_path, pattern, special, key, text, length, end), key, length)

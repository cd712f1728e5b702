"""Nearest vectors by a block matrix join."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.sources.storage import materialize

NEAREST = 5
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
# Products of 8-bit numbers are summed exactly in single precision over so many columns.
_EXACT_COLUMNS = 1024
_PAIRS_AT_ONCE = 1 << 18


def usable(vector: str) -> Column:
    """Neither missing nor zero, all components there and finite."""
    v = F.col(f"`{vector}`")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each: squares stay in range, no component is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit numbers, the scale of each row, and how far each unit row is off at most."""
    unit = _scaled(x)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    off = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q, scale, off


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for c in range(0, a.shape[1], _EXACT_COLUMNS):
        out += a[:, c:c + _EXACT_COLUMNS].astype(np.float32) @ b[:, c:c + _EXACT_COLUMNS].T.astype(np.float32)
    return out


def _tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of ``c`` to each of ``q``: (query row, candidate row, score).

    A product of 8-bit rows differs from that of the unit rows by the rows' errors at
    most. A pair stays if its upper bound reaches the k-th largest lower bound; the
    scores of these are computed anew in double precision.
    """
    q8, qs, qe = quantised(q)
    c8, cs, ce = quantised(c)
    near = _product(q8, c8) * (qs[:, None] * cs)
    bound = qe[:, None] * (1 + ce) + ce
    near[qid[:, None] == cid] = -np.inf
    low = near - bound
    floor = np.partition(low, max(low.shape[1] - k, 0), axis=1)[:, max(low.shape[1] - k, 0)] if low.shape[1] > k else np.full(len(q), -np.inf)
    a, b = np.nonzero((near + bound >= floor[:, None]) & (near > -np.inf))
    score = np.concatenate([np.empty(0), *[cosine(q[a[s:s + _PAIRS_AT_ONCE]], c[b[s:s + _PAIRS_AT_ONCE]]) for s in range(0, len(a), _PAIRS_AT_ONCE)]])
    order = np.lexsort((cid[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k
    return a[keep], b[keep], score[keep]


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def _tiles(table: pa.Table, k: int) -> pa.Table:
    """One group: a block of queries and a block of candidates."""
    empty = pa.table({"query": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    is_query = table.column("is_query").to_numpy()
    ids, x = table.column("id").to_numpy(), table.column("v").combine_chunks()
    q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    if not len(q) or not len(c):
        return empty
    cx = _matrix(x.take(pa.array(c)))
    # Of equal vectors only the k + 1 with the smallest ids can be among the nearest.
    order = np.argsort(ids[c], kind="stable")
    c, cx = c[order], np.ascontiguousarray(cx[order])
    _, back = np.unique(cx.view(np.dtype((np.void, cx.itemsize * cx.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(back, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by)) - np.searchsorted(back[by], back[by])
    c, cx = c[place <= k], cx[place <= k]
    out = []
    for s in range(0, len(q), 1024):
        part = q[s:s + 1024]
        a, b, score = _tile(ids[part], _matrix(x.take(pa.array(part))), ids[c], cx, k)
        out.append((ids[part][a], ids[c][b], score))
    a, b, score = (np.concatenate(z) for z in zip(*out, strict=True))
    return pa.table({"query": a, "found": b, "score": score})


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by query: a heap keeps the k best of each."""
    query, heap = None, []
    out: list[tuple] = []

    def told() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                                          names=["query", "rank", "found", "score"])

    def end() -> None:
        out.extend((query, i + 1, -n, s) for i, (s, n) in enumerate(sorted(heap, reverse=True)))

    for b in batches:
        for qid, found, score in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            if qid != query:
                end()
                query, heap = qid, []
            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -found))
        if len(out) > 10_000:
            yield told()
            out.clear()
    end()
    yield told()


def nearest(vectors: DataFrame, queries: Column, key: str = "window_id", vector: str = "closes", k: int = NEAREST,
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` other rows with the largest cosine, for each row that ``queries`` (a
    condition on ``vectors``) picks: ``query, rank, found, score``, ties to the smaller
    key. Exact.

    ``vectors`` are windows of closes, say, each with a number ``key`` of its own, or
    any arrays of numbers; ``vector`` must have one length in all of them. The project
    stores no vectors itself. Rows whose vector or key is missing, zero or has missing
    or infinite components take no part; rows that repeat whole count once; other
    columns are left out. Queries and candidates are cut into blocks and every pair of
    blocks is one tile, so a task holds two blocks however many rows there are; a tile
    gives back ``k`` rows a query. A block with many equal vectors keeps ``k + 1``.
    """
    good = vectors.where(usable(vector) & F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct()
    good = materialize(good, "vectors")
    n = good.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    blocks, rows = max(1, -(-n["n"] // block_rows)), max(1, -(-n["asks"] // query_rows))
    at = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    ask = good.where("asks").select("id", "v", F.lit(True).alias("is_query"), at(rows).alias("qb")).withColumn("cb", every(blocks))
    have = good.select("id", "v", F.lit(False).alias("is_query"), at(blocks).alias("cb")).withColumn("qb", every(rows))
    tiles = ask.unionByName(have).groupBy("qb", "cb").applyInArrow(lambda t: _tiles(t, k), "query long, found long, score double")
    return tiles.repartition("query").sortWithinPartitions("query").mapInArrow(lambda b: _merged(b, k), "query long, rank int, found long, score double")

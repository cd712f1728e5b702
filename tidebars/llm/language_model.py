"""Katz backoff model of word pairs: trained and evaluated block by block.

Texts are cut into blocks of tokens. Each block sends the keys of its words and word
pairs, with its counts, to buckets of the key space; a bucket adds the blocks' counts
up and answers each block in the order it asked in. So a key is one entry a block,
however frequent it is, and rows that move are packed arrays. Keys are 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.llm.texts import text_column
from tidebars.sources.storage import materialize

# Counts up to here are discounted by Good and Turing's rule; higher ones lose a fixed
# part of a count, else a context whose followers are all frequent would leave unseen
# words no probability.
RANGE = 5
TAIL = 0.01
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_500_000
SLICE_BYTES = 8_000_000
# No word has white space.
_END, _BEGIN = b"\n", b" "
_GAP = re.compile(rb"[\t-\r ]")


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers from zero on as compressed byte planes."""
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint64)


def words_of(text: str) -> Iterator[list[bytes]]:
    """Lower-case words, a bounded number at a time."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + SLICE_BYTES)
        stop = gap.start() if gap else len(data)
        yield data[at:stop].split()
        at = stop


class Discounts(NamedTuple):
    """What a count loses, for counts 1 to RANGE; ``total`` and ``kinds`` of the level;
    the share of all counts that is lost."""

    lost: list[float]
    total: int
    kinds: int
    share: float

    def minus(self, c: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.lost, TAIL])
        return table[np.minimum(c, RANGE + 1)]


def discounts(hist: Sequence[int], total: int, kinds: int) -> Discounts:
    """From how many keys have each count 1 to RANGE + 1. Where Good and Turing's
    discount isn't between 0 and 1, a fixed part of a count is lost instead."""
    n = [0, *hist]
    fixed = n[1] / (n[1] + 2 * n[2]) if n[1] else TAIL
    a = (RANGE + 1) * n[RANGE + 1] / n[1] if n[1] else 1.0
    lost = []
    for r in range(1, RANGE + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        lost.append(r * (1 - d) if 0 < d < 1 else min(fixed, 0.5) or TAIL)
    gone = sum(x * y for x, y in zip(lost, hist, strict=False)) + TAIL * (kinds - sum(hist[:RANGE]))
    return Discounts(lost, total, kinds, gone / total if total else 1.0)


def _pairs(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One well-mixed key for two."""
    k = context * np.uint64(0x9E3779B97F4A7C15) + word
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(29))


_BLOCK = ["block", "keys", "rows", "held", "sizes", "words", "tokens", "size"]


def _blocks(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of key, text and held-out flag to blocks. A text's part starts with its
    context, which isn't scored: the beginning, or the word before."""
    part = TaskContext.get().partitionId()
    number, row = part << 32, (part << 40) - 1
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    keys, rows, held, sizes, tokens, size = [], [], [], [], [], 0

    def told() -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        seq = rank[np.concatenate(tokens)]
        cols = [pa.array([number]), pa.array([keys], pa.list_(key_type)), *[pa.array([_pack(np.array(x))], pa.binary()) for x in (rows, held, sizes)],
                pa.array([_pack_sorted(hashes[order])], pa.binary()), pa.array([_pack(seq)], pa.binary()), pa.array([size])]
        return pa.RecordBatch.from_arrays(cols, names=_BLOCK)

    def clear() -> None:
        nonlocal number, size
        vocabulary.clear()
        for x in (keys, rows, held, sizes, tokens):
            x.clear()
        number, size = number + 1, 0

    for b in batches:
        for i in range(len(b)):
            row += 1
            key, before = b.column(0)[i].as_py(), _BEGIN
            slices = words_of(b.column(1)[i].as_py())
            words = next(slices, [])
            while words is not None:
                following = next(slices, None)
                ended = [*words, _END] if following is None else words
                if ended:
                    keys.append(key)
                    rows.append(row)
                    held.append(b.column(2)[i].as_py())
                    sizes.append(len(ended) + 1)
                    tokens.append(np.fromiter(map(vocabulary.__getitem__, (before, *ended)), np.int64, len(ended) + 1))
                    size += len(ended)
                    before = ended[-1]
                words = following
                if size >= BLOCK_TOKENS:
                    yield told()
                    clear()
    if keys:
        yield told()


class _Opened:
    """A block's arrays, one entry a scored token."""

    def __init__(self, b: pa.RecordBatch, i: int):
        col = {n: b.column(k)[i] for k, n in enumerate(_BLOCK)}
        self.keys = col["keys"].values
        self.rows = _unpack(col["rows"].as_py()).astype(np.int64)
        self.held = _unpack(col["held"].as_py()) > 0
        sizes = _unpack(col["sizes"].as_py()).astype(np.int64)
        self.words = _unpack_sorted(col["words"].as_py())
        seq = _unpack(col["tokens"].as_py()).astype(np.int64)
        first = np.zeros(len(seq), bool)
        first[np.cumsum(sizes) - sizes] = True
        scored = np.flatnonzero(~first)
        self.text = np.repeat(np.arange(len(sizes)), sizes - 1)
        self.word, self.context = seq[scored], seq[scored - 1]
        self.trained = ~self.held[self.text]

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of a level, and each token's place among them."""
        if n == 1:
            return self.words, self.word
        return np.unique(_pairs(self.words[self.context], self.words[self.word]), return_inverse=True)


def _asked(batches: Iterator[pa.RecordBatch], level: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each block's keys by bucket, with its training counts and a mark for words that
    held-out texts have as context."""
    for b in batches:
        for i in range(len(b)):
            o = _Opened(b, i)
            keys, at = o.level(level)
            n = np.bincount(at[o.trained], minlength=len(keys))
            mark = np.zeros(len(keys), bool)
            if level == 1:
                mark[o.context[~o.trained]] = True
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            first = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(first))
            yield pa.RecordBatch.from_arrays([
                pa.array(some), pa.array(np.full(len(some), b.column(0)[i].as_py())),
                pa.array([_pack_sorted(keys[first[k]:first[k + 1]]) for k in some], pa.binary()),
                pa.array([_pack(2 * n[first[k]:first[k + 1]] + mark[first[k]:first[k + 1]]) for k in some], pa.binary())],
                names=["bucket", "block", "keys", "counts"])


_ANSWER = "bucket long, block long, keys binary, counts binary, hist array<bigint>"
_ANSWER_TYPE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("hist", pa.list_(pa.int64()))])


def _answered(t: pa.Table, level: int) -> pa.Table:
    """A bucket: its part of the level's table (block missing), and an answer to every
    block: twice the count over all blocks, plus one for marked words, or where this
    block is the first that has a pair in a training text."""
    t = t.sort_by("block")
    keys = [_unpack_sorted(x.as_py()) for x in t.column("keys")]
    sent = np.concatenate([_unpack(x.as_py()) for x in t.column("counts")]).astype(np.int64)
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(at, sent >> 1, len(every)).astype(np.int64)
    if level == 1:
        flag = (np.bincount(at, sent & 1, len(every)) > 0)[at]
    else:
        flag = np.zeros(len(at), bool)
        has = np.flatnonzero(sent >> 1)
        flag[has[np.unique(at[has], return_index=True)[1]]] = True
    reply = 2 * count[at] + flag
    ends = np.cumsum([0, *map(len, keys)])
    n = len(keys)
    seen = count > 0
    hist = [int((count == r).sum()) for r in range(1, RANGE + 2)] + [int(count.sum()), int(seen.sum())]
    bucket = t.column("bucket")[0].as_py()
    return pa.table({
        "bucket": [bucket] * (n + 1), "block": [*t.column("block").to_pylist(), None],
        "keys": [None] * n + [_pack_sorted(every[seen])], "counts": [*[_pack(reply[ends[k]:ends[k + 1]]) for k in range(n)], _pack(count[seen])],
        "hist": [None] * n + [hist]}, schema=_ANSWER_TYPE)


def _answers(level: int):
    return lambda t: _answered(t, level)


class Model(NamedTuple):
    """``blocks``: the texts; ``levels``: tables of words and of pairs by bucket (block
    missing: keys, counts), and their answers to the blocks; discounts of both."""

    blocks: DataFrame
    levels: list[DataFrame]
    discounts: list[Discounts]
    begins: int


def train(sets: DataFrame, held_out: Column, key: str = "name", text: str = "description") -> Model:
    """Counts over all texts that ``held_out`` doesn't pick. Only histograms of counts
    (``RANGE`` + 3 sums a level) reach the driver."""
    rows = sets.select(F.col(f"`{key}`").alias("key"), text_column(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    kind = rows.schema["key"]
    arrow = pa.int64() if isinstance(kind.dataType, T.LongType) else pa.int32() if isinstance(kind.dataType, T.IntegerType) else pa.string()
    if not isinstance(kind.dataType, (T.LongType, T.IntegerType)):
        rows = rows.withColumn("key", F.col("key").cast("string"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), *[T.StructField(c, T.BinaryType()) for c in _BLOCK[2:-1]], T.StructField("size", T.LongType())])
    blocks = materialize(rows.mapInArrow(lambda b: _blocks(b, arrow), schema), "blocks")
    n = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(3, math.ceil(math.log2(n / BUCKET_TOKENS)) if n else 0)
    levels, parts = [], []
    for level in (1, 2):
        asked = blocks.mapInArrow(lambda b, level=level: _asked(b, level, bits), "bucket long, block long, keys binary, counts binary")
        table = materialize(asked.groupBy("bucket").applyInArrow(_answers(level), _ANSWER), f"level{level}")
        h = table.where("block is null").select([F.coalesce(F.sum(F.col("hist")[i]), F.lit(0)).alias(f"h{i}") for i in range(RANGE + 3)]).first()
        levels.append(table)
        parts.append(discounts(list(h[:RANGE + 1]), h[RANGE + 1], h[RANGE + 2]))
    begins = rows.where("not held").count()
    return Model(blocks, levels, parts, begins)


def _scored(t: pa.Table, one: Discounts, two: Discounts, begins: int) -> pa.Table:
    """A block with its answers: its texts' scores but for backoff weights (kind 0), how
    often each text backs off from which context (kind 1), and what the pairs that this
    block is the first to have add to their contexts (kind 2)."""
    level = t.column("level").to_pylist()
    place = level.index(0)
    o = _Opened(t.slice(place, 1).select(_BLOCK).combine_chunks().to_batches()[0], 0)

    def replies(n: int) -> np.ndarray:
        at = sorted((t.column("bucket")[i].as_py(), i) for i, x in enumerate(level) if x == n)
        return np.concatenate([_unpack(t.column("counts")[i].as_py()) for _, i in at]).astype(np.int64)

    r1, r2 = replies(1), replies(2)
    keys, pair = o.level(2)
    c1, c2 = r1 >> 1, r2 >> 1
    context = np.where(o.words == np.uint64(xxhash.xxh64_intdigest(_BEGIN)), begins, c1)
    p1 = np.where(c1 > 0, (c1 - one.minus(c1)) / max(one.total, 1), one.share)
    n = c2[pair]
    seen = n > 0
    lower = np.log10(p1)[o.word]
    with np.errstate(divide="ignore", invalid="ignore"):
        higher = np.log10((n - two.minus(n)) / context[o.context])
    base = np.log10((c1 + 0.1) / (one.total + 0.1 * (one.kinds + 1)))[o.word]
    m = len(o.rows)
    texts = {"row": o.rows, "key": o.keys, "held": o.held, "n_tokens": np.bincount(o.text, minlength=m), "n_known": np.bincount(o.text, c1[o.word] > 0, m).astype(np.int64),
             "base": np.bincount(o.text, base, m), "score": np.bincount(o.text, np.where(seen, higher, lower), m)}
    back = np.flatnonzero(~seen & (context[o.context] > 0))
    event, times = np.unique(o.text[back] * len(o.words) + o.context[back], return_counts=True)
    events = {"row": o.rows[event // max(len(o.words), 1)], "n_tokens": times, "context": o.words[event % max(len(o.words), 1)].view(np.int64)}
    some = np.empty(len(keys), np.int64)
    some[pair] = np.arange(len(pair))
    of = o.context[some]
    own = (c2 > 0) & ((r2 & 1) > 0) & ((r1 & 1) > 0)[of]
    mass = np.bincount(of[own], two.minus(c2[own]), len(o.words))
    low = np.bincount(of[own], p1[o.word[some[own]]], len(o.words))
    at = np.flatnonzero(mass)
    contexts = {"n_tokens": context[at], "context": o.words[at].view(np.int64), "mass": mass[at], "low": low[at]}
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("key", o.keys.type), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("score", pa.float64()), ("context", pa.int64()), ("mass", pa.float64()), ("low", pa.float64())])
    tables = []
    for kind, cols in enumerate((texts, events, contexts)):
        size = len(cols["n_tokens"])
        tables.append(pa.table([pa.array(np.full(size, kind), pa.int32()) if f.name == "kind" else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type)
                                for f in schema], schema=schema))
    return pa.concat_tables(tables)


def backoff_weights(scored: DataFrame) -> DataFrame:
    """``context`` and ``weight`` (log10): what the context's followers lost, over what
    words that never follow it have at the lower level, so all words add up to one."""
    sums = scored.where("kind = 2").groupBy("context").agg(F.sum("mass").alias("mass"), F.sum("low").alias("low"), F.max("n_tokens").alias("n"))
    return sums.select("context", F.log10(F.col("mass") / F.col("n") / F.greatest(1 - F.col("low"), F.lit(1e-300))).alias("weight"))


def score(model: Model) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each text
    of ``model``: a token's probability is its pair's if training has the pair, else the
    context's weight times the word's own, else that of unknown words."""
    one, two = model.discounts
    none = [F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts")]
    union = model.blocks.select(F.lit(0).alias("level"), *none, *_BLOCK)
    for n, table in enumerate(model.levels, 1):
        union = union.unionByName(table.where("block is not null").select(F.lit(n).alias("level"), "block", "bucket", "counts"), allowMissingColumns=True)
    key = model.blocks.schema["keys"].dataType.elementType.simpleString()
    begins = model.begins
    scored = materialize(union.groupBy("block").applyInArrow(
        lambda t: _scored(t, one, two, begins),
        f"kind int, row long, key {key}, held boolean, n_tokens long, n_known long, base double, score double, context long, mass double, low double"), "scored")
    backed = scored.where("kind = 1").join(backoff_weights(scored), "context").groupBy("row").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("backed"))
    texts = scored.where("kind = 0").groupBy("row").agg(
        F.first("key", ignorenulls=True).alias("key"), F.max("held").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return texts.join(backed, "row", "left").select(
        "key", "held_out", "n_tokens", "n_known", F.lit(one.total).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"))


def score_sets(sets: DataFrame, held_out: Column, key: str = "name", text: str = "description") -> DataFrame:
    """Parameter sets' descriptions under a Katz model of all those that ``held_out`` (a
    condition on ``sets``) doesn't pick.

    One row per input row: ``key``, ``held_out``, ``n_tokens`` (words in lower case
    A-Z and an end), ``n_known`` (of them in training), ``train_tokens``,
    ``base_score`` (log10 probability under add-0.1 word frequencies) and ``score``
    (log10 probability under the model). Counts of 1 to 5 are discounted by Good and
    Turing's rule. Missing and empty texts are an end only; keys may be missing or
    repeat, those that are no whole numbers come back as text; a missing condition
    counts as training; other columns are left out. Long texts are cut over blocks.
    """
    return score(train(sets, held_out, key, text)).withColumnRenamed("key", key)

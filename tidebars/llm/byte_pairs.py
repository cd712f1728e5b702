"""Byte-level BPE: merges replayed over all words of a block at once, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.llm.packing import read_ranks
from tidebars.llm.pretokens import PARTS, cut_part
from tidebars.llm.texts import keyed_texts

BLOCK_CHARS = 4_000_000
KNOWN_PARTS = 400_000


class Merges:
    """The ranks, and the rank of every pair of ids met so far (-1: none)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.names = [b""] * (max(ranks.values()) + 1)
        for name, r in ranks.items():
            self.names[r] = name
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        self.first = np.array([[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], np.int64)

    def rank(self, a: int, b: int) -> int:
        r = self.pairs.get(a << 20 | b)
        if r is None:
            r = self.pairs[a << 20 | b] = self.ranks.get(self.names[a] + self.names[b], -1)
        return r


def _alone(word: bytes, merges: Merges) -> list[int]:
    """Ids of one word: lowest rank first, of equal ones the leftmost."""
    ids = merges.single[np.frombuffer(word, np.uint8)].tolist()
    after = [*range(1, len(ids)), -1]
    before = list(range(-1, len(ids) - 1))
    heap = [(r, i) for i in range(len(ids) - 1) if (r := merges.rank(ids[i], ids[i + 1])) >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j < 0 or merges.rank(ids[i], ids[j]) != r:
            continue
        ids[i], ids[j] = r, -1
        n = after[i] = after[j]
        after[j] = -1
        if n >= 0:
            before[n] = i
        for left, right in ((before[i], i), (i, n)):
            if left >= 0 and right >= 0 and (q := merges.rank(ids[left], ids[right])) >= 0:
                heapq.heappush(heap, (q, left))
    return [x for x in ids if x >= 0]


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word, as 32-bit numbers.

    All words lie one after the other; an inverted index has the places of each pair by
    the rank of what it merges to. The lowest rank in the index is applied at all its
    places at once, of overlapping ones to the left ones, and only the pairs beside a
    place are looked up anew. If a merge brings a lower rank about in a word where the
    same rank was merged more than once, that word is done again alone, so that every
    word sees its merges in the order it would see by itself.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if not total:
        return [b"" for _ in words]
    raw = np.frombuffer(b"".join(words), np.uint8)
    word = np.repeat(np.arange(len(words)), sizes)
    ids = merges.single[raw]
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = -1
    before[(ends - sizes[sizes > 0])] = -1
    # The rank of the pair that starts at each place.
    at = np.full(total, -1)
    has = np.flatnonzero(after >= 0)
    at[has] = merges.first[raw[has], raw[has + 1]]
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = [0, *cuts.tolist()]
        for r, a, z in zip(ranks[firsts].tolist(), firsts, [*firsts[1:], len(ranks)], strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(places[a:z])

    start = np.flatnonzero(at >= 0)
    if len(start):
        enter(start, at[start])
    alone: set[int] = set()
    rank = merges.rank
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        i = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
        i = i[at[i] == r]
        if not len(i):
            continue
        if len(i) > 1:
            # Of a chain of overlapping places every other one is merged.
            chained = np.r_[False, after[i[:-1]] == i[1:]]
            if chained.any():
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(i))))
                i = i[(np.arange(len(i)) - begin) % 2 == 0]
        j = after[i]
        n = after[j]
        ids[i], ids[j], at[j] = r, -1, -1
        after[i] = n
        some = n >= 0
        before[n[some]] = i[some]
        p = before[i]
        left = np.unique(np.concatenate([p[p >= 0], i])) if len(i) > 1 else np.r_[p[p >= 0], i]
        right = after[left]
        at[left] = -1
        left = left[right >= 0]
        if not len(left):
            continue
        a, b = ids[left], ids[after[left]]
        if len(left) > 400:
            pair, place = np.unique(a << 20 | b, return_inverse=True)
            q = np.array([rank(x >> 20, x & 0xFFFFF) for x in pair.tolist()])[place]
        else:
            q = np.array([rank(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        at[left] = q
        if len(i) > 1 and (lower := (q >= 0) & (q < r)).any():
            w, times = np.unique(word[i], return_counts=True)
            for x in np.intersect1d(w[times > 1], word[left[lower]]).tolist():
                alone.add(x)
                a = int(sizes[:x].sum())
                at[a:a + int(sizes[x])] = -1
        good = at[left] >= 0
        if good.any():
            enter(left[good], at[left[good]])
    alive = ids >= 0
    flat = ids[alive].astype("<i4").tobytes()
    stops = (4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))).tolist()
    out = [flat[a:z] for a, z in zip([0, *stops[:-1]], stops, strict=True)]
    for x in alone:
        out[x] = np.array(_alone(words[x], merges), "<i4").tobytes()
    return out


class _Block:
    """Ids of words and parts as 32-bit numbers, kept from block to block of a task."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern = Merges(read_ranks(path)), regex.compile(pattern)
        self.tokens = {w: r.to_bytes(4, "little") for w, r in self.merges.ranks.items()}
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def learn(self, parts: set[str]) -> None:
        """A word that is a token itself is that token; the others are replayed."""
        if len(self.known) > KNOWN_PARTS:
            self.known.clear()
        if len(self.words) > KNOWN_PARTS:
            self.words.clear()
        tokens, known = self.tokens, self.words
        cut = [(p, [w.encode() for w in cut_part(p, self.pattern, [])]) for p in parts if p not in self.known]
        new = list({w for _, ws in cut for w in ws if w not in tokens and w not in known})
        known.update(zip(new, replay(new, self.merges), strict=True))
        for p, ws in cut:
            self.known[p] = b"".join([tokens[w] if w in tokens else known[w] for w in ws])

    def encode(self, text: str) -> list[np.ndarray]:
        """Ids of one text, block by block."""
        out, parts, size = [], [], 0
        for m in PARTS.finditer(text) if len(text) > BLOCK_CHARS else ():
            parts.append(m[0])
            size += len(m[0])
            if size > BLOCK_CHARS:
                out.append(self.ids(parts))
                parts, size = [], 0
        return [*out, self.ids(parts if len(text) > BLOCK_CHARS else PARTS.findall(text))]

    def ids(self, parts: list[str]) -> np.ndarray:
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<i4")
        except KeyError:
            self.learn(set(parts))
        if missing := {p for p in parts if p not in self.known}:
            self.learn(missing)
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<i4")


def encode(sets: DataFrame, ranks_path: str, pattern: str, key: str = "name", text: str = "description") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every parameter set's description.

    Merges never cross words, so the corpus is replayed in blocks of its distinct
    words, each where its texts lie: no text moves and no task holds more than a block,
    however long a text is. Missing and empty texts have no ids; other columns are left
    out. The rank file is read on the executors from ``ranks_path``.
    """
    rows = keyed_texts(sets, key, text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(ranks_path, pattern)
        for b in batches:
            texts = b.column(1)
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < BLOCK_CHARS):
                    size += len(texts[stop].as_py())
                    stop += 1
                group = texts.slice(at, stop - at).to_pylist()
                if stop - at > 1:
                    block.learn(set().union(*map(PARTS.findall, group)))
                found = [block.encode(t) for t in group]
                ends = np.cumsum([0, *[sum(map(len, f)) for f in found]])
                values = np.concatenate([x for f in found for x in f]) if found else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, stop - at), lists], names=["key", "ids"])
                at = stop

    schema = T.StructType([rows.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(each, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the tokens in column ``ids``
    (missing: none), one after the other."""
    cols = encoded.columns
    at = cols.index("ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        names = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            names[v] = k
        lengths = np.array([len(x) for x in names])
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.slice(start, 500)
                ids = part.column(at).flatten().to_numpy(zero_copy_only=False)
                sizes = np.array([len(x) if x.is_valid else 0 for x in part.column(at)], np.int64)
                data = b"".join(map(names.__getitem__, ids.tolist()))
                ends = np.r_[0, np.cumsum(lengths[ids])][np.r_[0, np.cumsum(sizes)]]
                binary = pa.BinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns, binary.cast(pa.binary())], names=[*cols, "decoded"])

    return encoded.mapInArrow(each, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))

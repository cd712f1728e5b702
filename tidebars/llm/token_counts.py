"""Token counts from pre-token frequencies."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidebars.llm.pretokens import PARTS, cut_part
from tidebars.llm.texts import keyed_texts

# Texts of a block: their places in it take two bytes.
BLOCK_ROWS = 1 << 15
BLOCK_CHARS = 6_000_000
# Entries that are unpacked at a time.
AT_ONCE = 250_000
_ENTRY = np.dtype([("row", "<u2"), ("n", "u1")])
_SUM = np.dtype([("row", "<u2"), ("n", "<u8")])


def _frequencies(rows: Iterator[tuple[int, str]], cut) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, and (word, row, count) sorted by word and row."""
    parts: dict[str, int] = {}
    at, which, times = [], [], []

    def add(row: int, found: list[str]) -> None:
        ids = np.fromiter((parts.setdefault(p, len(parts)) for p in found), np.int64, len(found))
        u, n = np.unique(ids, return_counts=True)
        at.append(np.full(len(u), row))
        which.append(u)
        times.append(n)

    for row, text in rows:
        if len(text) <= BLOCK_CHARS:
            add(row, PARTS.findall(text))
            continue
        some: list[str] = []
        for m in PARTS.finditer(text):
            some.append(m[0])
            if len(some) > 1_000_000:
                add(row, some)
                some = []
        add(row, some)
    if not at:
        return [], *[np.empty(0, np.int64)] * 3
    row, part, n = (np.concatenate(x) for x in (at, which, times))
    words: dict[str, int] = {}
    each = [[words.setdefault(w, len(words)) for w in cut(p)] for p in parts]
    sizes = np.array([len(x) for x in each], np.int64)
    flat = np.fromiter((w for x in each for w in x), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    of = sizes[part]
    place = np.repeat(first[part] - (np.cumsum(of) - of), of) + np.arange(int(of.sum()))
    code = (flat[place] << 16) | np.repeat(row, of)
    code, back = np.unique(code, return_inverse=True)
    total = np.bincount(back, np.repeat(n, of), len(code)).astype(np.int64) if len(code) else code
    return list(words), code >> 16, code & 0xFFFF, total


def _packed_head(keys: pa.Array, sizes: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([keys, sizes], names=["key", "n_bytes"])
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _postings(batches: Iterator[pa.RecordBatch], pattern: str, special: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks: a row with the keys and sizes of their texts (under a word of its own, so
    such rows spread), and a row for each word."""
    rx = regex.compile(pattern)
    names = ["word", "base", "head", "entries"]
    base = TaskContext.get().partitionId() << 20
    for b in batches:
        at = 0
        while at < len(b):
            stop, size, sizes = at, 0, []
            while stop < len(b) and (stop == at or size < BLOCK_CHARS) and stop - at < BLOCK_ROWS:
                x = b.column(1)[stop]
                size += len(x.as_py())
                sizes.append(len(x.as_buffer()))
                stop += 1
            rows = ((i - at, b.column(1)[i].as_py()) for i in range(at, stop))
            words, word, row, n = _frequencies(rows, lambda p: cut_part(p, rx, special))
            # Keys and sizes are packed: columns of lists are slow to pass on row by row.
            head = _packed_head(b.column(0).slice(at, stop - at), pa.array(sizes, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([f"\0{base}"]), pa.array([base]), pa.array([True]), pa.array([head], pa.binary())], names=names)
            own, base, at = base, base + 1, stop
            if not words:
                continue
            reps = -(-n // 255)  # an entry counts up to 255
            rest = np.full(int(reps.sum()), 255)
            rest[np.cumsum(reps) - 1] = n - 255 * (reps - 1)
            entries = np.empty(len(rest), _ENTRY)
            entries["row"], entries["n"] = np.repeat(row, reps), rest
            ends = np.r_[0, np.cumsum(np.bincount(np.repeat(word, reps), minlength=len(words)))] * _ENTRY.itemsize
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(entries.tobytes())])
            for start in range(0, len(words), 20_000):
                w = pa.array(words[start:start + 20_000], pa.string())
                yield pa.RecordBatch.from_arrays([w, pa.array(np.full(len(w), own)), pa.array(np.zeros(len(w), bool)), lists.slice(start, len(w))], names=names)


@lru_cache(1)
def _loaded(path: str) -> Tokenizer:
    """Read once in a worker, whatever number of tasks it runs."""
    return Tokenizer.from_file(path)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True))


_PASSED = ["base", "head", "entries"]


def _counted(batches: Iterator[pa.RecordBatch], tokenizer_path: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word: each distinct word is counted once by the library, its count
    meets the word's frequencies, which lie beside it, and products are added up by
    (base, row); what has gathered is passed on whenever ``limit`` entries have."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
    tok = _loaded(tokenizer_path)
    last, known = None, 0
    rows, sums, held = [], [], 0

    def told() -> Iterator[pa.RecordBatch]:
        code, back = np.unique(np.concatenate(rows), return_inverse=True)
        out = np.empty(len(code), _SUM)
        out["row"], out["n"] = code & 0xFFFF, np.bincount(back, np.concatenate(sums), len(code))
        bases, first = np.unique(code >> 16, return_index=True)
        lists = [out[a:z].tobytes() for a, z in zip(first, [*first[1:], len(code)], strict=True)]
        n = len(bases)
        yield pa.RecordBatch.from_arrays([pa.array(bases), pa.array(np.zeros(n, bool)), pa.array(lists, pa.binary())], names=_PASSED)

    for b in batches:
        heads = b.filter(b.column(2))
        if len(heads):
            yield pa.RecordBatch.from_arrays(heads.columns[1:], names=_PASSED)
        b = b.filter(pc.invert(b.column(2)))
        if not len(b):
            continue
        coded = b.column(0).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w != last]
        pieces = {}
        for at in range(0, len(new), 1000):
            some = new[at:at + 1000]
            pieces.update(zip(some, map(len, tok.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        if last in words:
            pieces[last] = known
        last = b.column(0)[-1].as_py()
        known = pieces[last]
        each = np.array([pieces[w] for w in words], np.float64)[coded.indices.to_numpy()]
        lists, bases = b.column(3), b.column(1).to_numpy()
        sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1]) // _ENTRY.itemsize
        # A frequent word's lists are long: only so many are unpacked at once.
        turns = np.cumsum(sizes) // AT_ONCE
        for at, to in _runs(turns):
            e = np.frombuffer(b"".join(x.as_buffer() for x in lists.slice(at, to - at)), _ENTRY)
            rows.append((np.repeat(bases[at:to], sizes[at:to]) << 16) | e["row"])
            sums.append(e["n"] * np.repeat(each[at:to], sizes[at:to]))
            held += len(e)
            if held > limit:
                yield from told()
                rows, sums, held = [], [], 0
    if held:
        yield from told()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by base, keys first, to one row for each text."""
    keys, sizes, total = None, None, np.empty(0, np.int64)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, sizes, pa.array(total)], names=["key", "n_bytes", "n_tokens"])

    for b in batches:
        for i in range(len(b)):
            if b.column(1)[i].as_py():
                if keys is not None:
                    yield told()
                keys, sizes = pa.ipc.open_stream(b.column(2)[i].as_buffer()).read_next_batch().columns
                total = np.zeros(len(keys), np.int64)
            else:
                e = np.frombuffer(b.column(2)[i].as_buffer(), _SUM)
                np.add.at(total, e["row"], e["n"].astype(np.int64))
    if keys is not None:
        yield told()


def count_tokens(sets: DataFrame, tokenizer_path: str, pattern: str, key: str = "name", text: str = "description", limit: int = 1024) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every parameter set's description, by a
    byte-level BPE file of the library tokenizers.

    Blocks of texts give each of their pre-tokens with the texts it is in and how
    often, packed. Each distinct pre-token of all texts is counted once by the library,
    joined to the frequencies, and products are summed by text; no ids are made. A pre-token
    in a third of all texts is one row a block. Special strings of the file that occur
    in texts count as the library counts them. Missing texts are empty and have no
    tokens; keys may be missing or repeat; other columns are left out.
    """
    special = [t.content for t in Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values()]
    rows = keyed_texts(sets, key, text)
    blocks = rows.mapInArrow(lambda b: _postings(b, pattern, special), "word string, base long, head boolean, entries binary")
    # A word's rows of all blocks lie together, so its count joins them without another shuffle.
    sums = blocks.repartition("word").sortWithinPartitions("word").mapInArrow(
        lambda b: _counted(b, tokenizer_path), "base long, head boolean, entries binary")
    out = T.StructType([rows.schema["key"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    done = sums.repartition("base").sortWithinPartitions("base", F.desc("head")).mapInArrow(_unpacked, out)
    return done.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

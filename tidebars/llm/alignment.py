"""Alignment of the tokens of two tokenizers over the same bytes."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidebars.llm.pretokens import SPACES
from tidebars.llm.texts import keyed_texts
from tidebars.sources.storage import materialize

# Characters of a block, whose linked id pairs are counted together; parts remembered.
BLOCK_CHARS = 1 << 24
KEPT_PARTS = 100_000
# A part ends where a character other than white space meets a space: neither tokenizer
# has a token across such a place, so what it gives for a part depends on the part alone.
_WHITE = SPACES.replace(" ", "")
_PARTS = re.compile(rf" *(?>[^ ]*[{_WHITE}] +)*+(?:[^ ]+|\Z)")


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: bytes that
    print stand for themselves, the others are numbered from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printing)
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


def _piece_bytes(pieces: SentencePieceProcessor) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, a byte piece its byte."""
    return [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in range(len(pieces))]


def align(a_sizes: Iterable[int], b_sizes: Iterable[int]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Groups and links of two token lists over the same bytes, given the size of each
    token: where each group ends in either list, and the places of the linked tokens.

    Ends of tokens are looked up by byte offset; offsets that both lists have cut them
    into groups, and within a group every pair of tokens that share a byte is a link."""
    ends_a, ends_b = (dict(zip(accumulate(sizes), count(1))) for sizes in (a_sizes, b_sizes))
    common = list(filter(ends_b.__contains__, ends_a))
    cuts_a, cuts_b = list(map(ends_a.__getitem__, common)), list(map(ends_b.__getitem__, common))
    # A stretch between neighbouring ends of either list lies in one token of each: a link.
    marks = np.zeros((2, max([0, *islice(reversed(ends_a), 1), *islice(reversed(ends_b), 1)]) + 1), bool)
    for row, ends in zip(marks, (ends_a, ends_b), strict=True):
        row[np.fromiter(ends, np.int64, len(ends))] = True
    marks = marks[:, marks.any(0)]
    of_a, of_b = np.cumsum(marks, 1) - marks
    return cuts_a, cuts_b, of_a, of_b


class _Aligner:
    """Parts with their ids, groups and links by two vocabulary files. Parts repeat, so
    each is encoded once as long as it is remembered."""

    def __init__(self, byte_path: str, piece_path: str, shift: int, code: str):
        self.tokens = Tokenizer.from_file(byte_path)
        self.tokens.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_file=piece_path)
        spelled = _byte_of()
        vocabulary = self.tokens.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=0) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(spelled[c] for c in token)
        self.bytes_b = _piece_bytes(self.pieces)
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.lead = self.pieces.encode("a")
        self.shift, self.code = shift, np.dtype(code)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def learn(self, parts: set[str]) -> None:
        """Have all of ``parts`` in ``known``. What was not used for long is forgotten."""
        if len(self.known) > KEPT_PARTS:
            self.known, self.older = {}, self.known
        new = []
        for p in parts:
            if p not in self.known:
                if p in self.older:
                    self.known[p] = self.older[p]
                else:
                    new.append(p)
        # Parts that end in white space end a text: alone they stay what they are.
        alone = [p for p in new if p[-1] in SPACES or "▁" in p]
        others = [p for p in new if not (p[-1] in SPACES or "▁" in p)]
        for at in range(0, len(others), 2000):
            if not self._encode(others[at:at + 2000]):
                alone += others[at:at + 2000]
        for p in alone:
            if not self._encode([p]):
                self.known[p] = None

    def _encode(self, parts: list[str]) -> bool:
        """Learn parts by encoding them in one go; False if a tokenizer changes a byte."""
        whole = "".join(parts)
        # The model puts a space of its own before a text; a letter takes it up.
        a, led, n = self.tokens.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.pieces.encode("a" + whole), len(self.lead)
        b, want = led[n:], whole.encode()
        bytes_a, bytes_b = list(map(self.bytes_a.__getitem__, a)), list(map(self.bytes_b.__getitem__, b))
        if led[:n] != self.lead or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return False
        cuts_a, cuts_b, of_a, of_b = align(map(len, bytes_a), map(len, bytes_b))
        names_a, names_b = list(map(self.names.__getitem__, a)), list(map(self.names.__getitem__, b))
        said = [names_a[i] + "|" + names_b[j] if x - i == y - j == 1 else ",".join(names_a[i:x]) + "|" + ",".join(names_b[j:y])
                for i, x, j, y in zip([0, *cuts_a], cuts_a, [0, *cuts_b], cuts_b, strict=False)]
        codes = (np.array(a, np.uint64)[of_a] << np.uint64(self.shift) | np.array(b, np.uint64)[of_b]).astype(self.code).tobytes()
        # Every part ends where tokens of both and a group end.
        ends = np.cumsum([len(p.encode()) for p in parts])
        last_a = np.searchsorted(np.cumsum(list(map(len, bytes_a))), ends) + 1
        groups, links = np.searchsorted(cuts_a, last_a) + 1, np.searchsorted(of_a, last_a)
        i, g, k, size = 0, 0, 0, self.code.itemsize
        for part, x, to_g, to_k in zip(parts, last_a.tolist(), groups.tolist(), links.tolist(), strict=True):
            self.known[part] = (x - i, ";".join(said[g:to_g]), codes[size * k:size * to_k])
            i, g, k = x, to_g, to_k
        return True

    def text(self, parts: list[str]) -> tuple[int, int, int, str, bytes]:
        """Tokens of A and of B, groups, their digest and the linked pairs of ids."""
        found = list(map(self.known.__getitem__, parts))
        if not found or None in found:
            return 0, 0, 0, "", b""
        n_a, said, codes = zip(*found, strict=True)
        whole, tokens_a = ";".join(said), sum(n_a)
        groups = whole.count(";") + 1
        tokens = whole.count(",") + 2 * groups
        return tokens_a, tokens - tokens_a, groups, hashlib.sha256(whole.encode()).hexdigest(), b"".join(codes)


@lru_cache(1)
def _aligner(*files) -> _Aligner:
    """Made once in a worker, whatever number of tasks it runs."""
    return _Aligner(*files)


def _blocks(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str, shift: int, code: str) -> Iterator[pa.RecordBatch]:
    """A row for every text, and after each block a row for every linked pair of ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    work = _aligner(byte_path, piece_path, shift, code)
    block, size = TaskContext.get().partitionId() << 20, 0
    pairs, times, codes, key = np.empty(0, np.int64), np.empty(0, np.int64), [], None
    names = ["block", "key", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair", "n"]

    def asked() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), 100_000):
            p = pairs[at:at + 100_000]
            empty = [pa.nulls(len(p), t) for t in (key, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), *empty, pa.array(p), pa.array(times[at:at + 100_000])], names=names)

    def merged(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.frombuffer(b"".join(codes), code), return_counts=True)
        new = new.astype(np.int64)
        every = np.union1d(pairs, new)
        total = np.zeros(len(every), np.int64)
        total[np.searchsorted(every, pairs)] = times
        total[np.searchsorted(every, new)] += n
        return every, total

    for b in batches:
        key = b.column(0).type
        for at in range(0, len(b), 200):
            texts = b.column(1).slice(at, 200).to_pylist()
            cut = [_PARTS.findall(" " + t) if t else [] for t in texts]
            for parts in cut:
                if parts and not parts[-1]:
                    parts.pop()  # the end of a text matches once more, without a character
            work.learn(set().union(*cut))
            done = [work.text(parts) for parts in cut]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), block)), b.column(0).slice(at, 200), *columns, pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.int64())], names=names)
            codes += [d[4] for d in done]
            if len(codes) >= 2000:
                (pairs, times), codes = merged(codes), []
            size += sum(map(len, texts))
            if size > BLOCK_CHARS:
                (pairs, times), codes = merged(codes), []
                yield from asked()
                block, size = block + 1, 0
                pairs, times = pairs[:0], times[:0]
    pairs, times = merged(codes)
    yield from asked()


def _summed(batches: Iterator[pa.RecordBatch], code: str) -> Iterator[pa.RecordBatch]:
    """Rows of a block, counts in order of their pairs first: one row per text."""
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    now, parts, table = None, [], None
    for b in batches:
        blocks = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist()
        for at, to in zip(cuts, [*cuts[1:], len(b)], strict=True):
            if blocks[at] != now:
                now, parts, table = blocks[at], [], None
            run = b.slice(at, to - at)
            count = len(run) - run.column("pair").null_count  # rows of pairs come first
            if count:
                parts.append([run.column(c).slice(0, count).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
                table = None
            run = run.slice(count)
            if not len(run):
                continue
            if table is None:
                table = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
                parts = [table]
            for first in range(0, len(run), 500):
                some = run.slice(first, 500)
                links = some.column("links")
                sizes = np.array([len(x.as_buffer()) for x in links], np.int64) // np.dtype(code).itemsize
                of = np.searchsorted(table[0], np.frombuffer(b"".join(x.as_buffer() for x in links), code).astype(np.int64))
                ends = np.r_[0, np.cumsum(sizes)]
                total, best = (np.r_[0, np.cumsum(table[c][of].astype(np.int64))] for c in (1, 2))
                sums = [pa.array(x) for x in (sizes, np.diff(best[ends]), np.diff(total[ends]))]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names[:4]), *sums, some.column("groups_sha256")], names=names)


def align_tokenizers(sets: DataFrame, byte_path: str, piece_path: str, key: str = "name", text: str = "description") -> DataFrame:
    """How two tokenizers cut every parameter set's description: ``byte_path`` is a
    byte-level BPE file of the library tokenizers (A), ``piece_path`` a sentencepiece model
    with byte fallback that adds a space (B), so A encodes a space and the text. No special
    tokens; their strings in texts are plain.

    One row per input row: ``key``, ``n_a``, ``n_b`` (tokens), ``n_groups`` (stretches between
    byte offsets where tokens of both end), ``n_links`` (pairs of tokens of A and B that share
    a byte), ``count_sum`` (over the links: how many links of all texts hold the same two ids),
    ``n_best`` (links for whose B id no other A id is linked more often in all texts) and
    ``groups_sha256`` (digest of ``a1,a2|b1;a3|b2,b3``). Missing and empty texts, and texts whose
    bytes one of the two changes, have no tokens: zeros and ''. Keys may be missing or repeat;
    other columns are left out.

    The ends of a part's tokens are kept in dictionaries by byte offset; the offsets in both
    are the cuts. Each block of texts asks once for each pair of ids it holds; the counts
    join by pair and return to the block. The best count for an id of B is one row per piece of
    its vocabulary, which bounds what is broadcast.
    """
    rows = keyed_texts(sets, key, text)
    shift = max(len(SentencePieceProcessor(model_file=piece_path)) - 1, 1).bit_length()
    bits = shift + max(Tokenizer.from_file(byte_path).get_vocab_size() - 1, 1).bit_length()
    code = "<u4" if bits <= 32 else "<u8"  # both ids of a link in one number
    schema = T.StructType([T.StructField("block", T.LongType()), rows.schema["key"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType()), T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    done = materialize(rows.mapInArrow(lambda b: _blocks(b, byte_path, piece_path, shift, code), schema), "aligned")
    asked = done.where("pair IS NOT NULL").select("block", "pair", "n")
    counts = materialize(asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << shift) - 1).cast("long"))), "pair_counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    rated = counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    told = asked.select("block", "pair").join(rated, "pair").select("block", "pair", "n", "best")
    both = done.where("pair IS NULL").drop("pair", "n").unionByName(told, allowMissingColumns=True)
    both = both.select("block", "key", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair", "n", "best")
    out = T.StructType([rows.schema["key"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                        T.StructField("groups_sha256", T.StringType())])
    placed = both.repartition("block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    return placed.mapInArrow(lambda b: _summed(b, code), out).withColumnRenamed("key", key)


"""Near-duplicates by Jaccard similarity: SimHash links, MinHash bands, sketches, exact checks, connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.llm.near_duplicates import SEED, classes, fingerprint, links
from tidebars.llm.texts import keyed_texts
from tidebars.sources.storage import materialize

SHINGLE = 5
LEAST = 0.8
# At 0.8 a band of five agrees with probability 0.33, so all 51 differ once in 6e8 pairs.
BANDS, WIDE = 51, 5
# One bit of each of 256 minima; at 0.8 fewer agree than this once in 5e6 pairs or more.
AGREE = 200
_RND = np.random.default_rng(SEED)
_TIMES, _PLUS = _RND.integers(0, 1 << 32, (2, 256), np.uint32)
_TIMES |= np.uint32(1)
_AT_ONCE = 1 << 12


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    rows = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in rows), np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """Least value of each of 256 hash functions."""
    least = np.full(256, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _AT_ONCE):
        np.minimum(least, (_TIMES[:, None] * short[at:at + _AT_ONCE] + _PLUS[:, None]).min(axis=1), out=least)
    return least


def marks(rows: DataFrame, shingle: int) -> DataFrame:
    """``id`` and ``size`` of the set of shingles, SimHash fingerprint ``fp``, band values and four words of sketch for every row of ``key`` and ``text``."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, prints, bands, sketches = [], [], [], [], []
            for t in b.column(1).to_pylist():
                found = shingles(t, shingle)
                least = minima(found)
                ids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(fingerprint(t))
                bands.append([xxhash.xxh64_intdigest(least[k * WIDE:k * WIDE + WIDE].tobytes(), k) for k in range(BANDS)])
                sketches.append(np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).view(np.int64).tolist())
            signed = np.array(bands, np.uint64).reshape(-1, BANDS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(list(signed), pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["key", "text", "id", "size", "fp", "bands", "sketch"])

    schema = T.StructType([rows.schema["key"], T.StructField("text", T.StringType()), T.StructField("id", T.LongType()), T.StructField("size", T.LongType()),
                           T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(each, schema)


def _alike(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    return 256 - np.bitwise_count((sketch ^ others).view(np.uint64)).sum(axis=-1, dtype=np.int64) >= AGREE


class _Leaders:
    """Rows of a run that are like no earlier one. Only these are held."""

    def __init__(self):
        self.ids, self.sketches = np.empty(0, np.int64), np.empty((0, 4), np.int64)

    def add(self, ids: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row that is like an earlier one, with the first such."""
        first = np.full(len(ids), -1)
        for k in range(len(self.ids)):
            open_rows = np.flatnonzero(first < 0)
            first[open_rows[_alike(self.sketches[k], sketch[open_rows])]] = k
        while (first < 0).any():
            i = int((first < 0).argmax())
            self.ids, self.sketches = np.append(self.ids, ids[i]), np.vstack([self.sketches, sketch[i]])
            rest = i + np.flatnonzero(first[i:] < 0)
            first[rest[_alike(sketch[i], sketch[rest])]] = len(self.ids) - 1
        led = self.ids[first] != ids
        return self.ids[first][led], ids[led]


_STEP = ["kind", "k", "a", "b", "size", "s0", "s1", "s2", "s3"]


def _first_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by band value, run by run: each row with its leader (kind 0), and
    the rows of runs of more than one row (kind 1) for later steps. Batches pass through."""
    last, run = None, _Leaders()  # the last row seen, held back while it is alone in its run

    def told(kind: int, rows: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(rows), kind), rows[:, 0], rows[:, 1], other, *rows[:, 2:].T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_STEP)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        sizes = np.diff(np.r_[cuts, len(rows)])
        same = last is not None and last[0] == rows[0, 0]
        many = np.repeat(sizes > 1, sizes)
        if same:
            many[:sizes[0]] = True
            if run is None:  # it was alone so far
                yield told(1, last[None], last[None, 1])
        if many.any():
            yield told(1, rows[many], rows[many, 1])
        for at, n in zip(cuts.tolist(), sizes.tolist(), strict=True):
            part = rows[at:at + n]
            goes_on = at == 0 and same
            if goes_on and run is None:
                run = _Leaders()
                run.add(last[None, 1], np.ascontiguousarray(last[None, 3:]))
            elif not goes_on:
                run = None if n == 1 else _Leaders()
            if run is not None:
                a, b = run.add(part[:, 1], np.ascontiguousarray(part[:, 3:]))
                if len(a):
                    pairs = np.zeros((len(a), 7), np.int64)
                    pairs[:, 1] = a
                    yield told(0, pairs, b)
        last = rows[-1]


def _middle(sketch: np.ndarray) -> int:
    """The row whose sketch agrees most with the bits that most rows have: the text that
    the others are copies of, if it is among them."""
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1)
    most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).view(np.int64)
    return int(np.bitwise_count((sketch ^ most).view(np.uint64)).sum(axis=1, dtype=np.int64).argmin())


def _apart(ids: np.ndarray, labels: np.ndarray, step: str, middle: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a run, each with those of other labels that it is to meet: with the ``middle``
    row only, a ``part`` (a 32nd, chosen by hash), or all. The rows of the most frequent label
    meet only the others."""
    names, of, counts = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return
    major = of == counts.argmax() if middle is None else middle
    for i in np.flatnonzero(~major if middle is None else middle):
        j = np.flatnonzero((of != of[i]) & (major | (ids > ids[i]) | (middle is not None)))
        if step == "part":
            j = j[((ids[j] ^ ids[i]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59) == 0]
        yield int(i), j


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """From rows sorted by band value, the slices of one run after the other; one run is held."""
    held, last = [], None
    for batch in batches:
        k = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist()
        for at, to in zip(cuts, [*cuts[1:], len(k)], strict=True):
            if held and k[at] != last:
                yield held
                held = []
            held.append(batch.slice(at, to - at))
            last = k[at]
    if held:
        yield held


def _walk(batches: Iterator[pa.RecordBatch], least: float, step: str) -> Iterator[pa.RecordBatch]:
    """The rows of each run that have an alike row of another label, which sizes and shared
    shingles allow; in step ``middle`` that is the middle row or the other."""
    for run in _runs(batches):
        rows = np.concatenate([np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in run])
        if len(rows) == 1:
            continue
        ids, labels, sizes, shared = rows[:, 1:5].T
        sketch = np.ascontiguousarray(rows[:, 5:])
        middle = np.arange(len(rows)) == _middle(sketch) if step == "middle" else None
        open_rows = np.zeros(len(rows), bool)
        for i, j in _apart(ids, labels, step, middle):
            j = j[np.minimum(shared[i], shared[j]) * (1 + least) >= least * (sizes[i] + sizes[j]) - 1e-6]
            j = j[_alike(sketch[i], sketch[j])]
            open_rows[j] = True
            open_rows[i] |= len(j) > 0
        if open_rows.any():
            told = rows[open_rows]
            columns = [*told[:, :4].T, (middle[open_rows] if middle is not None else np.zeros(len(told), bool)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["k", "id", "label", "size", "middle"])


def _meet(batches: Iterator[pa.RecordBatch], least: float, step: str) -> Iterator[pa.RecordBatch]:
    """Pairs to check from rows sorted by band value, run by run: those of different labels
    that share enough of the short hashes of their shingles, at least as many as shingles."""
    for run in _runs(batches):
        ids, labels, sizes, centre = (np.concatenate([b.column(c).to_numpy() for b in run]) for c in ("id", "label", "size", "middle"))
        sets = [np.frombuffer(x.as_buffer(), np.uint32) for b in run for x in b.column("short")]
        lengths = np.array([len(x) for x in sets])
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        for i, j in _apart(ids, labels, step, centre > 0 if step == "middle" else None):
            own = np.zeros(len(names), bool)
            own[codes[starts[i]:starts[i] + lengths[i]]] = True
            common = np.add.reduceat(own[codes], starts, dtype=np.int64)[j]
            j = j[common * (1 + least) >= least * (sizes[i] + sizes[j]) - 1e-6]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])


def _short(sets: DataFrame) -> DataFrame:
    """``id`` and half of each shingle's hash."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [(np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary())], names=["id", "short"])

    return sets.select("id", "hashes").mapInArrow(each, "id long, short binary")


def _sets(ids: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """``id`` and the hashes of its shingles, for some ids. One text of each is read."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = pa.array([shingles(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), hashes], names=["id", "hashes"])

    texts = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    return texts.mapInArrow(each, "id long, hashes binary")


def _printed(each: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of sets whose SimHash fingerprints link: equal ones with the
    first such, and of different ones the firsts."""
    first = materialize(each.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    equal = each.join(first, "fp").where(F.col("id") > F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    at = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}"))
    near = links(first.select("fp")).join(at("a"), "a").join(at("b"), "b")
    return equal.unionByName(near.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))


def _shared(sets: DataFrame) -> DataFrame:
    """``id`` and ``own``: how many of its shingles no other of these sets has."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(hashes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key, np.int64)), pa.array(h)], names=["id", "h"])

    single = sets.mapInArrow(each, "id long, h long").groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets of shingles are alike enough, counted exactly."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                near.append(common >= least * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(each, "a long, b long")


def similar_sets(sets: DataFrame, key: str = "name", text: str = "description", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Class of every parameter set's description: one row per input row, ``key`` and
    ``component`` (smallest key of the class; missing keys count last). Texts link where the
    sets of their shingles have Jaccard similarity ``least`` (0.8 or more) or are equal, and
    classes are what chains of links connect.

    Texts with equal sets are one. Candidates are what SimHash fingerprints link (see
    ``near_duplicates.links``) and, as two bits are far stricter than ``least``, what shares
    a band of MinHash values and has like sketches; every candidate that can still join two
    classes is checked exactly: first the links, and each text with the first like it in a
    band; then, in bands where several classes still meet, with the text in their middle; then
    a 32nd of what lies between different classes, and the rest. From the second step on a text
    meets only those that sizes allow, given how many of its shingles no other of these texts
    has, and only pairs with enough common shingles leave a band: a group of copies that are
    like each other, but not enough, is not multiplied out.

    Missing texts are empty; empty texts are one class, a text shorter than ``shingle``
    words is one shingle, case doesn't count, and texts of any length are hashed whole.
    Repeated rows and keys give a row each, other columns are left out, and an empty
    table gives none.
    """
    if not LEAST <= least <= 1:
        raise ValueError("bands and sketches are made for similarities of 0.8 and more")
    rows = materialize(marks(keyed_texts(sets, key, text), shingle), "marks")
    each = materialize(rows.groupBy("id").agg(F.min("key").alias("least"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "each")
    words = [F.col("sketch")[k].alias(f"s{k}") for k in range(4)]
    runs = each.select(F.explode("bands").alias("k"), "id", "size", *words).repartition("k").sortWithinPartitions("k", "id")
    first = materialize(runs.mapInArrow(_first_walk, ", ".join(f"{c} long" for c in _STEP)), "runs")
    leaders = first.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(leaders.unionByName(_printed(each)).distinct(), "pairs")
    together = first.where("kind = 1").select("k", F.col("a").alias("id"), "size", "s0", "s1", "s2", "s3")
    # The texts are read once, for all that later steps can ask for.
    ids = together.select("id").unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    hashed = materialize(_sets(ids, rows, shingle), "sets")
    roots, edges, own = None, None, None
    for step in ("first", "middle", "part", "rest"):
        if step != "first":
            named = together.join(roots, together["id"] == roots["node"], "left").select(together["*"], F.coalesce("root", "id").alias("label"))
            mixed = named.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("k")
            named = materialize(named.join(mixed, "k", "left_semi"), "mixed")
            if own is None:
                if named.isEmpty():
                    break
                own = materialize(_shared(hashed.join(named.select("id").distinct(), "id", "left_semi")), "own")
            held = named.join(own, "id", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
            held = held.where(F.col("shared") >= least * F.col("size") - 1e-6).select("k", "id", "label", "size", "shared", "s0", "s1", "s2", "s3")
            walked = held.repartition("k").sortWithinPartitions("k", "id").mapInArrow(
                lambda batches, step=step: _walk(batches, least, step), "k long, id long, label long, size long, middle long")
            walked = materialize(walked, "walked")
            shown = walked.join(_short(hashed.join(walked.select("id").distinct(), "id", "left_semi")), "id").select("k", "id", "label", "size", "middle", "short")
            met = shown.repartition("k").sortWithinPartitions("k", "id").mapInArrow(lambda batches, step=step: _meet(batches, least, step), "a long, b long")
            pairs = materialize(met.distinct(), "pairs")
        if pairs.isEmpty():
            if step == "first":
                break
            continue
        more = materialize(_checked(pairs, hashed, least), "near")
        if step != "first" and more.isEmpty():
            continue
        edges = more if edges is None else edges.unionByName(more)
        roots = classes(edges)
    if roots is None:
        placed = each.select("id", "least", F.col("id").alias("root"))
    else:
        placed = each.join(roots, each["id"] == roots["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    # Stored, so that the join is nothing but a join, which Spark can split where a class is large.
    component = materialize(placed.groupBy("root").agg(F.min("least").alias("component")), "components")
    return rows.select("key", "id").join(placed.join(component, "root").select("id", "component"), "id").select(F.col("key").alias(key), "component")

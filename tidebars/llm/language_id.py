"""Language of texts: known words by log frequency, other words by character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.llm.texts import keyed_texts
from tidebars.sources.storage import materialize

UNKNOWN = "und"
# Longest n-gram; how many entries a model holds over all languages, by kind.
LONGEST = 5
WORDS, GRAMS = 200_000, 50_000
# What is added to every count, so that a word of one language can occur in another.
ADDED = 0.1
# A letter, then letters and the marks that belong to them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PLAIN = re.compile("[a-z]+")  # the same for texts of ASCII characters
# Words remembered by a task, and words counted before they are passed on.
_KEPT = 200_000


def words_of(text: str) -> list[str]:
    """Stretches of letters, in lower case."""
    return (_PLAIN if text.isascii() else _WORD).findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    """The word's n-grams of one size; its ends count as characters."""
    edged = f" {word} "
    return [edged[k:k + size] for k in range(len(edged) - size + 1)]


@dataclass(frozen=True)
class Table:
    """Row of each entry, and rows of log frequencies by language."""

    rows: dict[str, int]
    logs: np.ndarray


@dataclass(frozen=True)
class Model:
    """``words`` and ``grams`` (by size) hold the log frequency of each entry in each of
    ``languages``; ``prior`` has the log share of the texts of each."""

    languages: list[str]
    prior: np.ndarray
    words: Table
    grams: dict[int, Table]

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a known word; of an unseen one the mean over its known
        n-grams of the greatest size that has any; None if nothing of it is known."""
        if word in self.words.rows:
            return self.words.logs[self.words.rows[word]]
        for size in sorted(self.grams, reverse=True):
            table = self.grams[size]
            found = [row for g in grams_of(word, size) if (row := table.rows.get(g)) is not None]
            if found:
                return table.logs[found].sum(axis=0, dtype=float) / len(found)
        return None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts of a task by language, and the number of texts without a word."""
    found: dict[str, Counter[str | None]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for language, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(counts), pa.string()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                             names=["language", "entry", "n"])
        found.clear()

    for b in batches:
        for language, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts = found.setdefault(language, Counter())
            counts[None] += 1
            counts.update(words_of(text))
            if len(counts) > _KEPT:
                yield from told()
    yield from told()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each counted word under size 0, its n-grams under their sizes."""
    for b in batches:
        found: dict[tuple[str, int], dict[str, int]] = {}
        for language, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault((language, 0), {})[word] = n
            for size in range(1, LONGEST + 1):
                counts = found.setdefault((language, size), {})
                for g in grams_of(word, size):
                    counts[g] = counts.get(g, 0) + n
        for (language, size), counts in found.items():
            k = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * k, pa.string()), pa.array([size] * k, pa.int32()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                             names=["language", "size", "entry", "n"])


def train(sets: DataFrame, learn: Column | None = None, text: str = "description", label: str = "category", words: int = WORDS, grams: int = GRAMS) -> Model:
    """Model from the parameter sets whose ``label`` is not missing and for which ``learn``
    holds (missing: it doesn't). All their texts are counted. The model keeps the ``words``
    most frequent words and the ``grams`` most frequent n-grams of each size over all
    languages, each language an equal share of them (ties: first in order), which bounds
    what reaches the driver and the tasks; other words count as unseen."""
    named = sets.where(F.col(f"`{label}`").isNotNull() & F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)))
    rows = named.select(F.col(f"`{label}`").cast("string").alias("language"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counted, "language string, entry string, n long").groupBy("language", "entry").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "words")
    texts = {r["language"]: r["n"] for r in counted.where("entry IS NULL").select("language", "n").collect()}
    languages = sorted(texts)
    if not languages:
        return Model([], np.empty(0), Table({}, np.empty((0, 0))), {})
    spread = counted.where("entry IS NOT NULL").mapInArrow(_spread, "language string, size int, entry string, n long")
    entries = materialize(spread.groupBy("size", "language", "entry").agg(F.sum("n").alias("n")), "entries")
    share = F.when(F.col("size") == 0, max(1, words // len(languages))).otherwise(max(1, grams // len(languages)))
    # The best of each of many parts first, so no task ranks all entries of a language.
    part = F.pmod(F.xxhash64("entry"), F.lit(64))
    order = [F.desc("n"), F.asc("entry")]
    best = entries.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("size", "language", "_part").orderBy(*order))).where(F.col("_rank") <= share)
    best = best.withColumn("_rank", F.row_number().over(Window.partitionBy("size", "language").orderBy(*order))).where(F.col("_rank") <= share)
    kept = entries.join(best.select("size", "entry").distinct(), ["size", "entry"])
    by_entry = kept.groupBy("size", "entry").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("n")).collect()
    total = {(r["size"], r["language"]): (r["n"], r["entries"])
             for r in entries.groupBy("size", "language").agg(F.sum("n").alias("n"), F.count("*").alias("entries")).collect()}
    sizes = {}
    for size in range(LONGEST + 1):
        sums = np.array([total.get((size, x), (0, 0)) for x in languages], float)
        sizes[size] = np.log(sums[:, 0] + ADDED * (sums[:, 1] + 1))
    found: dict[int, tuple[list[str], list[list[int]]]] = {size: ([], []) for size in sizes}
    for size, entry, n in by_entry:
        found[size][0].append(entry)
        found[size][1].append([n.get(x, 0) for x in languages])
    tables = {}
    for size, (names, counts) in found.items():
        logs = np.log(np.array(counts, float).reshape(-1, len(languages)) + ADDED) - sizes[size]
        tables[size] = Table({name: k for k, name in enumerate(names)}, logs.astype(np.float32))
    prior = np.log(np.array([texts[x] for x in languages], float) / sum(texts.values()))
    return Model(languages, prior, tables.pop(0), tables)


def _told(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known: dict[str, np.ndarray | None] = {}
    rows, logs = model.words.rows, model.words.logs
    for b in batches:
        language, score = [], []
        for text in b.column(1).to_pylist():
            found = Counter(words_of(text))
            if not found or not model.languages:
                language.append(UNKNOWN)
                score.append(0.0)
                continue
            total, unseen = model.prior.copy(), []
            at, times = [], []
            for word, n in found.items():
                row = rows.get(word)
                if row is None:
                    unseen.append((word, n))
                else:
                    at.append(row)
                    times.append(n)
            if at:
                total += np.array(times, float) @ logs[at]
            for word, n in unseen:
                if word not in known:
                    if len(known) >= _KEPT:
                        known.clear()
                    known[word] = model.word(word)
                if known[word] is not None:
                    total += n * known[word]
            best = int(total.argmax())
            language.append(model.languages[best])
            score.append(1.0 / math.fsum(np.exp(total - total[best])))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64())], names=["key", "language", "score"])


def identify(sets: DataFrame, model: Model, key: str = "name", text: str = "description") -> DataFrame:
    """``key``, ``language`` and ``score`` of every parameter set's description, one row per
    input row; nothing but the text is looked at.

    Each word of a text adds its log frequency in each language; an unseen word falls back
    to its longest known n-grams, ever shorter ones if there are none. ``language`` is the
    one with the greatest sum (ties: first in order), which starts from its share of the
    texts; ``score`` (0 to 1) its probability against the others. Missing texts, texts
    without a letter, and all texts if nothing was learned give ``und`` and 0. Keys may be
    missing or repeat; other columns are left out. Descriptions are written in whatever
    language their author uses; a set's ``category`` names it where it is known.
    """
    rows = keyed_texts(sets, key, text)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([rows.schema["key"], T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lambda b: _told(b, shared.value), out).withColumnRenamed("key", key)

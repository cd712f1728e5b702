"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.texts import WORD, boxed, held, text_column


class Rule(NamedTuple):
    """``ratio`` must lie in [low, high] in texts of ``min_words`` words or more."""

    name: str
    ratio: str
    low: float | None
    high: float | None
    min_words: int = 0


_SPACES = " \t\n\x0b\f\r"

# Windows of so many words count as repeated when they are found twice.
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on", "as", "are", "this", "be",
    "der", "die", "und", "das", "ist", "den", "nicht", "von", "mit", "ein", "eine", "zu", "auf", "im",
    "le", "la", "les", "de", "et", "des", "un", "une", "que", "est", "du", "pour", "dans", "sur", "par", "en",
    "el", "los", "las", "y", "con", "por", "para", "del", "se", "una", "al", "su",
]

_STOPS = [f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())]

RULES = [
    Rule("mean word length", "chars_per_word", 2.0, 20.0),
    Rule("symbols per word", "symbols_per_word", None, 0.1),
    Rule("exclamations per word", "exclamations_per_word", None, 0.3),
    Rule("stop words", "n_stop_words", 2.0, None, 100),
    Rule("repeated lines", "dup_line_share", None, 0.5),
    Rule("words per line", "words_per_line", 1.5, None, 100),
]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RATIOS = ["chars_per_word", "symbols_per_word", "exclamations_per_word", "n_stop_words", "dup_line_share", "words_per_line"]


def _share(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def _measured(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with counts and ratios of column ``text``. Each step is a projection
    of its own where several expressions need its value."""
    inner = F.btrim("text", F.lit(_SPACES))
    # In these patterns \s is exactly blank and \x09 to \x0D.
    words = df.select(*keep, "text", held(F.when(inner != "", F.split(inner, r"\s+")).otherwise(F.array().cast("array<string>"))).alias("w"))
    has_word = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    hashed = words.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        held(F.transform("w", lambda w: F.xxhash64(w))).alias("h"),
        held(F.transform(has_word, lambda x: F.xxhash64(x))).alias("lines"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.size(F.filter("w", lambda w: w.isin(_STOPS))).cast("long").alias("n_stop_words"),
    )
    last = WINDOW - 1
    counted = hashed.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        held(F.transform(F.slice("h", 1, F.greatest(F.size("h") - last, F.lit(0))),
                         lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]))).alias("windows"),
    )
    # Most texts repeat no window; the others sort theirs, so equal ones become neighbours.
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    ordered = counted.withColumn("runs", held(F.when(repeats, F.sort_array(
        F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))))
    same = lambda a, k: F.get("runs", k)["x"] == a["x"]
    starts = ordered.withColumn("at", held(F.sort_array(F.transform(
        F.filter("runs", lambda a, k: (F.coalesce((k > 0) & same(a, F.greatest(k - 1, F.lit(0))), F.lit(False))) | F.coalesce(same(a, k + 1), F.lit(False))),
        lambda a: a["i"]))))
    # A window covers the words up to the next one's start, five at most.
    covered = F.aggregate(F.transform("at", lambda a, k: F.coalesce(F.least(F.get("at", k + 1) - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
                          F.lit(0).cast("long"), lambda s, n: s + n)
    return starts.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        _share("word_chars", "n_words").alias("chars_per_word"), _share("n_symbols", "n_words").alias("symbols_per_word"),
        _share("n_exclamations", "n_words").alias("exclamations_per_word"), "n_stop_words",
        _share("n_dup_lines", "n_lines").alias("dup_line_share"), _share("n_words", "n_lines").alias("words_per_line"),
    )


def verdict(rules: Sequence[Rule]) -> list[Column]:
    """The table as columns ``base_failed``, ``broken_rules`` and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = []
    for r in rules:
        x = F.col(r.ratio)
        outside = F.lit(False) if r.low is None else x < r.low
        outside = outside if r.high is None else outside | (x > r.high)
        broken.append(F.when(F.coalesce(outside & (F.col("n_words") >= r.min_words), F.lit(False)), F.lit(r.name)))
    names = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return [base.alias("base_failed"), names.alias("broken_rules"), (~base & (F.size(names) == 0)).alias("kept")]


def quality_report(sets: DataFrame, key: str = "name", text: str = "description", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts, ratios and verdict of every parameter set's description.

    One row per input row: ``key``, the counts ``n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words`` and the ratios of ``rules``, then ``base_failed``
    (under 10 words, or over a fifth of the words in repeated five-word windows),
    ``broken_rules`` and ``kept``. A ratio without a denominator breaks no rule.
    Missing and empty texts have zero words, so they fail. Keys may be missing or
    repeat; other columns are left out, whatever their names. Built-in functions
    only, no shuffle.
    """
    rows = sets.select(F.col(f"`{key}`").alias("key"), text_column(text).alias("text"))
    return _measured(rows, ["key"]).select(F.col("key").alias(key), *COUNTS, *[r for r in _RATIOS if r not in COUNTS], *verdict(rules))


def keep_good(sets: DataFrame, text: str = "description", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``sets`` that the rules keep, with their own columns."""
    rows = _measured(boxed(sets, text), ["row"])
    return rows.where(verdict(rules)[2]).select("row.*")

"""Secret scans: fixed patterns, and Markov models of random strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.texts import boxed, held, text_column

# Kinds in the order in which ties are listed, their patterns, the group and the length it needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]

# Runs that the models judge, and the characters they are made of.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LENGTH = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_LENGTH},}}"
# Labels of training samples: words, numbers and identifiers made of them are ordinary.
ORDINARY = r"^([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([_/=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*$"
SAMPLES = 20_000
MIN_RATIO = 12.0

_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.length(x))


def _located(pieces: Column, hits: Column, values: Column, rank: int, kind: str, least: int) -> Column:
    """Spans from what lies between the hits and the hits: both have their
    lengths in characters, so running sums give the places."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    step = F.arrays_zip(pieces.alias("p"), hits.alias("h"), values.alias("v"))

    def place(acc, x):
        at = acc["at"] + F.coalesce(F.length(x["p"]), F.lit(0))
        end = at + F.coalesce(F.length(x["h"]), F.lit(0))
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span.cast(_SPAN)))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(step, start, place, lambda acc: acc["out"])


def _spans(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``base`` (spans of the patterns) and ``runs`` (spans to judge) of
    column ``text``. Texts without a hit take no part in the running sums."""
    parts = [*KINDS, ("markov", RUN, 0, RUN_LENGTH)]
    found = df.select(*keep, "text", *[held(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"h_{k}") for k, p, _, _ in parts])
    none = F.array().cast(f"array<{_SPAN}>")
    out = []
    for rank, (kind, pattern, group, least) in enumerate(parts):
        hits = F.col(f"h_{kind}")
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else hits
        out.append(F.when(F.size(hits) > 0, _located(F.split("text", pattern, -1), hits, values, rank, kind, least)).otherwise(none).alias(f"s_{kind}"))
    cut = found.select(*keep, *out)
    base = F.concat(*[F.col(f"s_{k}") for k, *_ in KINDS])
    return cut.select(*keep, held(F.sort_array(base)).alias("base"), held(F.col("s_markov")).alias("runs"))


def _outside(runs: str, base: str) -> Column:
    """Runs that touch no span of the patterns."""
    return F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))


def labelled_samples(sets: DataFrame, text: str = "description", samples: int = SAMPLES) -> DataFrame:
    """Training samples (``random`` boolean, ``value``): what the patterns find is
    random, long runs elsewhere that are plain words, numbers or identifiers made
    of them are ordinary. At most ``samples`` different values of each label, those
    with the smallest hash; all texts are looked through."""
    spans = _spans(sets.select(text_column(text).alias("text")), [])
    values = spans.select(F.explode(F.concat(
        F.transform("base", lambda s: F.struct(F.lit(True).alias("random"), s["value"].alias("value"))),
        F.transform(F.filter(_outside("runs", "base"), lambda r: F.regexp_like(r["value"], F.lit(ORDINARY))),
                    lambda r: F.struct(F.lit(False).alias("random"), r["value"].alias("value"))))).alias("s"))
    # Patterns also find things like password=changeme; only values with digits and letters count as random.
    values = values.select("s.*").where(~F.col("random") | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))).distinct()
    pick = lambda label: values.where(F.col("random") == label).orderBy(F.xxhash64("value"), "value").limit(samples)
    return pick(True).unionByName(pick(False))


def train(samples: DataFrame, smoothing: float = 5.0) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each pair of neighbouring
    characters. ``samples``: rows of ``random`` and ``value``; at most (characters
    + 1) squared sums, so they fit the driver. What follows a character is smoothed
    by ``smoothing`` samples of how often characters occur at all, so one that a label
    hardly has is unlikely after any other. A label without samples counts as evenly
    distributed."""
    n = len(ALPHABET) + 1
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = samples.where(F.length("value") > 1).select("random", F.transform(F.split("value", ""), lambda c: F.when(c == "", 0).otherwise(at(c))).alias("c"))
    pairs = chars.select("random", F.explode(F.transform(F.slice("c", 1, F.size("c") - 1), lambda x, i: F.struct(x.alias("a"), F.get("c", i + 1).alias("b")))).alias("p"))
    counts = {True: [[0.0] * n for _ in range(n)], False: [[0.0] * n for _ in range(n)]}
    for r in pairs.groupBy("random", "p.a", "p.b").count().collect():
        counts[r["random"]][r["a"]][r["b"]] += r["count"]
    chance = {}
    for label, c in counts.items():
        seen = [sum(row[b] for row in c) + 0.5 for b in range(n)]
        share = [x / sum(seen) for x in seen]
        chance[label] = [[(row[b] + smoothing * share[b]) / (sum(row) + smoothing) for b in range(n)] for row in c]
    return [math.log(chance[True][a][b] / chance[False][a][b]) for a in range(n) for b in range(n)]


def _ratio(value: Column, table: list[float]) -> Column:
    n = len(ALPHABET) + 1
    llr = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    places = F.transform(F.split(value, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(places, start, lambda acc, c: F.struct(
        c.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.get(llr, acc["last"] * n + c)).otherwise(0.0)).alias("sum")), lambda acc: acc["sum"])


def _judged(spans: DataFrame, keep: list[str], table: list[float], min_ratio: float) -> DataFrame:
    mixed = lambda v: F.regexp_like(v, F.lit("[0-9]")) & F.regexp_like(v, F.lit("[A-Za-z]"))
    added = F.filter(_outside("runs", "base"), lambda r: mixed(r["value"]) & (_ratio(r["value"], table) >= min_ratio))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return spans.select(*keep, held(bare(F.col("base"))).alias("base_spans"), held(bare(added)).alias("added_spans"))


def find_secrets(sets: DataFrame, key: str = "name", text: str = "description", table: list[float] | None = None,
                 samples: int = SAMPLES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Secrets in every parameter set's description.

    One row per input row: ``key``, ``base_spans`` (assignments of passwords, access
    keys, long hexadecimal numbers) and ``added_spans`` (runs of 16 characters or
    more with letters and digits whose log-likelihood ratio under the two Markov
    models reaches ``min_ratio``), each an array of (start, rank, end, kind) in
    characters, end exclusive, by start and rank. Added spans touch no base span.
    ``table`` comes from ``train``; without it the models are trained on ``sets``.
    Missing and empty texts have no spans; keys may be missing or repeat; other
    columns are left out. Built-in functions only.
    """
    if table is None:
        table = train(labelled_samples(sets, text, samples))
    rows = sets.select(F.col(f"`{key}`").alias("key"), text_column(text).alias("text"))
    return _judged(_spans(rows, ["key"]), ["key"], table, min_ratio).withColumnRenamed("key", key)


def mask_secrets(sets: DataFrame, text: str = "description", mask: str = "[SECRET]", table: list[float] | None = None,
                 samples: int = SAMPLES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``sets`` with each stretch of its text that spans cover replaced by ``mask``;
    texts without secrets, missing ones too, stay as they are."""
    if table is None:
        table = train(labelled_samples(sets, text, samples))
    found = _judged(_spans(boxed(sets, text), ["row", "text"]), ["row", "text"], table, min_ratio)
    spans = found.select("row", "text", held(F.sort_array(F.concat("base_spans", "added_spans"))).alias("s"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.substring("text", acc["at"] + 1, x["start"] - acc["at"])
        fresh = F.concat(acc["out"], F.array(F.concat(gap, F.lit(mask))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("s", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"] + 1, F.length("text"))))
    own = [F.when(F.size("s") > 0, masked).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in sets.columns]
    return spans.select(*own)

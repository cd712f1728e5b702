import itertools
import random

import pytest

import corpus_pipeline
from tidebars.llm import similar_sets as m
from tidebars.llm.similar_sets import similar_sets

from .helpers import classes_of

SF = "/root/testdata/sf0.01"


def plain_classes(texts):
    """Classes by comparing all pairs that share a shingle."""
    sets, holders = [], {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        s = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        sets.append(s)
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return classes_of(len(texts), near), near


def test_stage_finds_all_pairs_at_0_8(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "n_chars")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want, near = plain_classes([t for _, t in rows])
    assert sum(rows[a][1] != rows[b][1] for a, b in near) >= 12
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {rows[i][0] for i in set(want)}


@pytest.mark.parametrize("n", [60, 400])
def test_chains_and_groups(spark, n):
    rnd = random.Random(n)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(n):  # changes pile up along a chain, others are spread about one text
        if i % 3 == 0:
            base[rnd.randrange(300)] = f"c{i}"
        w = list(base)
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(300)] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One TWO"), (n + 4, rows[0][1])]
    got = {r["name"]: r["component"] for r in similar_sets(spark.createDataFrame(rows, "name long, description string").repartition(5)).collect()}
    assert [got[i] for i, _ in rows] == plain_classes([t for _, t in rows])[0]


def copies(n, seed=3):
    """A text of 200 words and near copies of it, each with changes of its own; most are too
    far from each other to link, and half too far from the text."""
    rnd = random.Random(seed)
    base = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(200)] = f"v{rnd.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_pairs_do_not_square(spark, monkeypatch):
    counts = {}
    for n in (300, 600):
        made = []
        own = m.materialize

        def counted(df, name="table", own=own, made=made):
            done = own(df, name)
            if name == "pairs":
                made.append(done.count())
            return done

        monkeypatch.setattr(m, "materialize", counted)
        rows = copies(n)
        got = {r["name"]: r["component"] for r in similar_sets(spark.createDataFrame(rows, "name long, description string")).collect()}
        monkeypatch.setattr(m, "materialize", own)
        assert [got[i] for i, _ in rows] == plain_classes([t for _, t in rows])[0]
        counts[n] = sum(made)
    assert counts[600] <= 3 * counts[300]


def test_unusual_rows(spark):
    long = " ".join(f"x{k % 9000}" for k in range(200_000))
    rows = [(None, long), (5, long + " end"), (5, long + " end"), (None, None), (7, ""), (3, "  \n"), (2, "One two"), (9, "one TWO"), (9, "one two three four five six"), (None, "alone")]
    sets = spark.createDataFrame([(*r, "own", 1) for r in rows], "name long, description string, id string, k int").repartition(3)
    got = sorted(((r["name"], r["component"]) for r in similar_sets(sets).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, 3), (7, 3), (3, 3), (2, 2), (9, 2), (9, 9), (None, None)], key=str)
    with pytest.raises(ValueError):
        similar_sets(sets, least=0.5)


def test_empty_table(spark):
    assert similar_sets(spark.createDataFrame([], "name long, description string")).count() == 0


def counted_pairs(spark, monkeypatch, rows):
    """The classes, and how many pairs each step checked exactly."""
    made, own = [], m.materialize

    def counted(df, name="table"):
        done = own(df, name)
        if name == "pairs":
            made.append(done.count())
        return done

    monkeypatch.setattr(m, "materialize", counted)
    got = {r["name"]: r["component"] for r in similar_sets(spark.createDataFrame(rows, "name long, description string")).collect()}
    monkeypatch.setattr(m, "materialize", own)
    return [got[i] for i, _ in rows], made


def test_pairs_below_the_similarity_stay_in_their_band(spark, monkeypatch):
    rnd, n = random.Random(8), 120  # texts of the same blocks, a fifth left out of each: about 0.65 to each other
    blocks = [" ".join(f"b{k}w{i}" for i in range(20)) for k in range(30)]
    rows = [(i, " ".join(b for b in blocks if rnd.random() < 0.8)) for i in range(n)]
    got, made = counted_pairs(spark, monkeypatch, rows)
    assert got == plain_classes([t for _, t in rows])[0]
    assert sum(made[1:]) <= n


def test_fingerprints_link_what_bands_do_not_show(spark, monkeypatch):
    words = [f"w{k}" for k in range(3000)]
    rows = [(i, " ".join([*words, *["end"] * i])) for i in range(3)] + [(3, "a b c d e f"), (4, "other words of a text"), (5, "A b c d e f")]
    monkeypatch.setattr(m, "_first_walk", lambda batches: iter(()))
    assert counted_pairs(spark, monkeypatch, rows)[0] == [0, 0, 0, 3, 4, 3]

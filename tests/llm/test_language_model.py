import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import tidebars.llm.language_model as m


class Plain:
    """The model on plain dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            w = [None, *self.words(t), ""]
            self.one.update(w[1:])
            self.two.update(zip(w, w[1:]))
        self.context = Counter()
        for (a, _), n in self.two.items():
            self.context[a] += n
        self.lost = [self.losses(self.one), self.losses(self.two)]
        self.total = sum(self.one.values())
        self.followers = {}
        for a, b in self.two:
            self.followers.setdefault(a, []).append(b)

    @staticmethod
    def words(t):
        return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]

    @staticmethod
    def losses(counts):
        n = Counter(counts.values())
        a = 6 * n[6] / n[1] if n[1] else 1
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0
            fixed = min(n[1] / (n[1] + 2 * n[2]), 0.5) if n[1] else 0.01
            out[r] = r * (1 - d) if 0 < d < 1 else fixed
        return out

    def p1(self, w):
        lost = lambda c: self.lost[0].get(c, 0.01)
        if self.one[w]:
            return (self.one[w] - lost(self.one[w])) / self.total
        return sum(lost(c) for c in self.one.values()) / self.total if self.total else 1.0

    def p(self, a, w):
        lost = lambda c: self.lost[1].get(c, 0.01)
        if self.two[a, w]:
            return (self.two[a, w] - lost(self.two[a, w])) / self.context[a]
        if not self.context[a]:
            return self.p1(w)
        f = self.followers[a]
        return sum(lost(self.two[a, x]) for x in f) / self.context[a] / (1 - sum(self.p1(x) for x in f)) * self.p1(w)

    def row(self, t):
        w = [None, *self.words(t), ""]
        base = sum(math.log10((self.one[x] + 0.1) / (self.total + 0.1 * (len(self.one) + 1))) for x in w[1:])
        return len(w) - 1, sum(self.one[x] > 0 for x in w[1:]), self.total, base, sum(math.log10(self.p(a, b)) for a, b in zip(w, w[1:]))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "THE", "É", "é"]
    draw = lambda n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    texts = [draw(rnd.randint(0, 40)) for _ in range(150)] + [None, "", " \n\t", "only once here", "passage that repeats\tand repeats"] + ["passage that repeats and\nrepeats"] * 30 + [draw(5000)]
    return [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "w1 w2", 1)]


def test_model_is_normalised(rows):
    model = Plain([t for i, t, _ in rows])
    for a in [None, "the", "w3", "repeats", "never seen"]:
        assert sum(model.p(a, w) for w in [*model.one, "unknown word"]) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("tokens", [50, 1_000_000])
def test_scores(spark, rows, tokens, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(m, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(m, "SLICE_BYTES", 300)
    held = lambda i: i is not None and i % 4 == 0
    model = Plain([t for i, t, _ in rows if not held(i)])
    df = spark.createDataFrame(rows, "name long, description string, score int").repartition(3)
    got = m.score_sets(df, F.col("name") % 4 == 0).collect()
    want = sorted([(str(i), held(i), *model.row(t)) for i, t, _ in rows])
    have = sorted([(str(r["name"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got])
    assert [w[:5] for w in want] == [h[:5] for h in have]
    for w, h in zip(want, have):
        assert h[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_no_rows_and_no_training(spark):
    none = spark.createDataFrame([], "name string, description string")
    assert m.score_sets(none, F.lit(False)).count() == 0
    r = m.score_sets(spark.createDataFrame([("a", "x y")], "name string, description string"), F.lit(True)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


def test_packed_arrays():
    import numpy as np
    a = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (m._unpack_sorted(m._pack_sorted(a)) == a).all() and len(m._unpack(m._pack(a[:0]))) == 0

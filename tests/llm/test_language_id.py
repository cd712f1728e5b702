import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebars.llm import language_id as m
from tidebars.llm.queries import op13_language_id

# Descriptions as authors of parameter sets write them; the category names the language.
NOTES = {
    "de": ["Gleitender Durchschnitt für lange Reihen", "Die Schwelle wird größer, wenn die Kurve ruhig ist", "Ausstieg nach dem zweiten Kreuzen der Linien"],
    "en": ["Moving average for long series", "The threshold grows when the curve is quiet", "Exit after the lines have crossed for the second time"],
    "zh": ["短线卡尔曼滤波参数", "日线均线参数组合", "止损与入场阈值"],
}


def plain(rows, text):
    """The same model by dictionaries, for few words: language and score."""
    if not text or not m.words_of(text):
        return "und", 0.0
    languages = sorted({c for _, c in rows if c})
    counts = [{x: Counter() for x in languages} for _ in range(m.LONGEST + 1)]
    for t, c in rows:
        for w in m.words_of(t or "") if c else []:
            counts[0][c][w] += 1
            for size in range(1, m.LONGEST + 1):
                counts[size][c].update(m.grams_of(w, size))
    texts = Counter(c for _, c in rows if c)
    log = lambda size, x, e: math.log(counts[size][x][e] + m.ADDED) - math.log(counts[size][x].total() + m.ADDED * (len(counts[size][x]) + 1))
    total = {x: math.log(texts[x] / texts.total()) for x in languages}
    for w in m.words_of(text):
        options = [(0, [w])] + [(s, m.grams_of(w, s)) for s in range(m.LONGEST, 0, -1)]
        for size, entries in options:
            known = [e for e in entries if any(counts[size][x][e] for x in languages)]
            if known:
                for x in languages:
                    total[x] += sum(log(size, x, e) for e in known) / len(known)
                break
    best = max(languages, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_against_plain_model(spark):
    rnd = random.Random(5)
    rows = [(t, c) for c, ts in NOTES.items() for t in ts for _ in range(3)]
    rows += [(" ".join(rnd.sample(t.split(), k=2)) if " " in t else t[:3], c) for t, c in rows]
    rows += [(None, "de"), ("", "en"), ("ohne Kategorie", None), ("12 34", "zh")]
    asked = [t for t, _ in rows] + ["Durchschnitte", "averaging 20", "xylophonq", "½ ² 34", "_-_", "均", "Gleitend moving", "ß" * 50_000, "İstanbul ÉTÉ", "éé", "Ω"]
    sets = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, c, 1) for i, (t, c) in enumerate(rows)], "name long, description string, category string, score int").repartition(6)
    model = m.train(sets)
    got = m.identify(spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(asked)], "name long, description string, language string").coalesce(1), model).collect()
    for r, t in zip(got, asked, strict=True):
        language, score = plain(rows, t)
        assert r["language"] == language and r["score"] == pytest.approx(score, abs=1e-4), t[:40]


def test_kept_entries_are_the_most_frequent(spark):
    rows = [("c", "x", "aa aa aa bb bb cc"), ("d", "x", "zz zz zz yy yy aa aa"), ("e", "y", "q q r")]
    model = m.train(spark.createDataFrame(rows, "name string, category string, description string"), words=4)
    assert set(model.words.rows) == {"aa", "zz", "q", "r"}
    learned = m.train(spark.createDataFrame(rows, "name string, category string, description string"), F.col("name") == "e")
    assert learned.languages == ["y"]


def test_hardly_any_rows(spark):
    none = spark.createDataFrame([], "name string, description string, category string")
    assert m.identify(none, m.train(none)).count() == 0
    one = spark.createDataFrame([("a", "some words", None)], "name string, description string, category string")
    assert [tuple(r) for r in m.identify(one, m.train(one)).collect()] == [("a", "und", 0.0)]


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = op13_language_id(spark, sf)
    assert told.count() == docs.count()
    right = told.join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND text IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert told.where("score < 0 OR score > 1 OR (lang_pred = 'und') <> (score = 0)").count() == 0

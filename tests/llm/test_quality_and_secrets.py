import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebars.llm.quality import RULES, Rule, keep_good, quality_report
from tidebars.llm.secrets import find_secrets, labelled_samples, mask_secrets, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = [("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def counts(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, rx, group, least) in enumerate(KINDS) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return [(a, KINDS[k][0], z) for a, k, z in sorted(found)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    pool = ["the", "of", "a", "word", "x\u0085y", "Größe", "🙂", "\xa0", "#", "|", "<b>", "!!", "and", "z"]
    gaps = [" ", " ", " ", "\n", "\t", "  ", "\x0b", "\r\n"]
    out = ["".join(rnd.choice(pool) + rnd.choice(gaps) for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    return out + [None, "", " ", "\n\n", "a b c d e " * 5, "same line here\n" * 40, "one two three four five six seven eight nine ten", "w " * 100000, " lead", "trail "]


def test_counts(spark, texts):
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "a b", 0), (1, texts[1], 0)]
    got = quality_report(spark.createDataFrame(rows, "name long, description string, n_words int")).collect()
    plain = lambda i, t: (str(i), *(c := counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0])
    assert sorted((str(r["name"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted(plain(i, t) for i, t, _ in rows)


def test_verdicts(spark):
    clean = "The word of the day is that " + " ".join(f"word{i}" for i in range(200)) + " and it was with the rest."
    junk = {"symbols": clean.replace(" ", " ### "), "shouting": clean.replace(" ", "!! "), "no stop words": " ".join(f"entry{i}" for i in range(300)), "short": "too few words"}
    rows = [("clean", clean, 1)] + [(k, v, 1) for k, v in junk.items()]
    df = spark.createDataFrame(rows, "name string, description string, kept int")
    assert {r["name"] for r in quality_report(df).collect() if r["kept"]} == {"clean"}
    assert [tuple(r) for r in keep_good(df).collect()] == [("clean", clean, 1)]
    assert keep_good(df, rules=[Rule("none", "n_stop_words", 1e9, None)]).count() == 0
    assert quality_report(df, rules=[]).where("kept").count() == 4 and len(RULES) == 6
    assert quality_report(df.limit(0)).count() == 0


def secret_texts():
    rnd = random.Random(3)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    base64 = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    out = [f"é🙂 set password={hexa(18)} and so on" for _ in range(40)] + [f"key AKIA{base64(16).upper().replace('+', 'A').replace('/', 'B')} here" for _ in range(40)]
    out += [f"token = \"{base64(40)}\" then an{'other' * 5} ordinaryidentifier and some_longer_name_here" for _ in range(40)]
    out += ["ordinary words with internationalisation and 4449473624279964 numbers", None, "", "secret: token: abcdefgh", "API_KEY=abc", "api-key=abcdefg", "passwd='a.b-c_d=e/f+'",
            f"{hexa(40)}\n{hexa(23)}", f"Token={hexa(30)} token='{hexa(30)}'", "AKIAAKIA" + "A" * 11, "tokentoken=abcdef" * 3000]
    # The models need samples of both kinds.
    words = ["value", "stream", "signal", "filter", "window", "series", "order", "trade", "close", "volume", "market", "position"]
    out += [" and ".join("_".join(rnd.choices(words, k=4)) for _ in range(5)) for _ in range(60)]
    return out, f"stray {base64(40)} value"


def test_secrets(spark):
    texts, stray = secret_texts()
    rows = [(i, t, 0) for i, t in enumerate([*texts, stray])] + [(None, texts[0], 0), (1, texts[1], 0)]
    sets = spark.createDataFrame(rows, "name long, description string, base_spans int")
    got = {(str(r["name"]), n): r for n, r in enumerate(find_secrets(sets).collect())}
    by = {}
    for (name, _), r in got.items():
        by[name] = r
    for i, t, _ in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in by[str(i)]["base_spans"]] == base_spans(t)
    assert len(got) == len(rows)
    assert [(s["start"], s["end"]) for s in by[str(len(texts))]["added_spans"]] == [(6, 46)]
    assert not by["123"]["added_spans"] and not any(by[str(i)]["added_spans"] for i in range(80, 120))
    masked = mask_secrets(sets).collect()
    plain = {str(r["name"]): r["description"] for r in masked}
    assert plain[str(len(texts))] == "stray [SECRET] value" and plain["0"] == "é🙂 set [SECRET] and so on" and plain["121"] is None and plain["122"] == ""
    assert masked[0].asDict().keys() == {"name", "description", "base_spans"}


def test_models_tell_held_out_samples_apart(spark):
    rnd = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["value", "stream", "signal", "filter", "window", "series", "order", "trade", "close", "volume"]
    draw = lambda random: "".join(rnd.choice(letters) for _ in range(24)) if random else "_".join(rnd.choices(words, k=4)) + str(rnd.randint(1, 99))
    table = train(spark.createDataFrame([(r, draw(r)) for r in (True, False) for _ in range(400)], "random boolean, value string"))
    rows = [(str(k), draw(k % 2 == 0)) for k in range(200)]
    found = find_secrets(spark.createDataFrame(rows, "name string, description string"), table=table).where(F.size("added_spans") > 0).collect()
    assert sum(int(r["name"]) % 2 == 0 for r in found) >= 95 and sum(int(r["name"]) % 2 for r in found) <= 2


def test_samples_are_bounded_and_tables_can_be_empty(spark):
    texts, _ = secret_texts()
    sets = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "name long, description string")
    assert labelled_samples(sets, samples=7).groupBy("random").count().agg(F.max("count")).first()[0] == 7
    none = sets.limit(0)
    assert find_secrets(none).count() == 0 and mask_secrets(none).count() == 0


def test_digest_of_spans(spark):
    from tidebars.llm import queries
    r = {x["doc_id"]: x for x in queries.op4_secret_scans(spark, "/root/testdata/sf0.001").collect()}
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert set(r) == set(docs)
    for i, t in docs.items():
        told = ",".join(f"{k}:{a}:{z}" for a, k, z in base_spans(t))
        assert hashlib.sha256(told.encode()).hexdigest() == r[i]["base_sha256"]

import itertools
import random

import pytest
import xxhash

from tidebars.llm.near_duplicates import classes, fingerprint, keep_one, links, near_duplicates

from .helpers import classes_of


def plain_fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", "  \n", "One", "one TWO", "Ä b c D", "a b c d e f g h\ti j", "x " * 300000])
def test_fingerprint(text):
    assert fingerprint(text) == signed(plain_fingerprint(text))


@pytest.mark.parametrize("direct", [1, 3, 2048])
def test_links_connect_what_all_pairs_connect(spark, direct):
    rnd = random.Random(5)
    prints = {0, 1, (1 << 64) - 1}
    for _ in range(12):  # dense clouds and chains around centres
        c = rnd.getrandbits(64)
        for _ in range(30):
            x = c
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.choice([3, 5, 9, 31, 32, 40, 50, 63])
            prints.add(x)
        prints.add(c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    prints = sorted(prints)
    near = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    want = classes_of(len(prints), near)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(5)
    got = [(r.a, r.b) for r in links(df, direct=direct).collect()]
    at = {signed(x): i for i, x in enumerate(prints)}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in got)
    assert classes_of(len(prints), [(at[a], at[b]) for a, b in got]) == want


def test_classes(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    want = classes_of(300, edges)
    got = {r.node: r.root for r in classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[n] == root for n, root in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_sets(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(3000))
    rows = [("b", long, 1), ("a", long, 2), ("c", long + " end", 3), ("d", None, 4), ("e", "", 5), (None, "alone here now", 6), (None, "alone here now", 6), ("z", "other text entirely", 7), ("a", long, 2)]
    sets = spark.createDataFrame(rows, "name string, description string, component int")
    got = sorted((str(r["name"]), str(r["component"])) for r in near_duplicates(sets).collect())
    prints = [signed(plain_fingerprint(r[1] or "")) for r in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 2]
    cls = classes_of(len(rows), near)
    least = {c: min((r[0] for r, d in zip(rows, cls) if d == c and r[0] is not None), default=None) for c in cls}
    assert got == sorted((str(r[0]), str(least[c])) for r, c in zip(rows, cls))
    kept = keep_one(sets).collect()
    assert len(kept) == len(set(cls)) and kept[0].asDict().keys() == {"name", "description", "component"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "name long, description string")
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0

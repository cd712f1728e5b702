import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebars.llm.revisits import PERMITTED, canonical_url, resolve_revisits

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "record_id long, url string, ts timestamp_ntz, status int, headers map<string,string>, digest string, hit int"


@pytest.mark.parametrize("url,want", [
    ("HTTP://www.Ex.org:80/a/?utm_source=x&b=2&a=1#top", "ex.org/a?a=1&b=2"), ("https://u:p@ex.org", "ex.org"), ("https://ex.org/?ref=x", "ex.org"),
    (" urn:x#y ", "urn:x"), ("", ""), (None, None), ("http://ex.org/a//", "ex.org/a"),
])
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


def brute(rows):
    out = []
    for i, url, ts, status, headers, _, _ in rows:
        if status != 304:
            continue
        own = {k.lower(): v for k, v in (headers or {}).items()}
        earlier = [r for r in rows if r[3] == 200 and url is not None and ts and r[1] == url and r[2] and (r[2], r[0]) < (ts, i)]
        if not earlier:
            out.append((i, "missing", None, None, own, None))
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        old = {k.lower(): v for k, v in (best[4] or {}).items()}
        tag = lambda h: h["etag"].removeprefix("W/")
        by = "etag" if "etag" in own and "etag" in old else "last-modified" if "last-modified" in own and "last-modified" in old else None
        ok = by and (tag(own) == tag(old) if by == "etag" else own[by] == old[by])
        merged = old | {k: v for k, v in own.items() if k in PERMITTED}
        out.append((i, "resolved" if ok else "mismatch" if by else "unchecked", best[0], by if ok else None, merged if ok else own, best[5] if ok else None))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, hot):
    rnd = random.Random(8)
    urls = ["a.org/1"] * (30 if hot else 1) + ["a.org/2", "b.org", None]
    rows = []
    for i in range(400):
        h = {}
        if rnd.random() < 0.6:
            h["ETag"] = rnd.choice(['"x"', 'W/"x"', '"y"'])
        if rnd.random() < 0.6:
            h["Last-Modified"] = rnd.choice(["m1", "m2"])
        h |= {"Date": f"d{i}", "Content-Length": str(i)}
        ts = None if rnd.random() < 0.03 else T0 + dt.timedelta(hours=rnd.randrange(60))
        rows.append((i, rnd.choice(urls), ts, rnd.choice([200, 200, 304, 304, 404, None]), None if rnd.random() < 0.1 else h, f"p{i}", 0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda t: (t[0], str(t))
    assert sorted(((r["record_id"], r["resolution"], r["refers_to"], r["matched_by"], r["headers"], r["digest"]) for r in got), key=key) == sorted(brute(rows), key=key)


def test_repeated_rows_and_none(spark):
    one = (5, "http://a.org", T0, 304, {"etag": "x"}, None, 0)
    assert resolve_revisits(spark.createDataFrame([one, one], SCHEMA)).count() == 2
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0

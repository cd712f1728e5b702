import datetime
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidebars.llm.manifest import folded_root, leaf_digest, merkle_manifest, proof_digest
from tidebars.llm.queries import op11_merkle_manifest
from tidebars.schema import BARS, KEYS

FIELDS = BARS.fieldNames()


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes, fan_out):
    """Root, and for every leaf its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i // fan_out * fan_out
            paths[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + fan_out])))
        nodes = [h("".join(nodes[k:k + fan_out])) for k in range(0, len(nodes), fan_out)]
        at = [i // fan_out for i in at]
    return nodes[0], paths


def plain(rows, fan_out):
    """rows: (series, order, leaf); per row (leaf, subroot, root, path)."""
    groups = {}
    for i, (series, order, leaf) in enumerate(rows):
        groups.setdefault(series, []).append((order, leaf, i))
    names = sorted(groups, key=lambda s: [(v is not None, (v or "").encode()) for v in s])
    done = {s: (sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])), None) for s in names}
    subs = [tree([r[1] for r in done[s][0]], fan_out) for s in names]
    root, above = tree([s[0] for s in subs], fan_out)
    return [(leaf, sub, root, paths[k] + above[g]) for g, (s, (sub, paths)) in enumerate(zip(names, subs, strict=True)) for k, (_, leaf, _) in enumerate(done[s][0])]


def bar(ticker, k, close=1.5):
    at = None if k is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    return (ticker, "1d", at, 1.0, 2.0, None, close, 10.0)


@pytest.mark.parametrize("fan_out", [2, 3, 16])
def test_bars_against_plain_tree(spark, fan_out):
    rnd = random.Random(fan_out)
    rows = [bar(t, k, rnd.random()) for t, n in [("A", 40), ("B", 1), ("Ä", 17), (None, 5), ("", 16), ("b", 2), ("Z" * 5000, 3)] for k in range(n)]
    rows += [bar("A", 3), bar("A", 3), bar("B", None), bar(None, None)]
    rnd.shuffle(rows)
    bars = spark.createDataFrame(rows, BARS).withColumn("h", F.lit("own")).withColumn("path", F.lit(1)).withColumn("tree", F.lit(1)).repartition(7)
    leaves = [(r["ticker"], r["ts"], r["leaf"]) for r in bars.select("ticker", "ts", leaf_digest(FIELDS).alias("leaf")).collect()]
    want = sorted(plain([((t,), None if ts is None else ts.timestamp(), leaf) for t, ts, leaf in leaves], fan_out))
    made = merkle_manifest(bars, keep=[*KEYS, "ts", "path"], fan_out=fan_out)
    got = made.select("row", "leaf", "subroot", "root", "path", proof_digest("path").alias("proof"), folded_root("leaf", "path").alias("folded"),
                      folded_root(F.sha2(F.concat("leaf", F.lit("x")), 256), "path").alias("changed")).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["path"]]) for r in got) == want
    assert all(r["folded"] == r["root"] != r["changed"] for r in got)
    assert all(r["proof"] == h("".join(s["before"] + s["after"] for s in r["path"])) for r in got)
    assert sorted(r["row"]["ticker"] or "" for r in got) == sorted(r[0] or "" for r in rows)


def test_leaf_is_what_it_says(spark):
    row = spark.createDataFrame([(7, None, "é", 2)], "doc_id long, source string, text string, n_chars int")
    assert row.select(leaf_digest(["doc_id", "source", "n_chars", "text"])).first()[0] == h(told([7, None, 2, "é"]))


def test_hardly_any_rows(spark):
    assert merkle_manifest(spark.createDataFrame([], BARS)).count() == 0
    only = merkle_manifest(spark.createDataFrame([(None,) * 8], BARS)).first()
    assert only["leaf"] == only["subroot"] == only["root"] == h("-" * 8) and only["path"] == []


def test_query_against_plain_tree(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect())
    leaves = [((r[1],), r[0], h(told(r))) for r in docs]
    want = {leaf: (sub, root, path) for leaf, sub, root, path in plain(leaves, 16)}
    got = op11_merkle_manifest(spark, sf).collect()
    assert len(got) == len(docs)
    assert all((r["subroot"], r["root"]) == want[r["leaf"]][:2] and r["proof_sha256"] == h("".join(a + b for a, b in want[r["leaf"]][2])) for r in got)
    broken = {r["doc_id"] for r in got if not r["verified"]}
    assert broken == {r[0] for r in docs if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] and any("A" <= c <= "Z" for c in r[4])}

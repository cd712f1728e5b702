import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import tidebars.llm.alignment as m
from tidebars.llm.queries import op12_cross_tokenizer_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENS, PIECES = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
TOKENS.encode_special_tokens = True


def plain(texts):
    """Whole texts by both libraries, links by comparing all byte ranges of a group."""
    every, out = [], []
    spelled = m._byte_of()
    for t in texts:
        a = TOKENS.encode(" " + (t or ""), add_special_tokens=False)
        b = PIECES.encode(t or "")
        of_a = [bytes(spelled[c] for c in x) for x in a.tokens]
        of_b = [bytes([int(PIECES.id_to_piece(i)[1:-1], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + t).encode() if t else None
        if b"".join(of_a) != want or b"".join(of_b) != want:
            every.append(([], [], [], []))
            continue
        spans = []
        for sizes in (of_a, of_b):
            at, own = 0, []
            for s in sizes:
                own.append((at, at + len(s)))
                at += len(s)
            spans.append(own)
        links = [(a.ids[i], b[j]) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q] if len(a.ids) < 3000 else None
        ends = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        groups, last = [], 0
        for e in ends:
            groups.append([",".join(str(i) for i, (p, q) in zip(ids, own, strict=True) if last <= p and q <= e) for ids, own in ((a.ids, spans[0]), (b, spans[1]))])
            last = e
        every.append((a.ids, b, ["|".join(g) for g in groups], links))
    count = Counter(x for *_, links in every for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for a, b, groups, links in every:
        said = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), said))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def some_texts():
    rnd = random.Random(12)
    pool = ["the", "Größe", " ", "  ", "\n", "\n ", " \n", "\t", "don't", "x=12;", "日本語", "🙂", "\xa0", "　", "é", "<|endoftext|>", "<s>", "<0x41>", "\r\n", ";\r", "​", "ab", "\x00", "é"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    return [*texts, "", None, " ", "   ", "\n", "a ▁ b", "moving average", texts[0], texts[0]]


@pytest.mark.parametrize("small", [False, True])
def test_against_whole_texts(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(m, "BLOCK_CHARS", 300)
        monkeypatch.setattr(m, "KEPT_PARTS", 50)
    texts = some_texts()
    rows = [(i // 2 if i else None, t, "x") for i, t in enumerate(texts)]
    sets = spark.createDataFrame(rows, "name long, description string, links string").withColumn("block", F.lit(1)).repartition(5)
    got = [(r["name"], *[r[c] for c in COLUMNS]) for r in m.align_tokenizers(sets, A_PATH, B_PATH).collect()]
    assert sorted(map(str, got)) == sorted(str((r[0], *w)) for r, w in zip(rows, plain(texts), strict=True))


def test_long_text(spark):
    part = "Filter\n  über 12 bars;"
    once = plain([part])[0]
    r = m.align_tokenizers(spark.createDataFrame([("a", " ".join([part] * 30_000))], "name string, description string"), A_PATH, B_PATH).first()
    assert [r[c] for c in COLUMNS[:4]] == [30_000 * n for n in once[:4]]
    assert r["count_sum"] >= 30_000 * r["n_best"] > 0
    assert [list(x) for x in m.align([2, 3], [1, 3, 1])] == [[2], [3], [0, 0, 1, 1], [0, 1, 1, 2]]


def test_no_rows(spark):
    assert m.align_tokenizers(spark.createDataFrame([], "name string, description string"), A_PATH, B_PATH).count() == 0


def test_query_against_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op12_cross_tokenizer_alignment(spark, sf).collect()}
    want = dict(zip([r["doc_id"] for r in docs], plain_shapes([r["text"] for r in docs]), strict=True))
    assert len(got) == len(docs)
    for k, w in want.items():
        assert tuple(got[k][c] for c in ("n_a", "n_b", "n_groups", "groups_sha256")) == w


def plain_shapes(texts):
    """Ids and groups only, in linear time, by cutting both texts at common ends."""
    out = []
    spelled = m._byte_of()
    for t in texts:
        a, b = TOKENS.encode(" " + (t or ""), add_special_tokens=False), PIECES.encode(t or "")
        of_a = [len(x) for x in a.tokens]
        of_b = [1 if PIECES.is_byte(i) else len(PIECES.id_to_piece(i).replace("▁", " ").encode()) for i in b]
        assert all(c in spelled for x in a.tokens for c in x)
        if not t or sum(of_a) != sum(of_b):
            out.append((0, 0, 0, ""))
            continue
        said, p, q, i, j, at_i, at_j = [], 0, 0, 0, 0, 0, 0
        while i < len(of_a) or j < len(of_b):
            if p <= q:
                p, i = p + of_a[i], i + 1
            if q < p:
                q, j = q + of_b[j], j + 1
            if p == q:
                said.append(",".join(map(str, a.ids[at_i:i])) + "|" + ",".join(map(str, b[at_j:j])))
                at_i, at_j = i, j
        out.append((len(a.ids), len(b), len(said), hashlib.sha256(";".join(said).encode()).hexdigest()))
    return out


def test_parts_that_come_back_are_encoded_once(monkeypatch):
    work, encoded = m._Aligner(A_PATH, B_PATH, 15, "<u4"), []

    def encode(parts):
        encoded.extend(parts)
        work.known.update(dict.fromkeys(parts))
        return True

    monkeypatch.setattr(work, "_encode", encode)
    for _ in range(3):
        for at in range(0, 100_000, 10_000):
            work.learn({f" {i}" for i in range(at, at + 10_000)})
    assert len(encoded) == 100_000
    assert len(work.known) + len(work.older) <= 2 * (m.KEPT_PARTS + 10_000)


def test_align_against_ranges():
    rnd = random.Random(7)
    for _ in range(300):
        size, lists = rnd.randint(0, 30), []
        for _ in "ab":
            ends = sorted({*rnd.sample(range(1, size), rnd.randint(0, size - 1)), size}) if size else []
            lists.append([y - x for x, y in zip([0, *ends], ends, strict=False)])
        spans = [[(sum(own[:i]), sum(own[:i + 1])) for i in range(len(own))] for own in lists]
        common = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        links = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q]
        cuts_a, cuts_b, of_a, of_b = m.align(*lists)
        assert [cuts_a, cuts_b] == [[[q for _, q in own].index(e) + 1 for e in common] for own in spans]
        assert list(zip(of_a.tolist(), of_b.tolist(), strict=True)) == links

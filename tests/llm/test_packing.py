import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidebars.llm.packing import pack_sets, plan
from tidebars.llm.queries import byte_tokens

TOKENS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, length=2048):
    """Every token of every text lies once in the sequences, gapless."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["name"], []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    for name, text in texts:
        ids = [*TOKENS.encode(text or "", add_special_tokens=False).ids, 0]
        cut = sorted(by_doc[name], key=lambda r: r["piece"])
        assert [r["piece"] for r in cut] == list(range(len(cut))) and sum(r["length"] for r in cut) == len(ids)
        assert all(r["length"] == length for r in cut[1:])
        for r in cut:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    return len(by_seq)


def first_fit(sizes, length=2048):
    room = []
    for s in sorted(sizes, reverse=True):
        k = next((i for i, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(length - s)
        else:
            room[k] -= s
    return len(room)


def test_sets(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice(["ab ", "ó\n", "x9 ", "  ", "!?"]) for _ in range(rnd.choice([1, 20, 300, 900])))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "a <|endoftext|> b"), (1003, "word " * 9000), (1004, "  \t日本 x" * 3), (1005, "one " * 2047), (1006, "one " * 4096)]
    sets = spark.createDataFrame([(*t, 1) for t in texts], "name long, description string, piece int")
    rows = pack_sets(sets, **byte_tokens()).collect()
    assert check(rows, texts) <= first_fit([r["length"] for r in rows])


def test_repeated_rows_null_keys_and_no_rows(spark):
    sets = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "a b")], "name long, description string")
    rows = pack_sets(sets, **byte_tokens()).collect()
    assert sorted(r["offset"] for r in rows) == [0, 3, 6] and len({r["sequence_id"] for r in rows}) == 1
    assert pack_sets(sets.limit(0), **byte_tokens()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    length = rnd.choice([16, 64, 2048])
    counts = {rnd.randint(1, length): rnd.choice([1, 2, 5, 1000, 10**9]) for _ in range(rnd.choice([1, 5, length]))}
    kinds = plan(counts, length)
    got = {}
    for kind, times in kinds:
        assert sum(kind) <= length and times > 0
        for s in kind:
            got[s] = got.get(s, 0) + times
    assert got == counts
    assert len(kinds) < 8 * length


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_least(seed):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(20000):
        s = min(2048, int(rnd.expovariate(1 / 400)) + 1)
        counts[s] = counts.get(s, 0) + 1
    used = sum(t for _, t in plan(counts))
    assert used <= -(-sum(s * n for s, n in counts.items()) // 2048) + 1


def test_exact_complements():
    assert sorted(plan({1500: 2, 548: 1, 300: 1, 248: 1}), key=str) == [([1500, 300, 248], 1), ([1500, 548], 1)]
    assert plan({1000: 1, 500: 1, 300: 1, 248: 1}) == [([1000, 500, 300, 248], 1)]

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidebars.llm.byte_pairs import Merges, _alone, decode, encode, replay
from tidebars.llm.packing import read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
ENC = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    pool = ["the", "Größe", "  ", "\n", "\t\n ", "don't", "x=12;", "日本語", "Привет", "🙂", "\xa0", " ", "aaaa" * 9, "'s", " ", "é", "\x1c", "1234567", "<|endoftext|>", "\r\n\r\n", "über"]
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return out + ["", " ", "\n\n", "ab" * 50000, "a" * 20001, "".join(chr(c) for c in range(0x20, 0x3000))]


def test_round_trip_and_library_ids(spark, texts):
    sets = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(-1, None, 0), (3, texts[3], 0)], "name long, description string, ids int")
    rows = decode(encode(sets, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r["name"]] if r["name"] >= 0 else ""
        assert r["ids"] == ENC.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_long_text_in_blocks(spark, monkeypatch, texts):
    import tidebars.llm.byte_pairs as m
    monkeypatch.setattr(m, "BLOCK_CHARS", 50)
    monkeypatch.setattr(m, "KNOWN_PARTS", 5)
    block = m._Block(PATH, public_tokenizers.PATTERN)
    for t in texts[:100]:
        assert [int(i) for a in block.encode(t) for i in a] == ENC.encode_ordinary(t)


def test_no_rows(spark):
    none = spark.createDataFrame([], "name string, description string")
    assert decode(encode(none, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_lower_rank_after_a_merge():
    # bc (3) comes before abc (2) can be made from a and bc: a merge brings a lower rank about.
    own = {b"abc": 2, b"bc": 3, b"abcx": 1, b"aa": 4, b"aaa": 5, b"xbc": 0, b"cab": 6}
    merges = Merges({bytes([b]): 1000 + b for b in range(256)} | own)
    rnd = random.Random(6)
    words = [b"abcbc", b"bcabcx", b"abcabcbcx", b"", b"aaaaaaa", *["".join(rnd.choice("abcx") for _ in range(rnd.randint(1, 30))).encode() for _ in range(400)]]
    enc = tiktoken.Encoding("o", pat_str=r"[a-z]+", mergeable_ranks=merges.ranks, special_tokens={})
    want = [enc.encode_ordinary(w.decode()) if w else [] for w in words]
    assert [_alone(w, merges) for w in words] == [x if w not in own else _alone(w, merges) for w, x in zip(words, want)]
    got = [np.frombuffer(x, np.int32).tolist() for x in replay(words, merges)]
    assert all(a == b for w, a, b in zip(words, got, want) if w not in own)

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import tidebars.llm.token_counts as m

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENS = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("small", [False, True])
def test_counts(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(m, "BLOCK_ROWS", 7)
        monkeypatch.setattr(m, "BLOCK_CHARS", 100)
    rnd = random.Random(4)
    pool = ["the", "Größe", "  ", "\n", "\t\n ", "don't", "x=12;", "日本語", "🙂", "\xa0", "aaaa" * 9, " ", "é", "<|endoftext|>", "\r\n"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(200)] + ["", " ", "the " * 70000, None, "  <|endoftext|>  x"]
    rows = [(i // 2, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (0, texts[0], 1)]
    got = m.count_tokens(spark.createDataFrame(rows, "name long, description string, row int").repartition(3), PATH, public_tokenizers.PATTERN, limit=50).collect()
    want = [(str(k), len((t or "").encode()), n := len(TOKENS.encode(t or "", add_special_tokens=False).ids), n > 50) for k, t, _ in rows]
    assert sorted((str(r["name"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(want)


def test_no_rows(spark):
    assert m.count_tokens(spark.createDataFrame([], "name string, description string"), PATH, public_tokenizers.PATTERN).count() == 0

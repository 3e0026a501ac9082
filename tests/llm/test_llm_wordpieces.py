from __future__ import annotations

import random

import public_tokenizers
import pytest
from llm_tools import documents

from sondera.llm import wordpieces

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _greedy(word: bytes, pieces: set[bytes], longest: int) -> int:
    n = 0
    while word:
        size = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces)
        word, n = word[size:], n + 1
    return n


def test_small_vocabularies_equal_plain_greedy_matching():
    r = random.Random(4)
    for _ in range(30):
        pieces = {bytes([c]) for c in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 6))) for _ in range(r.randint(1, 40))}
        a = wordpieces.Automaton(sorted(pieces))
        ws = [b"", *(bytes(r.choice(b"abcd") for _ in range(r.randint(1, 25))) for _ in range(200))]
        assert a.count(ws).tolist() == [_greedy(w, pieces, 6) for w in ws]


def test_a_vocabulary_without_all_bytes_is_an_error():
    with pytest.raises(ValueError):
        wordpieces.Automaton([b"a", b"ab"])


def _want(text, pieces, longest):
    n = [_greedy(b" " + w, pieces, longest) for w in (text or "").encode().split()]
    return len(n), sum(n), max(n, default=0)


def test_documents(spark, sf):
    pieces = set(wordpieces.load_ranks(PATH))
    longest = max(map(len, pieces))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 5000), (5, "same"), (5, "same"), (None, "no id 東京 é")]
    got = [tuple(r) for r in wordpieces.count_tokens(documents(spark, rows), PATH).collect()]
    assert sorted(got, key=repr) == sorted(((i, *_want(t, pieces, longest)) for i, t in rows), key=repr)
    assert wordpieces.count_tokens(documents(spark, []), PATH).count() == 0
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in wordpieces.count_tokens(d, PATH).collect():
        assert tuple(r)[1:] == _want(texts[r["doc_id"]], pieces, longest)

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_tools import documents
from tokenizers import Tokenizer

from sondera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _one_at_a_time(lengths, capacity):
    """Best-fit decreasing, piece by piece: the contents of the bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(n)
        else:
            bins.append([n])
    return Counter(tuple(b) for b in bins)


def test_tree_finds_the_tightest_bin():
    r = random.Random(1)
    tree, some = packing.FreeTree(100), set()
    for _ in range(3000):
        x = r.randint(1, 100)
        tree.set(x, x not in some)
        some ^= {x}
        n = r.randint(1, 100)
        assert tree.least(n) == min((v for v in some if v >= n), default=-1)


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 37, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.choice([1, 5, 60, 300]))]
    ranges, n_bins = packing.plan(Counter(lengths), capacity)
    content: dict[int, list] = {}
    ranks: dict[int, list] = {}
    for length, rank, n, first, offset in ranges.tolist():
        for i in range(n):
            content.setdefault(first + i, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + i)
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert Counter({n: len(v) for n, v in ranks.items()}) == Counter(lengths)
    for items in content.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(content) == n_bins
    assert n_bins == sum(_one_at_a_time(lengths, capacity).values())


def _check(rows, got, capacity):
    tok = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), capacity):
            want.append((doc, p // capacity, p, len(ids[p : p + capacity]), zlib.crc32(np.array(ids[p : p + capacity], "<u4").tobytes())))
    assert sorted((tuple(g)[:5] for g in got), key=repr) == sorted(want, key=repr)
    bins: dict[int, list] = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_digest(spark):
    r = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(r.randint(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long text " * 400), (None, "no id"), (7, "same"), (7, "same")]
    got = packing.digest(documents(spark, rows), PATH, capacity=64).collect()
    n = _check(rows, got, 64)
    assert n == sum(_one_at_a_time([g["length"] for g in got], 64).values())
    assert packing.digest(documents(spark, []), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = [(1, "a b c"), (2, "d e"), (3, "f " * 20)]
    tok = Tokenizer.from_file(PATH)
    packed = packing.pack(documents(spark, rows), PATH, capacity=16)
    out = packing.sequences(packed).collect()
    assert sorted(x for s in out for x in s["ids"]) == sorted(x for _, t in rows for x in [*tok.encode(t, add_special_tokens=False).ids, 1])
    assert all(len(s["ids"]) <= 16 and s["offsets"] == sorted(s["offsets"]) for s in out)


def test_query_over_whole_table(spark, sf):
    from sondera.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op4_best_fit_packing(spark, sf).collect()
    n = _check(rows, got, 4096)
    assert n == sum(_one_at_a_time([g["length"] for g in got], 4096).values())

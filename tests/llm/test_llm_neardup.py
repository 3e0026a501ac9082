from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_tools import documents, lower, sentence, words

from sondera.llm import neardup
from sondera.llm.components import components


def _sets(rows, k):
    out = {}
    for i, t in rows:
        w = words(lower(t or ""))
        out[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def _want(rows, k, percent):
    sets = _sets(rows, k)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = [(i, len(sets[i]), root(i), root(i) == i) for i in ids]
    return out + [(None, len(sets[None]), None, True) for i in sets if i is None]


def _edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def _corpus(seed):
    r = random.Random(seed)
    rows, at = [], 0
    for size, edits in ((1, 0), (5, 0), (8, 2), (25, 4), (30, 6), (12, 9)):
        base = sentence(r, r.choice([40, 150, 300]))
        for _ in range(size):
            rows.append((at, _edited(r, base, r.randint(0, edits))))
            at += 1
    chain = sentence(r, 200)
    for _ in range(25):  # each is near its neighbours only
        chain = _edited(r, chain, 4)
        rows.append((at, chain))
        at += 1
    for n in (1, 2, 3, 4, 7, 8, 9):
        t = sentence(r, n)
        rows += [(at, t), (at + 1, t.upper()), (at + 2, t + " more")]
        at += 3
    rows += [(at + i, sentence(r, r.randint(20, 200))) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, None), (None, rows[3][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_groups_equal_all_pairs(spark, seed, k, percent):
    rows = _corpus(seed)
    got = neardup.deduplicate(documents(spark, rows), k, percent)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_want(rows, k, percent), key=repr)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (3, "x")]
    got = sorted(map(tuple, neardup.deduplicate(documents(spark, rows), 3, 85).collect()))
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 3, True)]
    assert neardup.deduplicate(documents(spark, []), 3, 85).count() == 0


def test_different_texts_of_one_doc_id_link_for_both(spark):
    r = random.Random(3)
    a, b, c = (sentence(r, 90) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (3, b + " z"), (4, c), (5, c + " z"), (1, None), (6, c), (6, sentence(r, 50))]
    got = neardup.deduplicate(documents(spark, rows), 3, 85).collect()
    assert len(got) == len(rows)
    assert {(x["doc_id"], x["component_id"], x["kept"]) for x in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (6, 4, False)}


def test_a_large_group_of_copies_with_few_blocks(spark):
    """A third of all rows are near copies of one text; hub groups span blocks."""
    r = random.Random(7)
    base = sentence(r, 120)
    rows = [(i, _edited(r, base, r.randint(0, 5))) for i in range(150)] + [(1000 + i, sentence(r, 60)) for i in range(150)]
    got = neardup.deduplicate(documents(spark, rows), 3, 85)
    assert sorted(map(tuple, got.collect())) == sorted(_want(rows, 3, 85))


def test_estimates_are_close():
    r = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.6, 0.85, 1.0):
        est = []
        for _ in range(200):
            both = r.integers(0, 2**64, int(400 * share), dtype=np.uint64)
            x, y = (np.unique(np.concatenate([both, r.integers(0, 2**64, 400 - len(both), dtype=np.uint64)])) for _ in range(2))
            j, n = neardup.estimate(neardup.registers(x)[None], neardup.registers(y)[None])
            est.append(j[0])
        true = share / (2 - share)
        assert abs(np.mean(est) - true) < 0.02


def test_registers_by_definition():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64))
    got = neardup.registers(hashes)
    for b in range(neardup.M):
        mine = [int(h) & ((1 << 57) - 1) for h in hashes if int(h) >> 57 == b]
        if not mine:
            assert got[b] == 0
        else:
            bits = f"{min(mine):057b}" + "1" * 20
            zeros = len(bits) - len(bits.lstrip("0"))
            assert got[b] == ((zeros + 1) << 10) | int(bits[zeros + 1 : zeros + 11], 2)


def test_shingles_of_a_very_long_text():
    t = sentence(random.Random(2), 200_000, 10**9)
    (s,) = neardup.shingle_sets(pa.array([t]), 5)
    assert len(s) == len(_sets([(1, t)], 5)[1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 104)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

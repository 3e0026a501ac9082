from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm_tools import ALNUM, documents, lower, sentence, words

from sondera.llm import decontaminate as dc


def _want(docs, items, window=13):
    wins: dict[tuple, set] = {}
    for name, text in items:
        if name is not None:
            w = words(lower(text or ""), ALNUM)
            size = min(window, len(w))
            for i in range(len(w) - size + 1) if w else ():
                wins.setdefault(tuple(w[i : i + size]), set()).add(name)
    out = []
    for doc, text in docs:
        w = words(lower(text or ""), ALNUM)
        hit, found = set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if got := wins.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= got
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def _bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, doc_id string")


def _cases():
    r = random.Random(6)
    items = [(f"i{k}", sentence(r, r.choice([2, 5, 12, 13, 14, 30]), 3000)) for k in range(30)] + [("empty", ""), ("null", None), ("marks", "?! ..."), ("i1", "A second text of the very same item, longer than thirteen words in all, as it is"), ("few", "one-two")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, "One, TWO"), (4, "One, TWO"), (None, items[3][1])]
    for k in range(80):
        parts = [sentence(r, r.randint(0, 200), 3000)]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items[:30])[1])
            a = r.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[a : a + r.randint(8, 30)]).upper(), sentence(r, r.randint(0, 5), 3000)]
        docs.append((10 + k, r.choice([" ", "\n", " - "]).join(parts)))
    # Few distinct words: many equal hashes and ties.
    items += [("t1", "a b " * 9), ("t2", "a a a a a a a a a a a a a a")]
    docs += [(200 + k, " ".join(r.choice("ab") for _ in range(60))) for k in range(20)] + [(300, "a " * 40), (301, "a b " * 30)]
    return docs, items


@pytest.mark.parametrize("full", [False, True])
def test_hits_equal_the_plain_ones(spark, full, monkeypatch):
    docs, items = _cases()
    if full:  # as of a benchmark that sets all bits: every window is a candidate
        monkeypatch.setattr(dc.members, "bits", lambda at: np.full(1 << (dc.members.BITS - 3), 255, np.uint8))
    got = dc.decontaminate(documents(spark, docs), _bench(spark, items))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got.collect()], key=repr) == _want(docs, items)


def test_digest_of_items(spark):
    items = [("b", "x y"), ("a", "x y"), ("10", "x y"), ("9", "x y")]
    r = dc.digest(dc.decontaminate(documents(spark, [(1, "x y z")]), _bench(spark, items))).first()
    assert r["n_items"] == 4 and r["items_sha256"] == hashlib.sha256(b"10,9,a,b").hexdigest()


def test_empty_tables(spark):
    docs, items = _cases()
    assert dc.decontaminate(documents(spark, []), _bench(spark, items)).count() == 0
    got = dc.decontaminate(documents(spark, docs[:10]), _bench(spark, [])).collect()
    assert len(got) == 10 and not any(r["contaminated"] or r["n_hit"] for r in got)


def test_winnowing_selects_in_every_window():
    r = np.random.default_rng(0)
    for n in (0, 1, 6, 7, 8, 500):
        h = r.integers(0, 40, n).astype(np.uint64)
        at = dc.winnow(h, 7)
        for i in range(n - 6):
            inside = at[(at >= i) & (at < i + 7)]
            assert len(inside) and h[inside].min() == h[i : i + 7].min()
        first = np.array([0, n + 6]) if n else np.array([0, 0])
        assert n or len(dc.selected(h, first, 7, 7)[0]) == 0


def test_a_very_long_text(spark):
    r = random.Random(1)
    item = sentence(r, 20)
    text = sentence(r, 100_000) + " " + item + " " + sentence(r, 100_000)
    got = dc.decontaminate(documents(spark, [(1, text)]), _bench(spark, [("i", item)])).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (200_020, 20, False)


def test_clean_rows_stay_whatever_their_ids(spark):
    docs, items = _cases()
    docs += [(4, "words of its own " * 20), (4, items[5][1]), (None, "no id but clean"), (None, None), (7, ""), (7, None)]
    bad = {(d, t) for (d, t) in docs if _want([(d, t)], items)[0][4]}
    got = dc.keep_clean(documents(spark, docs), _bench(spark, items))
    assert got.columns == documents(spark, []).columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted([d for d in docs if d not in bad], key=key)

"""Whole passages of short lines, whatever stands before and behind them."""

from __future__ import annotations

import random

import pytest
from llm_tools import documents, sentence

from sondera.llm import linededup as ld


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(21)
    passages = ["\n".join(sentence(r, -(-54 // n), 10**7) for _ in range(n)) for n in (2, 3, 4, 5, 6, 9) for _ in range(12)]
    passages += ["\n".join([sentence(r, 45, 10**7), "", sentence(r, 6, 10**7), sentence(r, 2, 10**7), ""]) for _ in range(6)]
    rows = []
    for k, p in enumerate(passages):
        for c in range(3):
            own = ["\n".join(sentence(r, r.randint(4, 14), 10**7) for _ in range(r.randint(1, 7))) for _ in range(2)]
            rows.append((10 * k + c, f"{own[0]}\n{p}\n{own[1]}", f"{own[0]}\n{own[1]}"))
    return passages, rows


def test_short_lined_passages_go_whole(spark, corpus):
    passages, rows = corpus
    r = random.Random(0)
    shuffled = rows[:]
    r.shuffle(shuffled)
    got = {x["doc_id"]: x["text"] for x in ld.dedup_passages(documents(spark, [(i, t) for i, t, _ in shuffled])).collect()}
    for i, text, own in rows:
        assert got[i] == (text if i % 10 == 0 else own), i


def _plain(rows, least=50):
    """Every run of lines of ``least`` words that occurs before goes; over all pairs of runs."""
    split = {i: t.split("\n") for i, t in rows}
    first, runs = {}, []
    for i in sorted(split):
        ls = split[i]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(len(x.split()) for x in ls[a:b]) >= least:
                    k = tuple(ls[a:b])
                    runs.append((i, a, b, *first.setdefault(k, (i, a))))
    gone = {i: set() for i in split}
    for i, a, b, d, f in runs:
        if (i, a) != (d, f):
            gone[i] |= set(range(max(a, f + b - a) if d == i else a, b))
    return {i: "\n".join(x for n, x in enumerate(ls) if n not in gone[i]) for i, ls in split.items()}


def test_equals_all_pairs_of_runs(spark):
    r = random.Random(5)
    pool = [sentence(r, r.randint(8, 30), 10**7) for _ in range(40)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(1, 4)):
            a = r.randrange(38)
            lines += [sentence(r, 9, 10**7), *pool[a : a + r.randint(1, 9)]]
        rows.append((i, "\n".join(lines)))
    rows += [(100, "\n".join(["one two three"] * 90)), (101, pool[0])]
    # A divisor without boundaries: only runs of 50 words are counted.
    got = {x["doc_id"]: (x["text"], x["_chars_removed"]) for x in ld.dedup_passages(documents(spark, rows), divisor=1 << 62).collect()}
    want = _plain(rows)
    text = dict(rows)
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(text[i]) - len(t) for i, (t, n) in got.items())


def test_rows_of_one_document_and_odd_texts(spark, corpus):
    passages, _ = corpus
    p = passages[0]
    rows = [(1, p), (1, p), (1, "another text\n" + passages[30]), (2, "own\n" + p), (3, passages[30] + "\nown"), (4, None), (5, ""), (None, p), (6, "\n\n"), (7, "\n\n")]
    got = sorted(((x["doc_id"], x["text"]) for x in ld.dedup_passages(documents(spark, rows)).collect()), key=repr)
    want = [(1, p), (1, p), (1, "another text\n" + passages[30]), (2, "own"), (3, "own"), (4, None), (5, ""), (None, p), (6, "\n\n"), (7, "\n\n")]
    assert got == sorted(want, key=repr)
    assert ld.dedup_passages(documents(spark, [])).count() == 0


def test_runs_of_equal_keys_and_other_bytes_stay(spark, monkeypatch):
    docs = documents(spark, [(1, "x " * 60), (2, "y " * 60), (3, "x " * 60)])
    marked = ld.repeated(docs)
    assert ld.unequal_runs(marked).count() == 0
    from pyspark.sql import functions as F

    changed = marked.withColumn("text", F.when(F.col("doc_id") == 1, F.lit("z " * 60)).otherwise(F.col("text")))
    assert [r["doc_id"] for r in ld.unequal_runs(changed).collect()] == [3]


def test_columns_of_the_names_used_inside(spark):
    r = random.Random(5)
    passage = "\n".join(sentence(r, 30) for _ in range(3))
    rows = [(1, sentence(r, 20) + "\n" + passage, 7, "a", 1, 2, 3), (2, sentence(r, 20) + "\n" + passage, 8, "b", 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _chunks_removed int, _doc string, _again int, _stay int, _chars_removed int")
    out = ld.dedup_passages(docs)
    assert out.columns == [*docs.columns, "_chunks_removed_", "_chars_removed_"]
    got = {x["doc_id"]: x for x in out.collect()}
    assert passage in got[1]["text"] and passage not in got[2]["text"]
    assert (got[2]["_chunks_removed"], got[2]["_chunks_removed_"], got[2]["_again"]) == (8, 1, 4)

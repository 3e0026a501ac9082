from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_tools import documents
from tokenizers import Tokenizer

from sondera.llm import tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_code_round_trip(n):
    r = np.random.default_rng(n)
    ranks = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    if n > 3:
        ranks[:4] = [0, 255, 2**32 - 1, 65536]
    control, data = tokenstore.encode(ranks)
    assert len(control) == -(-n // 4)
    assert (tokenstore.decode(control, data, n) == ranks).all()


def _want(rows):
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def _read(spark, rows, **k):
    store = tokenstore.write(documents(spark, rows), PATH, **k)
    return [tuple(r) for r in tokenstore.read(spark, store, with_ids=True).orderBy("start").collect()]


@pytest.mark.parametrize("part_ids", [50, 1 << 24])
def test_files_hold_all_ids_in_order(spark, part_ids):
    rows = [(9, "The cat sat."), (3, None), (5, ""), (7, "long " * 3000), (None, "no id"), (-2, "minus\n\nlines  and é")]
    got = _read(spark, rows, part_ids=part_ids)
    assert got == _want(rows)


def test_repeated_rows_all_appear(spark):
    rows = [(1, "same"), (1, "same"), (1, "other words"), (2, "b")]
    got = _read(spark, rows)
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted((w[0], w[2], w[3]) for w in _want(rows))
    assert [g[1] for g in got] == list(np.cumsum([0, *(g[2] for g in got)])[:-1])


def test_empty_table(spark):
    assert _read(spark, []) == []


def test_frequent_ids_have_small_ranks(spark):
    store = tokenstore.write(documents(spark, [(1, "a a a a b b")]), PATH)
    tok = Tokenizer.from_file(PATH)
    assert store.ids_by_rank[0] == tok.token_to_id("Ġa")


def test_query_over_whole_table(spark, sf):
    from sondera.llm import queries

    got = {r["doc_id"]: tuple(r) for r in queries.op1_token_ids(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == {w[0]: w[:4] for w in _want(rows)}

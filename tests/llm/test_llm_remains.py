"""What the pipeline's line dedup keeps of documents that lose a passage."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from llm_tools import documents, sentence


def test_own_words_stay_and_copies_go(spark):
    r = random.Random(8)
    notice = sentence(r, 60, 10**7)
    own = {i: sentence(r, n, 10**7) for i, n in ((1, 100), (2, 45), (3, 1))}
    rows = [(i, t + "\n" + notice) for i, t in own.items()] + [(4, notice), (5, "\n" + notice + "\n"), (6, "short"), (7, ""), (8, None)]
    out = cp.line_stage(spark, documents(spark, rows), "")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in out.collect()}
    want = {1: rows[0][1], 2: own[2], 3: own[3], 6: "short", 7: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()} | {8: (None, None)}

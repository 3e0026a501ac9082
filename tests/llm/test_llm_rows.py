"""Decontamination gives a row for each row, whatever its doc_id."""

from __future__ import annotations

import random

from llm_tools import documents, sentence
from test_llm_decontaminate import _bench, _cases, _want

from sondera.llm import decontaminate as dc


def test_rows_of_one_or_no_doc_id(spark):
    docs, items = _cases()
    r = random.Random(2)
    docs += [(4, sentence(r, 9) + " " + items[3][1]), (4, items[5][1] + " tail"), (None, sentence(r, 40)), (None, None), (None, items[5][1])]
    got = dc.decontaminate(documents(spark, docs), _bench(spark, items))
    assert sorted([(x["doc_id"], x["n_words"], x["n_hit"], list(x["items"]), x["contaminated"]) for x in got.collect()], key=repr) == _want(docs, items)

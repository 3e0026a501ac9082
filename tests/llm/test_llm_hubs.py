"""Pairs of a large group that is close to no hub are no rows; those in it that link are still found."""

from __future__ import annotations

import random
from functools import partial

import pytest
from llm_tools import documents, sentence
from pyspark.sql import functions as F
from test_llm_neardup import _edited, _want

from sondera.llm import neardup


def _group(r, size):
    """Documents that hold half of their shingles in common, every fourth with a near copy."""
    base = sentence(r, 120)
    rows = []
    for i in range(size):
        text = base + " " + sentence(r, 40, 10**9)
        rows.append((2 * i, text))
        if i % 4 == 0:
            rows.append((2 * i + 1, _edited(r, text, 2)))
    return rows


@pytest.mark.parametrize(("k", "percent", "bands"), [(5, 80, 32), (3, 85, 25)])
def test_a_member_is_compared_with_a_hub_a_band(spark, monkeypatch, k, percent, bands):
    rows = _group(random.Random(11), 160)
    most, compared = [], neardup.compared

    def counted(pairs, *rest):
        most.append(pairs.groupBy("b").count().agg(F.max("count")).first()[0])
        return compared(pairs, *rest)

    monkeypatch.setattr(neardup, "compared", counted)
    got = neardup.deduplicate(documents(spark, rows), k, percent).collect()
    assert sorted(map(tuple, got)) == sorted(_want(rows, k, percent))
    assert max(most) <= bands


@pytest.mark.parametrize("size", ["rows", "bytes"])
def test_all_members_meet_a_last_hub(spark, monkeypatch, size):
    """Without estimates before; in blocks that are full by rows, and by bytes."""
    rows = _group(random.Random(12), 24)
    monkeypatch.setattr(neardup, "links", partial(neardup.links, rounds=0))
    if size == "rows":
        monkeypatch.setattr(neardup, "through_hubs", partial(neardup.through_hubs, block=8))
    else:
        monkeypatch.setattr(neardup, "BLOCK_BYTES", 10_000)
    got = neardup.deduplicate(documents(spark, rows), 3, 85).collect()
    assert sorted(map(tuple, got)) == sorted(_want(rows, 3, 85))

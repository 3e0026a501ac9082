"""The queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from oracle import compare

from sondera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    assert compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf) > 0


def test_ten_operators_and_one_query_each():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11))

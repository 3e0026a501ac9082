"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest
from oracle import compare

from sondera.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"_key", "doc_count"} <= set(df.columns)
    assert df.count() > 0


def test_all_sql_belongs_to_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

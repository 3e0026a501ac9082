"""What has no upper limit, and what says so where it has one."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sondera import api
from sondera.errors import QueryError
from sondera.functions import scalars
from sondera.mapping import Field, Index, Mapping
from sondera.operators import aggs
from sondera.plans import compile, dsl, lang
from sondera.sources import readers


def _fits(tokens, terms, slop):
    places = [[p - i for p, t in enumerate(tokens) if t == x] for i, x in enumerate(terms)]
    return any(max(c) - min(c) <= slop for c in itertools.product(*places))


def test_phrases_of_many_terms_with_a_slop(spark):
    r = random.Random(1)
    texts = [[r.choice("abcdefgh") for _ in range(r.randint(0, 14))] for _ in range(120)]
    phrases = [("abcdefgh"[: r.randint(2, 8)], r.randint(1, 9)) for _ in range(12)] + [("abcdefgh", 6), ("ab" * 4, 3)]
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    cols = [compile.phrase(F.col("t"), list(p), slop).alias(f"p{i}") for i, (p, slop) in enumerate(phrases)]
    for t, row in zip(texts, df.select(*cols).collect(), strict=True):
        assert list(row) == [_fits(t, p, slop) for p, slop in phrases], t


def test_histogram_beyond_the_bucket_limit_is_an_error(spark):
    df = spark.createDataFrame([(0.0,), (100_000.0,)], "x double")
    ix = Index(df, Mapping((Field("x", "f64"),)))
    with pytest.raises(Exception, match="more than 65000 buckets"):
        aggs.buckets(ix, df, {"histogram": {"field": "x", "interval": 1}}).collect()
    got = aggs.buckets(ix, df, {"histogram": {"field": "x", "interval": 2}}).agg(F.count("*"), F.sum("doc_count")).first()
    assert tuple(got) == (50_001, 2)


def test_metrics_of_several_values(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, []), (3, None), (4, [5.0])], "id int, x array<double>")
    ix = Index(df, Mapping((Field("id", "i64"), Field("x", "f64", array=True))))
    got = aggs.run(ix, df, {"s": {"extended_stats": {"field": "x"}}, "m": {"avg": {"field": "x", "missing": 9.0}}, "n": {"value_count": {"field": "x"}}, "c": {"cardinality": {"field": "x"}}, "p": {"percentiles": {"field": "x", "percents": [50]}}})
    assert {k: round(v, 6) for k, v in got["s"].items()} == {"count": 3, "sum": 9.0, "min": 1.0, "max": 5.0, "avg": 3.0, "sum_of_squares": 35.0, "variance": round(8 / 3, 6), "std_deviation": round((8 / 3) ** 0.5, 6)}
    assert got["m"]["value"] == (1 + 3 + 9 + 9 + 5) / 5 and got["n"]["value"] == 3 and got["c"]["value"] == 3 and got["p"]["values"]["50.0"] == 3.0


def test_nanoseconds_to_microseconds(spark):
    n = [1704553130026000123, 1704553130026000999, -1, -1000, 0]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(scalars.floor_div(F.col("n"), 1000)).collect()
    assert [r[0] for r in got] == [x // 1000 for x in n]


@pytest.mark.parametrize(("body", "error"), [('{"update": {}}\n{}', "not supported"), ('{"index": {"_index": "a"}}', "no document"), ('{"index": {}}\n{"a": 1}', "names no index")])
def test_bulk_bodies_like_bulk(spark, body, error):
    good = '{"index": {"_index": "a"}}\n{"x": 1}\n\n{"create": {"_index": "b"}}\n{"x": 2}\n'
    df = spark.createDataFrame([(good,), ("",), ("\n",)], "body string")
    assert [tuple(r) for r in readers.bulk_bodies(df, "body").collect()] == readers.bulk(good)
    with pytest.raises(Exception, match=error):
        readers.bulk_bodies(spark.createDataFrame([(body,)], "body string"), "body").collect()


def test_escapes_in_wildcards(spark):
    df = spark.createDataFrame([("a*b",), ("axb",), ("a?",), ("a\\c",), ("b",)], "k string")
    ix = Index(df, Mapping((Field("k", "text", tokenizer="raw"),)))
    found = lambda v: sorted(r[0] for r in df.where(compile.Compiler(ix).predicate(dsl.parse({"wildcard": {"k": {"value": v}}}))).collect())
    assert found("a*") == ["a*b", "a?", "a\\c", "axb"]
    assert found("a\\**") == ["a*b"] and found("a\\?*") == ["a?"] and found("a\\\\*") == ["a\\c"] and found("*") == ["a*b", "a?", "a\\c", "axb", "b"]
    assert df.where(compile.Compiler(ix).predicate(lang.parse("k:a\\**"))).count() == 1
    for v in ("a*b*", "a", "a?*", "a\\*"):
        with pytest.raises(QueryError):
            found(v)


def test_total_that_is_not_asked_for(spark):
    df = spark.range(30).withColumnRenamed("id", "n")
    ix = Index(df, Mapping((Field("n", "i64"),), id_column="n"), "x")
    assert api.es_search(ix, {"size": 5})["hits"]["total"] == {"value": 30, "relation": "eq"}
    assert api.es_search(ix, {"size": 5, "track_total_hits": False})["hits"]["total"] == {"value": 5, "relation": "gte"}

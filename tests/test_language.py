"""Both query languages: what they read, and what they refuse."""

from __future__ import annotations

import pytest

from sondera.errors import MappingError, QueryError
from sondera.functions import analysis, literals
from sondera.functions.porter import stem
from sondera.mapping import Field, Mapping, parse_field
from sondera.plans import ast as A
from sondera.plans import dsl, lang

T = lambda f, v: A.FullText(f, v, "phrase_or_and")


@pytest.mark.parametrize(
    ("text", "node"),
    [
        ("a:b", T("a", "b")),
        ("a:b AND c:d", A.Bool(must=(T("a", "b"), T("c", "d")))),
        ("a:b OR c:d", A.Bool(should=(T("a", "b"), T("c", "d")))),
        ("a:b c:d", A.Bool(must=(T("a", "b"), T("c", "d")))),
        ("a:b AND c:d OR e:f", A.Bool(should=(A.Bool(must=(T("a", "b"), T("c", "d"))), T("e", "f")))),
        ("NOT a:b", A.Bool(must=(A.MatchAll(),), must_not=(T("a", "b"),))),
        ("-a:b c:d", A.Bool(must=(T("c", "d"),), must_not=(T("a", "b"),))),
        ("a:[1 TO 2}", A.Range("a", gte="1", lt="2")),
        ("a:{1 TO *]", A.Range("a", gt="1")),
        ("a:[* TO *]", A.Exists("a")),
        ("a:>=-5", A.Range("a", gte="-5")),
        ('a:"b c"~3', A.FullText("a", "b c", "phrase", slop=3)),
        ('a:"b c"*', A.PhrasePrefix("a", "b c")),
        ("a:b*", A.Wildcard("a", "b*")),
        ("a:*", A.Exists("a")),
        ("a: IN [b c]", A.TermSet({"a": ("b", "c")})),
        ("a:b^2.5", A.Boost(T("a", "b"), 2.5)),
        (r"a.b\.c:d", T(r"a.b\.c", "d")),
        ("a:(b OR c)", A.Bool(should=(T("a", "b"), T("a", "c")))),
        ("*", A.MatchAll()),
        ("", A.MatchAll()),
        ("a:2024-01-01T00:00:00Z", T("a", "2024-01-01T00:00:00Z")),
    ],
)
def test_parse(text, node):
    assert lang.parse(text) == node


@pytest.mark.parametrize("text", ["a:(b", "a:[1 TO 2", "a:b*c", "a:?b", "word", 'a:"b', "a:b)", "AND", "a: IN [b"])
def test_parse_errors(text):
    with pytest.raises(QueryError):
        lang.parse(text)


def test_default_fields_and_operator():
    assert lang.parse("x", ["a", "b"]) == A.Bool(should=(T("a", "x"), T("b", "x")))
    assert lang.parse("x y", ["a"], "or") == A.Bool(should=(T("a", "x"), T("a", "y")))
    assert lang.parse("+x y", ["a"], "or") == A.Bool(must=(T("a", "x"),), should=(T("a", "y"),))


@pytest.mark.parametrize(
    "query",
    [
        {"terms": {"a": [1]}, "term": {"a": 1}}, {"match": {"a": {"query": "x", "fuzziness": 1}}}, {"range": {"a": {"gt": 1, "gte": 1}}}, {"multi_match": {"query": "x", "fields": ["a^2"]}},
        {"multi_match": {"query": "x", "fields": ["a"], "type": "cross_fields"}}, {"query_string": {"query": "x", "fields": ["a"], "default_field": "b"}}, {"fuzzy": {"a": "x"}}, {"bool": {"musst": []}},
        {"match": {"a": {"query": "x", "operator": "xor"}}}, {},
    ],
)
def test_dsl_errors(query):
    with pytest.raises(QueryError):
        dsl.parse(query)


def test_simplify_and_pruning_hints():
    r = A.Range("ts", gte="2024-01-02T00:00:00Z")
    q = A.Bool(must=(A.Bool(must=(r,)), A.Range("ts", lt="2024-01-05T00:00:00Z"), A.Term("k", "a")), should=(A.Range("ts", gte="2024-01-04T00:00:00Z"),))
    assert A.time_bounds(q, "ts") == ("2024-01-02T00:00:00Z", "2024-01-05T00:00:00Z")
    assert A.required_terms(q, ("k",)) == {"k": {"a"}}
    either = A.Bool(should=(A.Term("k", "a"), A.TermSet({"k": ("b", "c")})))
    assert A.required_terms(either, ("k",)) == {"k": {"a", "b", "c"}}
    assert A.required_terms(A.Bool(must_not=(A.Term("k", "a"),)), ("k",)) == {}
    assert A.simplify(A.Bool(must=(A.MatchNone(), r))) == A.MatchNone()
    assert A.simplify(A.Boost(A.Boost(r, 2), 3)) == A.Boost(r, 6)


def test_literals():
    assert literals.coerce("7", "i64") == 7 and literals.coerce(7.0, "i64") == 7
    assert literals.coerce(str(2**64 - 1), "u64") == 2**64 - 1
    assert literals.coerce("true", "bool") is True
    assert literals.coerce("10.0.0.1", "ip") == "0" * 20 + "ffff0a000001"
    assert literals.coerce("!AQI", "bytes") == literals.coerce("0102", "bytes") == b"\x01\x02"
    for bad, kind in (("x", "i64"), (True, "i64"), (2**64, "u64"), ("nan", "f64"), ("yes", "bool"), ("10.0.0", "ip"), ("xyz", "bytes"), ("later", "datetime"), (1.5, "i64")):
        with pytest.raises(QueryError):
            literals.coerce(bad, kind)
    us = 1_684_993_002_000_000
    for text in ("2023-05-25T05:36:42Z", "2023-05-25T07:36:42+02:00", "Thu, 25 May 2023 05:36:42 +0000", "1684993002", 1684993002, 1684993002000, 1684993002.0, us, us * 1000):
        assert literals.parse_datetime(text) == us, text
    assert literals.parse_datetime("25.05.2023", ["%d.%m.%Y"]) == 1_684_972_800_000_000
    assert [literals.format_datetime(us + 5, f) for f in ("rfc3339", "unix_timestamp_secs", "unix_timestamp_millis", "unix_timestamp_micros", "unix_timestamp_nanos", "%Y")] == ["2023-05-25T05:36:42.000005Z", us // 10**6, us // 1000, us + 5, (us + 5) * 1000, "2023"]
    assert literals.fixed_interval_ms("-4d") == -345_600_000
    assert literals.human_duration_ms("1h 30min") == 5_400_000 and literals.human_duration_ms("90 days") == 90 * 86_400_000
    for bad in ("1M", "1 month", "d", ""):
        with pytest.raises(QueryError):
            literals.fixed_interval_ms(bad)


def test_mappings():
    f = parse_field({"name": "a", "type": "array<text>", "tokenizer": "raw", "fast": {"normalizer": "lowercase"}})
    assert f.array and f.fast and f.normalizer == "lowercase"
    for bad in ({"name": "a", "type": "facet"}, {"name": "$a", "type": "text"}, {"name": "_source", "type": "text"}, {"name": "a", "type": "array<object>"}, {"name": "a", "type": "text", "colour": 1}):
        with pytest.raises(MappingError):
            parse_field(bad)
    with pytest.raises(MappingError):
        Mapping((Field("ts", "text"),), timestamp="ts")
    with pytest.raises(MappingError):
        Mapping((Field("a", "text"),), tags=("a",))
    m = Mapping.parse({"doc_mapping": {"tokenizers": [{"name": "tri", "type": "ngram", "min_gram": 3, "max_gram": 3}], "field_mappings": [{"name": "a", "type": "text", "tokenizer": "tri"}]}, "search_settings": {"default_search_fields": ["a"]}})
    assert m.get("a").tokenizer["type"] == "ngram" and m.default_fields == ("a",)


@pytest.mark.parametrize(("word", "root"), [("running", "run"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("generalization", "general"), ("happily", "happili"), ("skis", "ski"), ("dying", "die"), ("by", "by"), ("agreed", "agre"), ("news", "news")])
def test_stemmer(word, root):
    assert stem(word) == root


def test_analysis(spark):
    text = "Hello, HTTPServer2 naïve Straße 東京は cafe_au"
    for config, want in (
        ("default", ["hello", "httpserver2", "naïve", "straße", "東京は", "cafe", "au"]),
        ("whitespace", ["Hello,", "HTTPServer2", "naïve", "Straße", "東京は", "cafe_au"]),
        ("chinese_compatible", ["hello", "httpserver2", "naïve", "straße", "東", "京", "は", "cafe", "au"]),
        ("lowercase", [text.lower()]),
        ({"type": "simple", "filters": ["lower_caser", "ascii_folding"]}, ["hello", "httpserver2", "naive", "strasse", "東京は", "cafe", "au"]),
        ({"type": "regex", "pattern": r"[A-Z]+"}, ["H", "HTTPS", "S"]),
    ):
        df = spark.createDataFrame([(text,)], "text string")
        got = [r["token"] for r in analysis.analyze(df, "text", config).orderBy("position").collect()]
        assert got == want, config
        if not isinstance(config, dict) or "ascii_folding" not in config.get("filters", []):
            assert analysis.query_tokens(text, config) == want
    code = spark.createDataFrame([("parseHTTPResponse v2_final",), (None,)], "text string")
    assert [r["token"] for r in analysis.analyze(code, "text", "source_code_default").orderBy("position").collect()] == ["parse", "http", "response", "v", "2", "final"]
    grams = analysis.analyze(spark.createDataFrame([("abcd",), ("a",), ("",)], "text string"), "text", {"type": "ngram", "min_gram": 2, "max_gram": 3})
    assert sorted(r["token"] for r in grams.collect()) == ["ab", "abc", "bc", "bcd", "cd"]
    long = spark.createDataFrame([("x" * 256,)], "text string")
    assert analysis.analyze(long, "text", "raw").count() == analysis.analyze(long, "text", "default").count() == 0
    with pytest.raises(MappingError):
        analysis.tokenizer("klingon")

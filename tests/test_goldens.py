"""Known results on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sondera import api
from sondera.errors import QueryError
from sondera.mapping import Field, Index, Mapping
from sondera.operators import aggs, meta, search, traces
from sondera.plans import ast as A
from sondera.plans import dsl, lang
from sondera.plans.compile import Compiler


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Fred", 100, 1, "2015-01-01T12:10:30Z", "192.168.0.1", ["nice"]), (2, "Manfred", 120, 13, "2015-01-11T12:10:30Z", "192.168.0.11", ["nice"]), (3, "Horst", None, 2, "2015-01-01T11:11:30Z", "192.168.0.10", ["nice", "cool"]),
        (4, "Fritz", 30, 5, None, "192.168.0.1", ["nice", "cool"]), (5, "Werner", 20, 0, "2015-01-02T00:00:00Z", "192.168.0.10", None), (6, "Holger", 30, 4, "2015-02-06T00:00:00Z", "192.168.0.10", None),
        (7, "Bernhard", 130, 14, "2015-02-16T00:00:00Z", "192.168.0.15", None), (8, "Fritz", 30, 5, None, None, None),
    ]
    df = spark.createDataFrame(rows, "_id long, name string, response long, id long, date string, host string, tags array<string>").withColumn("date", F.to_timestamp("date"))
    m = Mapping((Field("date", "datetime", precision="seconds"), Field("tags", "text", array=True, tokenizer="raw")), id_column="_id")
    return Index(df, m, "people")


def _run(ix, spec, query="*"):
    return aggs.run(ix, search.matching(ix, search.Request(query)), {"a": spec})["a"]


def test_date_histogram_with_stats(people):
    spec = {"date_histogram": {"field": "date", "fixed_interval": "30d", "offset": "-4d"}, "aggs": {"s": {"stats": {"field": "response"}}}}
    b = _run(people, spec)["buckets"]
    assert [(x["key"], x["doc_count"]) for x in b] == [(1420070400000, 4), (1422662400000, 2)]
    assert b[0]["s"] == {"avg": 80.0, "count": 3, "max": 120.0, "min": 20.0, "sum": 240.0}
    assert b[1]["s"] == {"avg": 80.0, "count": 2, "max": 130.0, "min": 30.0, "sum": 160.0}
    assert b[0]["key_as_string"] == "2015-01-01T00:00:00Z"
    assert [x["doc_count"] for x in _run(people, spec, "response:*")["buckets"]] == [3, 2]


def test_range_buckets(people):
    spec = {"range": {"field": "response", "ranges": [{"to": 50, "key": "fast"}, {"from": 50, "to": 80, "key": "medium"}, {"from": 80, "key": "slow"}]}}
    assert [(x["key"], x["doc_count"]) for x in _run(people, spec)["buckets"]] == [("fast", 4), ("medium", 0), ("slow", 3)]


def test_terms(people):
    hosts = {x["key"]: x["doc_count"] for x in _run(people, {"terms": {"field": "host"}})["buckets"]}
    assert hosts == {"192.168.0.10": 3, "192.168.0.1": 2, "192.168.0.15": 1, "192.168.0.11": 1}
    assert [(x["key"], x["doc_count"]) for x in _run(people, {"terms": {"field": "tags"}})["buckets"]] == [("nice", 4), ("cool", 2)]
    cut = _run(people, {"terms": {"field": "host", "size": 1}})
    assert cut["sum_other_doc_count"] == 4


def test_percentiles_by_lower_rank(people):
    spec = {"date_histogram": {"field": "date", "fixed_interval": "30d", "offset": "-4d"}, "aggs": {"p": {"percentiles": {"field": "response", "percents": [85]}}}}
    assert [x["p"]["values"]["85.0"] for x in _run(people, spec)["buckets"]] == [100.0, 30.0]


def test_histogram_keeps_empty_buckets(people):
    b = _run(people, {"histogram": {"field": "response", "interval": 50}})["buckets"]
    assert [(x["key"], x["doc_count"]) for x in b] == [(0.0, 4), (50.0, 0), (100.0, 3)]


def test_histogram_below_another_bucket_keeps_empty_buckets(people):
    spec = {"terms": {"field": "name", "size": 2, "order": {"_key": "asc"}}, "aggs": {"h": {"histogram": {"field": "id", "interval": 2, "extended_bounds": {"min": 0, "max": 5}}}}}
    b = _run(people, spec)["buckets"]
    assert b[0]["key"] == "Bernhard" and [(x["key"], x["doc_count"]) for x in b[0]["h"]["buckets"]][:3] == [(0.0, 0), (2.0, 0), (4.0, 0)]
    assert sum(x["doc_count"] for x in b[0]["h"]["buckets"]) == 1


def test_empty_result_has_empty_buckets(people):
    assert _run(people, {"terms": {"field": "host"}}, "name:Nobody")["buckets"] == []
    assert _run(people, {"histogram": {"field": "response", "interval": 50}}, "name:Nobody")["buckets"] == []


def test_sort_orders(spark):
    rows = [(0, 10.0, 1), (1, 10.0, 2), (2, 15.0, 2), (3, None, 3), (4, 10.0, 0), (5, -2.5, 4), (6, None, 5)]
    ix = Index(spark.createDataFrame(rows, "_id long, count double, id long"))
    top = lambda sort: [(r["count"], r["id"]) for r in search.top(ix, search.Request(sort=sort)).collect()]
    assert [c for c, _ in top([("count", True)])] == [15, 10, 10, 10, -2.5, None, None]
    assert [c for c, _ in top([("count", False)])] == [-2.5, 10, 10, 10, 15, None, None]
    assert top([("count", True), ("id", True)]) == [(15, 2), (10, 2), (10, 1), (10, 0), (-2.5, 4), (None, 5), (None, 3)]
    assert [i for _, i in top([("id", False), ("count", False)])] == [0, 1, 2, 2, 3, 4, 5]
    assert [r["_id"] for r in search.top(ix, search.Request()).collect()] == [6, 5, 4, 3, 2, 1, 0]
    # Keyset paging across the nulls.
    order = top([("count", True), ("id", True)])
    for k in range(len(order)):
        r = search.Request(sort=[("count", True), ("id", True)], search_after=list(order[k]))
        assert [(x["count"], x["id"]) for x in search.top(ix, r).collect()] == order[k + 1 :]


def test_two_key_sort(spark):
    big = 2**63
    rows = [(0, None, None), (1, None, big), (2, 2, 0), (3, 2, 100), (4, 5, 10)]
    ix = Index(spark.createDataFrame([(i, a, None if b is None else __import__("decimal").Decimal(b)) for i, a, b in rows], "_id long, a long, b decimal(20,0)"))
    got = [r["_id"] for r in search.top(ix, search.Request(sort=[("a", True), ("b", True)])).collect()]
    assert got == [4, 3, 2, 1, 0]


def test_time_range(spark):
    rows = [(i, dt.datetime.fromtimestamp(1684993000 + i, dt.UTC)) for i in range(1, 5)]
    ix = Index(spark.createDataFrame(rows, "_id long, ts timestamp"), Mapping((Field("ts", "datetime"),), timestamp="ts", id_column="_id"))
    n = lambda **k: search.count(ix, search.Request(**k)).first()["count"]
    assert n(start_timestamp=1684993001, end_timestamp=1684993002) == 1
    assert n(start_timestamp=1684993002, end_timestamp=1684993004) == 2
    assert n(query="ts:>=2023/05/25") == 4
    assert n(query="ts:>=1684993002 AND ts:<1684993004") == 2


@pytest.fixture(scope="module")
def bikes(spark):
    rows = [(1, "one", "a red bike"), (2, "two", "a small blue bike"), (3, "three", "a small, rusty, and yellow bike"), (4, "four", "fred's small bike"), (5, "five", "a tiny shelter")]
    m = Mapping((Field("title", "text", fast=False), Field("body", "text", record="position", fast=False)), default_fields=("title", "body"), id_column="_id")
    return Index(spark.createDataFrame(rows, "_id long, title string, body string"), m, "bikes")


@pytest.mark.parametrize(
    ("query", "hits"),
    [
        ('body:"small bird"~2', 0), ('body:"red bike"~2', 1), ('body:"small blue bike"~3', 1), ('body:"small bike"', 1), ('body:"small bike"~1', 2), ('body:"small bike"~2', 2), ('body:"small bike"~3', 3),
        ('body:"tiny shelter"~3', 1), ("body: IN [small tiny]", 4), ("NOT body:small", 2), ("body:small -body:blue", 2), ("body:sma*", 3), ("body:(red OR tiny)", 2), ("red bike", 1), ("two OR red", 2), ("*", 5),
        ('body:"a sm"*', 2), ("body:'bike small'", 3), ("body:bike^2", 4),
    ],
)
def test_text_queries(bikes, query, hits):
    assert search.count(bikes, search.Request(query)).first()["count"] == hits


def test_bm25(spark):
    rows = [(0, "one pad", "two pad"), (1, "one", "two"), (2, "one one", "two two")]
    m = Mapping((Field("title", "text", record="freq", fieldnorms=True, fast=False), Field("nofreq", "text", fieldnorms=True, fast=False)), default_fields=("title",), id_column="_id")
    ix = Index(spark.createDataFrame(rows, "_id long, title string, nofreq string"), m)

    def top(q):
        return [(r["_id"], r["_score"]) for r in search.top(ix, search.Request(q, sort=[("_score", True)])).collect()]

    for q, want in (
        ("title:one", [(2, 0.1738279), (1, 0.15965714), (0, 0.12343242)]),
        ("nofreq:two", [(1, 0.15965714), (2, 0.12343242), (0, 0.12343242)]),
        ("title:one nofreq:two", [(1, 0.31931427), (2, 0.2972603), (0, 0.24686484)]),
    ):
        got = top(q)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_ranges(spark):
    rows = [
        (1, dt.datetime(2023, 1, 10, 15, 13, 35, tzinfo=dt.UTC), 200, "10.10.12.123", 123.5, 1), (2, dt.datetime(2023, 1, 10, 15, 13, 36, tzinfo=dt.UTC), 400, "10.11.12.124", 231.4, -1),
        (3, dt.datetime(2023, 1, 10, 15, 13, 37, tzinfo=dt.UTC), 401, "192.168.0.1", 50.5, 5), (4, dt.datetime(2023, 1, 10, 15, 13, 38, tzinfo=dt.UTC), 404, "::ffff:10.0.0.7", 10.4, -5),
    ]
    from sondera.functions.scalars import ip_to_hex

    df = spark.createDataFrame(rows, "_id long, datetime timestamp, status long, host string, latency double, code long").withColumn("host", F.coalesce(ip_to_hex(F.col("host")), F.lit("0" * 20 + "ffff0a000007")))
    ix = Index(df, Mapping((Field("datetime", "datetime"), Field("host", "ip")), id_column="_id"))
    for q, want in (
        ("datetime:[2023-01-10T15:13:36Z TO 2023-01-10T15:13:38Z}", [2, 3]), ("status:[400 TO 401]", [2, 3]), ("host:[10.0.0.0 TO 10.255.255.255]", [1, 2, 4]), ("latency:[100 TO *]", [1, 2]), ("code:[-1 TO 1]", [1, 2]), ("status:>400.5", [3, 4]),
    ):
        assert sorted(r["_id"] for r in search.matching(ix, search.Request(q)).collect()) == want, q


def test_nested_terms_ordered_by_a_metric(spark):
    rows = [(1, "blue", 10.0), (2, "blue", 15.0), (3, "green", 10.0), (4, "white", 100.0), (5, "white", 1.0)]
    ix = Index(spark.createDataFrame(rows, "_id long, color string, price double"))
    spec = {"terms": {"field": "color", "order": {"price_stats.max": "desc"}}, "aggs": {"price_stats": {"stats": {"field": "price"}}}}
    assert [(b["key"], b["price_stats"]["max"]) for b in _run(ix, spec)["buckets"]] == [("white", 100.0), ("blue", 15.0), ("green", 10.0)]


def test_latest_traces(spark):
    at = lambda y, n: dt.datetime(y, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=n)
    rows = [("foo", at(2023, i)) for i in range(6)] + [("bar", at(2024, i)) for i in range(2)] + [("qux", at(2025, i)) for i in range(2)] + [("baz", at(2022, 0))]
    got = aggs.trace_ids(spark.createDataFrame(rows, "trace_id string, span_timestamp timestamp"), "trace_id", "span_timestamp", 3).collect()
    assert [r["trace_id"] for r in got] == ["qux", "bar", "foo"]


def test_list_terms(spark):
    ix = Index(spark.createDataFrame([(1, "snoopy"), (2, "beagle"), (3, "snoopy"), (4, None)], "_id long, title string"), Mapping((Field("title", "text"),)))
    terms = lambda **k: [r["term"] for r in meta.list_terms(ix, "title", **k).collect()]
    assert terms() == ["beagle", "snoopy"]
    assert terms(limit=1) == ["beagle"]
    assert terms(start="casper") == ["snoopy"]
    assert terms(end="casper") == ["beagle"]


def test_snippets(spark):
    rows = [(1, "snoopy", "Snoopy is an anthropomorphic beagle[5] in the comic strip"), (2, "beagle", "The beagle is a breed of small scent hound")]
    m = Mapping((Field("title", "text", fast=False), Field("body", "text", fast=False)), default_fields=("title", "body"), id_column="_id")
    ix = Index(spark.createDataFrame(rows, "_id long, title string, body string"), m)
    got = {r["_id"]: r for r in search.snippets(ix, search.Request("beagle", snippet_fields=["title", "body"])).collect()}
    assert got[2]["title"] == ["<b>beagle</b>"] and got[1]["title"] == []
    assert "<b>beagle</b>[5]" in got[1]["body"][0]


def test_bool_semantics(spark):
    ix = Index(spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 7)], "_id long, k string, n long"))
    ids = lambda q: sorted(r["_id"] for r in ix.df.where(Compiler(ix).predicate(dsl.parse(q))).collect())
    none, every = {"match_none": {}}, {"match_all": {}}
    assert ids({"bool": {}}) == [1, 2, 3]
    assert ids({"bool": {"should": [none], "must_not": [none]}}) == []
    assert ids({"bool": {"must_not": [none]}}) == [1, 2, 3]
    assert ids({"bool": {"must_not": [{"term": {"k": "a"}}]}}) == [2, 3]
    assert ids({"bool": {"must_not": [{"range": {"n": {"gte": 6}}}]}}) == [1, 2]
    assert ids({"bool": {"must": [every], "should": [{"term": {"k": "a"}}]}}) == [1, 2, 3]
    assert ids({"bool": {"must_not": [{"bool": {"must_not": [{"term": {"k": "a"}}]}}]}}) == [1]
    assert ids({"bool": {"filter": None, "must": {"exists": {"field": "n"}}}}) == [2, 3]


def test_fields_and_dynamic_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "x y"}, "c.d": 3, "e": [1, 2]}'), (2, '{"a": {"b": 7}}'), (3, None)], "_id long, _dynamic string")
    ix = Index(df, Mapping((), id_column="_id"))
    ids = lambda q: sorted(r["_id"] for r in search.matching(ix, search.Request(q)).collect())
    assert ids("a.b:*") == [1, 2]
    assert ids("a.b:7") == [2]
    assert ids(r"c\.d:3") == [1]
    assert ids("a.b:>=5") == [2]
    assert ids("NOT a.b:7") == [1, 3]
    strict = Index(df.select("_id"), Mapping((Field("_id2", "i64"),), mode="strict"))
    with pytest.raises(QueryError):
        Compiler(strict).predicate(lang.parse("nowhere:1"))


def test_field_caps_and_multi_index(spark):
    one = Index(spark.createDataFrame([(1, "x")], "id long, name string"), Mapping((Field("id", "i64"),), id_column="id"), "one")
    two = Index(spark.createDataFrame([(2, 0.5)], "id long, size double"), Mapping((Field("id", "i64"),), id_column="id"), "two")
    caps = meta.field_caps([one, two])
    assert set(caps["fields"]) == {"id", "name", "size"}
    assert caps["fields"]["name"]["keyword"]["indices"] == ["one"] and "indices" not in caps["fields"]["id"]["long"]
    both = meta.multi_index({"one": one, "two": two}, "o*,two")
    assert sorted(r["id"] for r in both.df.collect()) == [1, 2]
    assert meta.multi_index({"one": one, "two": two}, "*,-two").df.count() == 1
    with pytest.raises(QueryError):
        meta.multi_index({"one": one}, "three")


def test_native_and_json_interfaces(people):
    got = api.native(people, {"query": "tags:nice", "max_hits": 2, "sort_by": "-id", "aggs": {"n": {"value_count": {"field": "response"}}}})
    assert got["num_hits"] == 4 and len(got["hits"]) == 2 and got["aggregations"]["n"]["value"] == 3
    with pytest.raises(QueryError):
        api.native(people, {"quary": "x"})
    got = api.es_search(people, {"query": {"term": {"name": "Fritz"}}, "sort": [{"id": "desc"}], "size": 1})
    assert got["hits"]["total"]["value"] == 2 and got["hits"]["hits"][0]["sort"] == [5, 8]
    assert api.es_count(people, {"query": {"match_all": {}}}) == 8
    assert search.Request().max_hits == 20
    with pytest.raises(QueryError):
        search.top(people, search.Request(max_hits=10_001))


def test_sorting_by_text_is_an_error(people):
    with pytest.raises(QueryError):
        search.top(people, search.Request(sort=[("name", True)]))
    with pytest.raises(QueryError):
        Compiler(people).predicate(A.Range("name", gte="a"))


def test_trace_predicate_needs_no_null(spark, sf):
    from sondera.queries.base import spans

    s = spans(spark, sf)
    n = s.count()
    assert s.where(traces.predicate(tags={"error": "true"})).count() + s.where(traces.predicate(tags={"error": "false"})).count() == n

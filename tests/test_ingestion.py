"""Documents against mappings, routing, splits, merges, retention, and the catalog."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sondera.catalog import Catalog, analyze
from sondera.errors import MappingError, QueryError
from sondera.functions import scalars
from sondera.mapping import Index, Mapping
from sondera.operators import export, maintain, meta, search
from sondera.operators.maintain import LimitMerge, Split, StableLog
from sondera.plans import ast as A
from sondera.plans import lang
from sondera.sources import otlp, readers
from sondera.streaming import ingest

CONFIG = {
    "index_id": "logs", "retention": {"period": "1 day"}, "indexing_settings": {"merge_policy": {"type": "limit_merge", "merge_factor": 2, "max_merge_factor": 3}},
    "doc_mapping": {
        "timestamp_field": "ts", "tag_fields": ["app"], "partition_key": "app", "max_num_partitions": 4,
        "field_mappings": [
            {"name": "ts", "type": "datetime", "input_formats": ["rfc3339", "unix_timestamp"], "fast_precision": "seconds"}, {"name": "app", "type": "text", "tokenizer": "raw"}, {"name": "n", "type": "i64"}, {"name": "ip", "type": "ip"}, {"name": "raw", "type": "bytes"},
            {"name": "tags", "type": "array<text>", "tokenizer": "raw"}, {"name": "who", "type": "object", "field_mappings": [{"name": "id", "type": "u64"}]}, {"name": "strict_n", "type": "f64", "coerce": False},
        ],
    },
}


def _parse(spark, docs, **doc_mapping):
    m = Mapping.parse({"doc_mapping": CONFIG["doc_mapping"] | doc_mapping})
    return readers.parse(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "doc string"), m)


def test_documents_are_typed_and_checked(spark):
    ok = {"ts": 1700000000, "app": "web", "n": "12", "ip": "10.0.0.1", "raw": "AQI=", "tags": ["a", "b"], "who": {"id": 18446744073709551615}, "more": {"x": [1]}, "word": "w"}
    r = _parse(spark, [ok]).first()
    assert r["_error"] is None and r["n"] == 12 and r["ip"] == "0" * 20 + "ffff0a000001" and bytes(r["raw"]) == b"\x01\x02" and r["tags"] == ["a", "b"] and r["who"]["id"] == 2**64 - 1
    assert json.loads(r["_dynamic"]) == {"more": {"x": [1]}, "word": "w"}
    bad = [{"app": "web"}, "[1]", "{", {"ts": 1700000000, "n": "many"}, {"ts": 1700000000, "n": [1]}, {"ts": "soon"}, {"ts": 1700000000, "strict_n": "1.5"}, {"ts": 1700000000, "app": 5}]
    assert all(x["_error"] for x in _parse(spark, bad).collect())
    fine = [{"ts": 1700000000, "n": None}, {"ts": "2023-11-14T22:13:20Z", "tags": "one"}, {"ts": 1700000000.5}]
    assert not any(x["_error"] for x in _parse(spark, fine).collect())
    strict = _parse(spark, [ok, {"ts": 1700000000}], mode="strict").collect()
    assert strict[0]["_error"] == "unknown fields: more,word" and strict[1]["_error"] is None
    lenient = _parse(spark, [ok], mode="lenient", store_source=True)
    assert "_dynamic" not in lenient.columns and json.loads(lenient.first()["_source"]) == ok


def test_formats_and_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    raw = readers.read_source(spark, {"source_type": "file", "params": {"filepath": str(tmp_path)}})
    assert sorted(json.loads(r["doc"])["plain_text"] for r in readers.decode(raw, "plain_text").collect()) == ["one", "two"]
    assert readers.read_source(spark, {"source_type": "vec", "params": {"docs": [{"a": 1}]}}).count() == 1
    assert readers.read_source(spark, {"source_type": "void"}).count() == 0
    with pytest.raises(MappingError):
        readers.read_source(spark, {"source_type": "carrier pigeon"})
    assert readers.bulk('{"index": {"_index": "x"}}\n{"a": 1}\n\n{"create": {}}\n{"a": 2}', "y") == [("x", '{"a": 1}'), ("y", '{"a": 2}')]
    for bad in ('{"delete": {}}\n{}', '{"index": {}}\n{}', '{"index": {"_index": "x"}}'):
        with pytest.raises(QueryError):
            readers.bulk(bad)


def test_routing(spark):
    df = spark.createDataFrame([(i % 5, i % 3, i) for i in range(60)], "a long, b long, n long")
    p = df.select("a", "b", ingest.routing("hash_mod((a,b), 4)").alias("p"))
    assert p.select("p").distinct().count() <= 4 and p.groupBy("a", "b").agg(F.count_distinct("p").alias("c")).where("c > 1").count() == 0
    assert df.select(ingest.routing("a,hash_mod(b, 2)", 7).alias("p")).where("p < 0 or p >= 7").count() == 0
    assert df.select(ingest.routing(None).alias("p")).distinct().count() == 1
    for bad in ("a,", "hash_mod(a", "a b"):
        with pytest.raises(MappingError):
            ingest.routing(bad)


def test_merge_policies():
    small = [Split(f"s{i:02d}", 1000, create_time=i) for i in range(25)]
    plans = StableLog().plan(small)
    assert [len(p) for p in plans] == [12, 12] and len({s.split_id for p in plans for s in p}) == 24
    assert StableLog().plan(small[:9]) == []
    assert StableLog().plan([Split("big", 10_000_000)] * 12) == []
    levels = [Split(f"a{i}", 1000) for i in range(5)] + [Split(f"b{i}", 2_000_000) for i in range(5)]
    assert StableLog().plan(levels) == []
    two = [Split(f"p{i}", 1000, partition_id=i % 2) for i in range(20)]
    assert all(len({s.partition_id for s in p}) == 1 for p in StableLog().plan(two))
    ops = [Split(f"o{i}", 10, merge_ops=4) for i in range(20)]
    assert LimitMerge().plan(ops) == []
    assert [len(p) for p in LimitMerge().plan([Split(f"x{i:02d}", 10, merge_ops=i % 2, create_time=i) for i in range(20)])] == [10, 10]
    assert maintain.policy({"type": "no_merge"}).plan(small) == []
    with pytest.raises(MappingError):
        maintain.policy({"type": "all_at_once"})


def test_catalog_life_cycle(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/root")
    assert cat.names() == []
    mapping = cat.create(CONFIG)
    with pytest.raises(MappingError):
        cat.create(CONFIG)
    with pytest.raises(MappingError):
        cat.create({"index_id": "1"})
    with pytest.raises(MappingError):
        cat.update(CONFIG | {"doc_mapping": {"field_mappings": []}})
    cat.update(CONFIG | {"retention": {"period": "2 days"}})
    assert cat.names("lo*") == ["logs"] and cat.open("logs").df.count() == 0
    folder = f"file://{tmp_path}/root/logs"
    day = 1_700_006_400  # a midnight
    for k in range(3):
        docs = [{"ts": day + k * 86400 + i, "app": "web" if i % 2 else "db", "n": i} for i in range(10)]
        ingest.append(spark, folder, [json.dumps(d) for d in docs] + ["{broken"])
    source = {"source_type": "ingest_api", "params": {"landing": f"{folder}/landing/*"}}
    for _ in range(2):  # the second run has nothing new
        ingest.ingest(spark, source, mapping, folder).awaitTermination()
    assert cat.open("logs").df.count() == 30
    m = cat.manifest("logs")
    assert m.agg(F.sum("num_docs")).first()[0] == 30 and cat.describe("logs").first()["num_published_docs"] == 30
    assert meta.prune(m, cat.open("logs"), A.Term("app", "web")).agg(F.sum("num_docs")).first()[0] == 15
    assert cat.open("logs", A.Term("app", "db"), day + 86400, day + 2 * 86400).df.count() <= 15
    newest = cat.newest("logs", search.Request("app:web", max_hits=7, sort=[("ts", True)]), at_once=1)
    want = cat.open("logs").df.where("app = 'web'").orderBy(F.desc("ts")).limit(7).collect()
    assert [r["n"] for r in newest] == [r["n"] for r in want] and len(cat.newest("logs", search.Request(max_hits=99, sort=[("ts", True)]))) == 30
    with pytest.raises(QueryError):
        cat.newest("logs", search.Request(sort=[("n", True)]))
    n_splits = m.count()
    merged = cat.merge("logs")
    assert cat.open("logs").df.count() == 30
    assert merged == 0 or cat.manifest("logs").where("state = 'published'").count() < n_splits
    assert cat.delete_where("logs", lang.parse("app:web AND n:>=5")) == 9
    assert cat.delete_where("logs", lang.parse("app:nothing")) == 0
    assert cat.open("logs").df.count() == 21
    assert cat.open("logs").df.where("app = 'web' and n >= 5").count() == 0
    assert cat.collect_garbage("logs", now=2**33) > 0 and cat.open("logs").df.count() == 21
    cat.add_source("logs", {"source_id": "f", "source_type": "file"})
    cat.toggle_source("logs", "f", False)
    assert cat.config("logs")["sources"]["f"]["enabled"] is False
    cat.delete_source("logs", "f")
    with pytest.raises(QueryError):
        cat.delete_source("logs", "f")
    cat.retain("logs", now=day + 10 * 86400)
    assert cat.open("logs").df.count() == 0
    cat.clear("logs")
    cat.delete("logs")
    with pytest.raises(QueryError):
        cat.config("logs")


def test_retention_keeps_splits_without_times(spark):
    row = lambda i, end: (f"s{i}", "p", "published", 1, 1, None, end, [], 0, 0, 0, 0, 0)
    m = spark.createDataFrame([row(1, None), row(2, 100), row(3, 10**6)], meta.SPLIT)
    got = {r["split_id"]: r["state"] for r in maintain.retention(m, "1 hour", 4000).collect()}
    assert got == {"s1": "published", "s2": "marked", "s3": "published"}


def test_otlp_logs(spark):
    message = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}, {"key": "k", "value": {"intValue": "5"}}]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "0", "observedTimeUnixNano": "1700000000000000000", "severityText": "WARN", "body": {"stringValue": "hello"}}, {"timeUnixNano": "1700000001000000000", "body": {"boolValue": True}}]}]}]}
    rows = otlp.logs(spark.createDataFrame([(json.dumps(message),)], "value string")).orderBy("timestamp_nanos").collect()
    assert [(r["service_name"], r["body"]) for r in rows] == [("shop", "hello"), ("shop", "true")]
    assert rows[0]["resource_attributes"] == {"k": "5"} and rows[0]["timestamp_nanos"] == 1700000000000000000
    docs = readers.decode(spark.createDataFrame([(json.dumps(message),)], "value string"), "otlp_logs_json")
    assert docs.count() == 2


def _field(number: int, value) -> bytes:
    if isinstance(value, int):
        return bytes([number << 3 | 1]) + value.to_bytes(8, "little")
    size, n = b"", len(value)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + value


def test_otlp_protobuf(spark):
    attr = lambda k, v: _field(1, k) + _field(2, v)
    span = _field(1, bytes(range(16))) + _field(2, b"12345678") + _field(5, b"op") + bytes([6 << 3, 2]) + _field(7, 1_700_000_000_000_000_000) + _field(8, 1_700_000_000_250_000_000) + _field(9, attr(b"k", bytes([3 << 3, 5]))) + bytes([15 << 3 | 2, 2, 3 << 3, 2])
    message = _field(1, _field(1, _field(1, attr(b"service.name", _field(1, b"shop")))) + _field(2, _field(1, _field(1, b"lib")) + _field(2, span) + _field(2, span)))
    raw = spark.createDataFrame([(message,), (b"\xff\xff",), (None,)], "value binary")
    rows = [json.loads(r["doc"]) for r in readers.decode(raw, "otlp_traces_proto").collect()]
    assert len(rows) == 2 and rows[0]["service_name"] == "shop" and rows[0]["span_attributes"] == {"k": "5"} and rows[0]["span_duration_millis"] == 250
    assert rows[0]["span_status"]["code"] == "error" and rows[0]["trace_id"] == bytes(range(16)).hex() and rows[0]["scope_name"] == "lib"
    log = _field(1, 1_700_000_000_000_000_000) + _field(3, b"WARN") + _field(5, _field(1, b"hello"))
    logs = spark.createDataFrame([(_field(1, _field(2, _field(2, log))),)], "value binary")
    (one,) = [json.loads(r["doc"]) for r in readers.decode(logs, "otlp_logs_proto").collect()]
    assert one["body"] == "hello" and one["severity_text"] == "WARN" and one["service_name"] == "unknown_service"


def test_ready_made_tokens(spark):
    m = Mapping.parse({"doc_mapping": {"field_mappings": [{"name": "body", "type": "text", "tokens": "body_tokens", "record": "position"}]}, "search_settings": {"default_search_fields": ["body"]}})
    docs = spark.createDataFrame([('{"body": "A small bike"}',), ('{"body": "Bike, small"}',), ("{}",)], "doc string")
    ix = Index(ingest.valid(readers.parse(docs, m)), m)
    assert ix.df.columns[:2] == ["body", "body_tokens"]
    assert search.count(ix, search.Request('"small bike"')).first()["count"] == 1 and search.count(ix, search.Request("bike")).first()["count"] == 2
    assert "body_tokens" not in json.loads(export.hits_json(ix, search.matching(ix, search.Request("bike"))).first()["json"])


def test_scalars(spark):
    df = spark.createDataFrame([("2023-05-25T05:36:42.5Z",), ("Thu, 25 May 2023 05:36:42 +0000",), ("1684993002",), ("1684993002.25",), ("25.05.2023",), ("never",), (None,)], "c string")
    got = [r[0] for r in df.select(F.unix_micros(scalars.parse_datetime(F.col("c"), ["rfc3339", "rfc2822", "unix_timestamp", "%d.%m.%Y"]))).collect()]
    assert got == [1684993002500000, 1684993002000000, 1684993002000000, 1684993002250000, 1684972800000000, None, None]
    ips = spark.createDataFrame([("1.2.3.4",), ("::1",), ("2001:db8::ff00:42:8329",), ("300.1.1.1",), ("x",), (None,)], "c string")
    assert [r[0] for r in ips.select(scalars.ip_to_hex(F.col("c"))).collect()] == ["0" * 20 + "ffff01020304", "0" * 31 + "1", "20010db8000000000000ff0000428329", None, None, None]
    nums = spark.createDataFrame([("12",), ("-3",), ("1e3",), ("x",), ("18446744073709551615",)], "c string")
    assert [r[0] for r in nums.select(scalars.coerce_number(F.col("c"), "i64")).collect()] == [12, -3, None, None, None]
    assert [None if r[0] is None else int(r[0]) for r in nums.select(scalars.coerce_number(F.col("c"), "u64")).collect()] == [12, None, None, None, 2**64 - 1]
    assert [r[0] for r in nums.select(scalars.coerce_number(F.col("c"), "f64")).collect()][:4] == [12.0, -3.0, 1000.0, None]
    assert scalars.glob_match("a*c", "abc") and not scalars.glob_match("a*c", "abd") and scalars.glob_match("a[1]*", "a[1]x")
    with pytest.raises(QueryError):
        scalars.glob_match("a**", "a", 1)
    assert export.frame({2: [5], 1: [3, 4]}) == b"".join(int(x).to_bytes(8, "little") for x in (1, 2, 3, 4, 2, 1, 5))


def test_analyze(spark):
    assert [r["token"] for r in analyze(spark, "Running dogs", "en_stem").collect()] == ["run", "dog"]

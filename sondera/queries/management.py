"""Queries of listings, several indexes, traces, ingestion and maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api, scratch
from ..catalog import Catalog
from ..mapping import Field, Index, Mapping
from ..operators import aggs, maintain, meta, search, traces
from ..plans import ast as A
from ..plans import lang
from ..sources import otlp, readers
from ..streaming import ingest
from .base import TOKENS, index, query, spans, table


@query(f"SELECT DISTINCT term FROM (SELECT unnest({TOKENS}) AS term FROM documents) ORDER BY term LIMIT 100")
def list_terms(spark, sf_dir):
    return meta.list_terms(index(spark, sf_dir, "documents"), "text", limit=100)


@query(f"SELECT DISTINCT term FROM (SELECT unnest({TOKENS}) AS term FROM documents) WHERE term >= 'li' AND term < 'lj'")
def list_terms_range(spark, sf_dir):
    return meta.list_terms(index(spark, sf_dir, "documents"), "text", "li", "lj")


@query()
def list_fields(spark, sf_dir):
    return meta.list_fields([index(spark, sf_dir, n) for n in ("events", "documents", "orders")], ["*"], json_fields=True)


@query("SELECT 'k' AS path, 'bigint' AS kind, CAST(count(*) AS BIGINT) AS docs FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def list_json_paths(spark, sf_dir):
    return meta.json_paths(index(spark, sf_dir, "events"), "props")


_BOTH = "SELECT o_orderkey AS id, o_totalprice AS price, 'orders' AS kind FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, 'lines' FROM lineitem"


def _both(spark, sf_dir) -> dict[str, Index]:
    m = Mapping((Field("id", "i64"), Field("price", "f64"), Field("kind", "text", tokenizer="raw")), id_column="id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit("orders").alias("kind"))
    ln = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.lit("lines").alias("kind"))
    return {"sales-orders": Index(o, m, "sales-orders"), "sales-lines": Index(ln, m, "sales-lines")}


@query(f"SELECT id, price, kind FROM ({_BOTH}) WHERE price > 40000")
def multi_index_union(spark, sf_dir):
    ix = meta.multi_index(_both(spark, sf_dir), "sales-*,none*")
    return search.matching(ix, search.Request("price:>40000")).select("id", "price", "kind")


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS doc_count, round(avg(price), 4) AS mean FROM ({_BOTH}) GROUP BY kind")
def multi_index_agg(spark, sf_dir):
    ix = meta.multi_index(_both(spark, sf_dir), ["sales-orders", "sales-lines"])
    got = aggs.buckets(ix, ix.df, {"terms": {"field": "kind"}, "aggs": {"mean": {"avg": {"field": "price"}}}})
    return got.select(F.col("_key").alias("kind"), "doc_count", F.round("mean", 4).alias("mean"))


@query(
    "WITH e AS (SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error'), c AS (SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click') "
    "SELECT 200 AS status, n AS total FROM e UNION ALL SELECT 200, n FROM c UNION ALL SELECT 400, NULL"
)
def msearch(spark, sf_dir):
    """Three searches at once, of which the last names no index."""
    ix = {"events": index(spark, sf_dir, "events")}
    body = lambda t: {"query": {"term": {"event_type": t}}, "size": 0}
    got = api.msearch(ix, [({"index": "events"}, body("error")), ({"index": "events"}, body("click")), ({}, body("view"))])
    rows = [(r["status"], r["hits"]["total"]["value"] if r["status"] == 200 else None) for r in got]
    return spark.createDataFrame(rows, "status int, total long")


@query("SELECT CAST(event_id AS BIGINT) AS event_id FROM events WHERE event_type = 'error' ORDER BY value ASC, event_id ASC LIMIT 10")
def es_search_hits(spark, sf_dir):
    """A JSON search with its hits, sort values and total."""
    got = api.es_search(index(spark, sf_dir, "events"), {"query": {"term": {"event_type": "error"}}, "sort": [{"value": "asc"}], "size": 10})
    return spark.createDataFrame([(int(h["_id"]),) for h in got["hits"]["hits"]], "event_id long")


# Traces: an event is a span, its user the trace, its type the service.


@query("SELECT DISTINCT event_type AS service_name FROM events")
def trace_services(spark, sf_dir):
    return traces.services(spans(spark, sf_dir))


@query("SELECT DISTINCT 'op' || (event_id % 4)::VARCHAR AS span_name, 2 AS span_kind FROM events WHERE event_type = 'click'")
def trace_operations(spark, sf_dir):
    return traces.operations(spans(spark, sf_dir), "click", 2)


_IDS = "SELECT CAST(user_id AS VARCHAR) AS trace_id, max(ts) AS t FROM events WHERE event_type = 'error' AND value >= 50 GROUP BY user_id ORDER BY t DESC, trace_id LIMIT 5"


@query(f"SELECT trace_id, CAST(epoch_us(t) // 1000 AS BIGINT) AS latest_ms FROM ({_IDS})")
def trace_ids(spark, sf_dir):
    got = traces.find_trace_ids(spans(spark, sf_dir), traces.predicate("error", duration_min_ms=50), 5)
    return got.select("trace_id", F.unix_millis("span_timestamp").alias("latest_ms"))


@query(f"SELECT e.event_id::VARCHAR AS span_id, i.trace_id FROM ({_IDS}) i JOIN events e ON CAST(e.user_id AS VARCHAR) = i.trace_id AND e.ts BETWEEN i.t - INTERVAL 1 DAY AND i.t + INTERVAL 1 DAY")
def two_phase_traces(spark, sf_dir):
    got = traces.find_traces(spans(spark, sf_dir), traces.predicate("error", duration_min_ms=50), 5, "1 day")
    return got.select("span_id", "trace_id")


@query("SELECT event_id::VARCHAR AS span_id FROM events WHERE user_id = 3 AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 OR (user_id = 3 AND event_type = 'error')")
def trace_spans_by_tag(spark, sf_dir):
    s = traces.get_trace(spans(spark, sf_dir), "3")
    return s.where(traces.predicate(tags={"k": "7"}) | traces.predicate(tags={"error": "true"})).select("span_id")


@query("SELECT CAST(user_id AS VARCHAR) AS \"traceID\", 'op' || (event_id % 4)::VARCHAR AS \"operationName\", CAST(count(*) AS BIGINT) AS n, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us FROM events GROUP BY ALL")
def trace_view(spark, sf_dir):
    view = traces.jaeger_span(spans(spark, sf_dir))
    return view.groupBy("traceID", "operationName").agg(F.count("*").alias("n"), F.min("startTime").alias("first_us"))


# Ingestion and maintenance, on indexes that the query itself fills from ``events``.


def _day(c: str = "ts"):
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd")


def _splits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The events as if each day and type were a split, and the manifest of those splits."""
    e = table(spark, sf_dir, "events").withColumn("split_id", F.concat(_day(), F.lit("-"), F.col("event_type")))
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    tag = F.concat(F.lit("event_type:"), F.col("event_type"))
    m = e.groupBy("split_id").agg(
        F.col("split_id").alias("path"), F.lit("published").alias("state"), F.count("*").alias("num_docs"), F.lit(0).cast("long").alias("bytes"), F.min(s).alias("time_start"), F.max(s).alias("time_end"),
        F.concat(F.array(F.lit("event_type!")), F.array_sort(F.collect_set(tag))).alias("tags"), F.lit(0).cast("long").alias("partition_id"), F.lit(0).cast("long").alias("create_time"), F.lit(0).cast("long").alias("maturity"),
        F.lit(0).cast("long").alias("delete_opstamp"), F.lit(0).alias("merge_ops"),
    )
    return e, m


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '-error' AS split_id FROM events WHERE event_type = 'error'")
def split_prune_tags(spark, sf_dir):
    _, m = _splits(spark, sf_dir)
    return meta.prune(m, index(spark, sf_dir, "events"), A.Term("event_type", "error")).select("split_id")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '-' || event_type AS split_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-14'")
def split_prune_time(spark, sf_dir):
    _, m = _splits(spark, sf_dir)
    q = A.Bool(filter=(A.Range("ts", gte="2024-01-10T00:00:00Z"),))
    return meta.prune(m, index(spark, sf_dir, "events"), q, None, 1705190400).select("split_id")


@query("SELECT CAST(count(*) AS BIGINT) AS num_published_splits, CAST(sum(n) AS BIGINT) AS num_published_docs FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type)")
def describe_index(spark, sf_dir):
    return meta.describe(_splits(spark, sf_dir)[1]).select("num_published_splits", "num_published_docs")


@query("SELECT split_id, num_docs FROM (SELECT strftime(ts, '%Y-%m-%d') || '-' || event_type AS split_id, CAST(count(*) AS BIGINT) AS num_docs FROM events GROUP BY 1) ORDER BY split_id LIMIT 5 OFFSET 3")
def list_splits(spark, sf_dir):
    return meta.list_splits(_splits(spark, sf_dir)[1], offset=3, limit=5).select("split_id", "num_docs")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value > 100) OR ts >= TIMESTAMP '2024-01-20'")
def delete_by_query(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    return maintain.delete_where(ix, lang.parse("event_type:error AND value:>100"), None, 1705708800).select("event_id")


@query("SELECT event_id FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-20'")
def retention_drop(spark, sf_dir):
    now = int(dt.datetime(2024, 1, 30, tzinfo=dt.UTC).timestamp())
    return maintain.retained(table(spark, sf_dir, "events"), "ts", "10 days", now).select("event_id")


@query("SELECT CAST(count(*) AS BIGINT) AS orders, CAST(count(*) AS BIGINT) AS together FROM orders")
def routing_hash_mod(spark, sf_dir):
    """Orders of a customer share a partition, and there are at most eight."""
    o = table(spark, sf_dir, "orders").withColumn("p", ingest.routing("hash_mod(o_custkey, 8)"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("p").alias("parts"), F.max("p").alias("p"))
    return per.agg(F.sum("n").alias("orders"), F.sum(F.when((F.col("parts") == 1) & (F.col("p") < 8), F.col("n"))).alias("together"))


_INGEST = {
    "index_id": "event-log",
    "doc_mapping": {
        "mode": "dynamic", "timestamp_field": "ts", "tag_fields": ["event_type"], "partition_key": "hash_mod(user_id, 4)",
        "field_mappings": [
            {"name": "event_id", "type": "i64"}, {"name": "ts", "type": "datetime", "input_formats": ["rfc3339", "unix_timestamp"]}, {"name": "user_id", "type": "i64"},
            {"name": "event_type", "type": "text", "tokenizer": "raw", "fast": True}, {"name": "value", "type": "f64"},
        ],
    },
    "retention": {"period": "10 days"},
}


def _landed(spark, sf_dir) -> tuple[Catalog, str]:
    """The events as lines of JSON, every hundredth without its timestamp, ingested by a stream."""
    root = scratch.folder(spark, "catalog")
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 100 != 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    e.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}-landing")
    cat = Catalog(spark, root)
    mapping = cat.create(_INGEST)
    ingest.ingest(spark, {"source_type": "file", "params": {"path": f"{root}-landing"}}, mapping, f"{root}/event-log").awaitTermination()
    return cat, "event-log"


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, CAST(max(epoch_us(ts)) AS BIGINT) AS latest_us, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE event_id % 100 <> 0 GROUP BY event_type")
def stream_ingest_counts(spark, sf_dir):
    """Rows without a timestamp are rejected, unmapped fields stay in the dynamic remainder."""
    cat, name = _landed(spark, sf_dir)
    ix = cat.open(name)
    k = F.try_variant_get(ix.variant(ix.resolve("k")), "$.k", "long")
    return ix.df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.unix_micros("ts")).alias("latest_us"), F.sum(k).alias("k"))


@query("SELECT event_id FROM events WHERE event_id % 100 <> 0 AND NOT (event_type = 'error' AND user_id < 10)")
def catalog_delete_where(spark, sf_dir):
    """A delete by query that rewrites the splits with matches, after which they are merged."""
    cat, name = _landed(spark, sf_dir)
    cat.delete_where(name, lang.parse("event_type:error AND user_id:<10"))
    cat.merge(name)
    return cat.open(name).df.select("event_id")


@query("SELECT outcome, CAST(count(*) AS BIGINT) AS docs FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'not a JSON object' WHEN event_id % 7 = 0 THEN 'value: no f64' ELSE 'valid' END AS outcome FROM events) GROUP BY outcome")
def ingest_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("much")).otherwise(F.col("value").cast("string")).alias("value")))
    docs = e.select(F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(good).alias("doc"))
    m = Mapping((Field("event_id", "i64"), Field("value", "f64")), mode="strict")
    return ingest.counts(readers.parse(docs, m))


@query("SELECT event_id::VARCHAR AS span_id, event_type AS service_name, CAST(epoch_us(ts) // 1000 AS BIGINT) AS start_ms, CAST(floor(value) AS BIGINT) AS duration_ms, json_extract_string(props, '$.k') AS k FROM events")
def otlp_flatten(spark, sf_dir):
    """Messages of one span each, made of the events, flattened again."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    attr = lambda k, v: F.array(F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value")))
    span = F.struct(
        F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("").alias("parentSpanId"), F.lit("op").alias("name"), F.lit(2).alias("kind"), start.cast("string").alias("startTimeUnixNano"),
        (start + F.floor("value").cast("long") * 1_000_000).cast("string").alias("endTimeUnixNano"), attr("k", F.get_json_object("props", "$.k")).alias("attributes"), F.array().cast("array<struct<name:string>>").alias("events"),
    )
    scope = F.array(F.struct(F.struct(F.lit("s").alias("name")).alias("scope"), F.array(span).alias("spans")))
    message = F.to_json(F.struct(F.array(F.struct(F.struct(attr("service.name", F.col("event_type")).alias("attributes")).alias("resource"), scope.alias("scopeSpans"))).alias("resourceSpans")))
    s = otlp.spans(e.select(message.alias("value")))
    return s.select("span_id", "service_name", F.unix_millis("span_start_timestamp").alias("start_ms"), F.col("span_duration_millis").alias("duration_ms"), F.col("span_attributes")["k"].alias("k"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'events' END AS name, event_id AS id, event_type AS kind FROM events")
def bulk_ingest(spark, sf_dir):
    """Bulk bodies of action and document lines, one for some hundred events each."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_id") % 3 == 0, F.lit('{"create": {"_index": "other"}}')).otherwise(F.lit('{"index": {}}'))
    lines = F.concat(action, F.lit("\n"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))), F.lit("\n\n"))
    bodies = e.groupBy(F.floor(F.col("event_id") / 200)).agg(F.array_join(F.collect_list(lines), "").alias("body"))
    docs = readers.bulk_bodies(bodies, "body", "events")
    return docs.select("name", F.get_json_object("doc", "$.id").cast("long").alias("id"), F.get_json_object("doc", "$.kind").alias("kind"))

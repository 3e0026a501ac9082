"""Queries of the aggregations, as flat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mapping import Field, Index, Mapping
from ..operators import aggs, search
from ..plans.compile import Compiler
from ..plans import lang
from .base import index, query, table


def _buckets(ix: Index, spec: dict):
    return aggs.buckets(ix, ix.df, spec)


@query("SELECT event_type AS key, CAST(count(*) AS BIGINT) AS doc_count FROM events GROUP BY event_type ORDER BY doc_count DESC, key LIMIT 3")
def agg_terms(spark, sf_dir):
    return _buckets(index(spark, sf_dir, "events"), {"terms": {"field": "event_type", "size": 3}}).select(F.col("_key").alias("key"), "doc_count")


@query("SELECT CAST(sum(n) AS BIGINT) AS sum_other_doc_count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type OFFSET 2)")
def agg_terms_other_count(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    got = aggs.run(ix, ix.df, {"t": {"terms": {"field": "event_type", "size": 2}}})
    return spark.createDataFrame([(got["t"]["sum_other_doc_count"],)], "sum_other_doc_count long")


@query("SELECT event_type AS key, CAST(count(*) AS BIGINT) AS doc_count, round(avg(value), 6) AS mean FROM events GROUP BY event_type ORDER BY avg(value) DESC LIMIT 4")
def agg_terms_order_sub(spark, sf_dir):
    spec = {"terms": {"field": "event_type", "size": 4, "order": {"mean": "desc"}}, "aggs": {"mean": {"avg": {"field": "value"}}}}
    return _buckets(index(spark, sf_dir, "events"), spec).select(F.col("_key").alias("key"), "doc_count", F.round("mean", 6).alias("mean"))


@query("SELECT user_id AS key, CAST(count(*) AS BIGINT) AS doc_count FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3 ORDER BY key LIMIT 500")
def agg_terms_min_doc_count(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    df = search.matching(ix, search.Request("event_type:error"))
    got = aggs.buckets(ix, df, {"terms": {"field": "user_id", "size": 500, "min_doc_count": 3, "order": {"_key": "asc"}}})
    return got.select(F.col("_key").alias("key"), "doc_count")


@query("SELECT key, CAST(count(*) AS BIGINT) AS doc_count FROM (SELECT unnest([l_returnflag, l_linestatus]) AS key FROM lineitem) GROUP BY key")
def agg_terms_multivalued(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_returnflag", "l_linestatus").alias("tags"))
    ix = Index(df, Mapping((Field("tags", "text", array=True, tokenizer="raw"),), id_column="l_orderkey"))
    return _buckets(ix, {"terms": {"field": "tags", "size": 100}}).select(F.col("_key").alias("key"), "doc_count")


@query("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'none') AS key, CAST(count(*) AS BIGINT) AS doc_count FROM events GROUP BY 1")
def agg_terms_missing(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("t"))
    return _buckets(Index(df), {"terms": {"field": "t", "missing": "none"}}).select(F.col("_key").alias("key"), "doc_count")


@query("SELECT floor(l_quantity / 10) * 10 AS key, CAST(count(*) AS BIGINT) AS doc_count FROM lineitem GROUP BY 1")
def agg_histogram(spark, sf_dir):
    return _buckets(index(spark, sf_dir, "lineitem"), {"histogram": {"field": "l_quantity", "interval": 10}}).select(F.col("_key").alias("key"), "doc_count")


@query("SELECT floor((l_quantity - 3) / 10) * 10 + 3 AS key, CAST(count(*) AS BIGINT) AS doc_count FROM lineitem GROUP BY 1")
def agg_histogram_offset(spark, sf_dir):
    return _buckets(index(spark, sf_dir, "lineitem"), {"histogram": {"field": "l_quantity", "interval": 10, "offset": 3}}).select(F.col("_key").alias("key"), "doc_count")


_GAPS = "SELECT floor(value / 20) * 20 AS key FROM events WHERE value < 60 OR value > 140"


@query(
    f"WITH k AS ({_GAPS}), e AS (SELECT min(key) AS lo, max(key) AS hi FROM k), g AS (SELECT lo + 20 * unnest(range(0, CAST((hi - lo) / 20 AS BIGINT) + 1)) AS key FROM e) "
    "SELECT g.key, CAST(count(k.key) AS BIGINT) AS doc_count FROM g LEFT JOIN k ON g.key = k.key GROUP BY g.key"
)
def agg_histogram_gaps(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    df = ix.df.where(Compiler(ix).predicate(lang.parse("value:<60 OR value:>140")))
    return aggs.buckets(ix, df, {"histogram": {"field": "value", "interval": 20}}).select(F.col("_key").alias("key"), "doc_count")


@query(
    "WITH k AS (SELECT floor(value / 10) * 10 AS key FROM events WHERE value BETWEEN 20 AND 45), g AS (SELECT CAST(10 * unnest(range(0, 9)) AS DOUBLE) AS key) "
    "SELECT g.key, CAST(count(k.key) AS BIGINT) AS doc_count FROM g LEFT JOIN k ON g.key = k.key GROUP BY g.key"
)
def agg_histogram_bounds(spark, sf_dir):
    spec = {"histogram": {"field": "value", "interval": 10, "hard_bounds": {"min": 20, "max": 45}, "extended_bounds": {"min": 0, "max": 85}}}
    return _buckets(index(spark, sf_dir, "events"), spec).select(F.col("_key").alias("key"), "doc_count")


@query("SELECT CAST(epoch_us(date_trunc('day', ts)) // 1000 AS BIGINT) AS key, CAST(count(*) AS BIGINT) AS doc_count FROM events GROUP BY 1")
def agg_date_histogram(spark, sf_dir):
    return _buckets(index(spark, sf_dir, "events"), {"date_histogram": {"field": "ts", "fixed_interval": "1d"}}).select(F.col("_key").alias("key"), "doc_count")


@query("SELECT CAST(floor((epoch_us(ts) // 1000 + 345600000) / 2592000000.0) AS BIGINT) * 2592000000 - 345600000 AS key, CAST(count(*) AS BIGINT) AS doc_count FROM events GROUP BY 1")
def agg_date_histogram_offset(spark, sf_dir):
    return _buckets(index(spark, sf_dir, "events"), {"date_histogram": {"field": "ts", "fixed_interval": "30d", "offset": "-4d"}}).select(F.col("_key").alias("key"), "doc_count")


@query(
    "SELECT r.key, CAST(count(l.l_quantity) AS BIGINT) AS doc_count FROM (VALUES ('*-10', -1e9, 10), ('small', 10, 20), ('20-30', 20, 30), ('30-40', 30, 40), ('40-*', 40, 1e9)) r(key, lo, hi) "
    "LEFT JOIN lineitem l ON l.l_quantity >= r.lo AND l.l_quantity < r.hi GROUP BY r.key"
)
def agg_range(spark, sf_dir):
    spec = {"range": {"field": "l_quantity", "ranges": [{"from": 10, "to": 20, "key": "small"}, {"from": 30, "to": 40}]}}
    return _buckets(index(spark, sf_dir, "lineitem"), spec).select(F.col("_key").alias("key"), "doc_count")


def _metrics(spark, sf_dir, specs: dict):
    ix = index(spark, sf_dir, "lineitem")
    return aggs.grouped(ix, ix.df, [], specs).drop("doc_count")


@query("SELECT round(avg(l_extendedprice), 4) AS mean FROM lineitem")
def agg_avg(spark, sf_dir):
    return _metrics(spark, sf_dir, {"mean": {"avg": {"field": "l_extendedprice"}}}).select(F.round("mean", 4).alias("mean"))


@query("SELECT CAST(count(l_shipdate) AS BIGINT) AS n FROM lineitem")
def agg_value_count(spark, sf_dir):
    return _metrics(spark, sf_dir, {"n": {"value_count": {"field": "l_shipdate"}}})


@query("SELECT min(l_tax) AS low, max(l_tax) AS high, round(sum(l_quantity), 2) AS total FROM lineitem")
def agg_min_max_sum(spark, sf_dir):
    got = _metrics(spark, sf_dir, {"low": {"min": {"field": "l_tax"}}, "high": {"max": {"field": "l_tax"}}, "total": {"sum": {"field": "l_quantity"}}})
    return got.withColumn("total", F.round("total", 2))


@query("SELECT CAST(count(value) AS BIGINT) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events")
def agg_stats(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    s = aggs.grouped(ix, ix.df, [], {"s": {"extended_stats": {"field": "value"}}})
    return s.select(F.col("`s.count`").alias("n"), F.round("`s.sum`", 4).alias("total"), F.col("`s.min`").alias("low"), F.col("`s.max`").alias("high"), F.round("`s.avg`", 6).alias("mean"), F.round("`s.std_deviation`", 6).alias("deviation"))


_PCT = ", ".join(f"list_sort(list(value))[1 + CAST(floor({q / 100} * (count(*) - 1)) AS BIGINT)] AS p{q}" for q in (5, 50, 95, 99))


@query(f"SELECT event_type, {_PCT} FROM events GROUP BY event_type")
def agg_percentiles(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    return aggs.percentiles(ix.df, ["event_type"], F.col("value"), (5, 50, 95, 99))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS doc_count, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY event_type")
def agg_nested_terms_stats(spark, sf_dir):
    spec = {"terms": {"field": "event_type"}, "aggs": {"s": {"stats": {"field": "value"}}}}
    got = _buckets(index(spark, sf_dir, "events"), spec)
    return got.select(F.col("_key").alias("event_type"), "doc_count", F.round("`s.sum`", 4).alias("total"), F.col("`s.max`").alias("high"))


@query("SELECT CAST(epoch_us(date_trunc('day', ts)) // 1000 AS BIGINT) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def agg_nested_date_terms(spark, sf_dir):
    """A tree of two bucket levels, with its result as rows."""
    ix = index(spark, sf_dir, "events")
    tree = {"d": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}, "aggs": {"t": {"terms": {"field": "event_type"}}}}}
    got = aggs.run(ix, ix.df, tree)["d"]["buckets"]
    rows = [(d["key"], t["key"], t["doc_count"]) for d in got for t in d["t"]["buckets"]]
    return spark.createDataFrame(rows, "day long, event_type string, n long")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) AS latest_ms FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 10")
def agg_trace_ids_topk(spark, sf_dir):
    got = aggs.trace_ids(table(spark, sf_dir, "events"), "user_id", "ts", 10)
    return got.select("user_id", F.unix_millis(F.col("span_timestamp").cast("timestamp")).alias("latest_ms"))


@query("SELECT CAST(count(*) AS BIGINT) AS count FROM lineitem WHERE l_quantity >= 25 AND l_returnflag = 'R'")
def hit_count(spark, sf_dir):
    return search.count(index(spark, sf_dir, "lineitem"), search.Request("l_quantity:>=25 AND l_returnflag:R"))


@query("SELECT CAST(count(*) AS BIGINT) AS count FROM lineitem")
def count_metadata_only(spark, sf_dir):
    """No column is read: the rows are counted by the footers."""
    return search.count(index(spark, sf_dir, "lineitem"), search.Request())


@query("SELECT event_type AS key, round(avg(k), 6) AS mean FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type")
def agg_json_metric(spark, sf_dir):
    spec = {"terms": {"field": "event_type"}, "aggs": {"mean": {"avg": {"field": "props.k"}}}}
    return _buckets(index(spark, sf_dir, "events"), spec).select(F.col("_key").alias("key"), F.round("mean", 6).alias("mean"))


def _customers(spark, sf_dir) -> Index:
    """A row per customer, with the prices and states of all their orders."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("price"), F.collect_list("o_orderstatus").alias("state"))
    m = Mapping((Field("o_custkey", "i64"), Field("price", "f64", array=True), Field("state", "text", array=True, tokenizer="raw")), id_column="o_custkey")
    none = spark.createDataFrame([(-1, [], None)], "o_custkey long, price array<double>, state array<string>")
    return Index(o.unionByName(none), m)


_CUSTOMERS = "WITH c AS (SELECT o_custkey, list(o_totalprice) AS price, list(DISTINCT o_orderstatus) AS state FROM orders GROUP BY 1 UNION ALL SELECT -1, [], ['none']), s AS (SELECT o_custkey, price, unnest(state) AS state FROM c) "


@query(
    _CUSTOMERS + "SELECT state, CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(len(price)) AS BIGINT) AS n, round(coalesce(sum(list_sum(price)), 0), 2) AS total, round(min(list_min(price)), 2) AS least, round(max(list_max(price)), 2) AS most, "
    "round(sum(list_sum(price)) / sum(len(price)), 4) AS mean FROM s GROUP BY state"
)
def agg_array_stats(spark, sf_dir):
    """Buckets and metrics over fields of several values, and of none."""
    got = _buckets(_customers(spark, sf_dir), {"terms": {"field": "state", "missing": "none"}, "aggs": {"p": {"stats": {"field": "price"}}}})
    return got.select(F.col("_key").alias("state"), "doc_count", F.col("`p.count`").alias("n"), F.round("`p.sum`", 2).alias("total"), F.round("`p.min`", 2).alias("least"), F.round("`p.max`", 2).alias("most"), F.round("`p.avg`", 4).alias("mean"))


@query("SELECT round(quantile_disc(o_totalprice, 0.5), 2) AS p50, round(var_pop(o_totalprice) / 1e6, 2) AS var FROM orders")
def agg_array_percentiles(spark, sf_dir):
    ix = _customers(spark, sf_dir)
    got = aggs.grouped(ix, ix.df, [], {"q": {"percentiles": {"field": "price", "percents": [50.0]}}, "e": {"extended_stats": {"field": "price"}}})
    return got.select(F.round("`q.50`", 2).alias("p50"), F.round(F.col("`e.variance`") / 1e6, 2).alias("var"))


@query(
    "SELECT 'types' AS agg, event_type AS key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type UNION ALL "
    "SELECT 'days', strftime(ts, '%Y-%m-%dT00:00:00Z'), CAST(count(*) AS BIGINT) FROM events GROUP BY 2 UNION ALL SELECT 'values', 'value', CAST(count(value) AS BIGINT) FROM events"
)
def agg_siblings(spark, sf_dir):
    """Three aggregations side by side, as one result."""
    ix = index(spark, sf_dir, "events")
    got = aggs.run(ix, ix.df, {"types": {"terms": {"field": "event_type"}}, "days": {"date_histogram": {"field": "ts", "fixed_interval": "1d", "min_doc_count": 1}}, "values": {"value_count": {"field": "value"}}})
    rows = [(n, str(b.get("key_as_string", b["key"])), b["doc_count"]) for n in ("types", "days") for b in got[n]["buckets"]]
    return spark.createDataFrame([*rows, ("values", "value", got["values"]["value"])], "agg string, key string, n long")

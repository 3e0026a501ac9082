"""Queries of the predicate nodes and both query languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import scalars
from ..mapping import Field, Index, Mapping
from ..operators import search
from ..plans import ast as A
from ..plans import dsl, lang
from ..plans.compile import Compiler
from .base import DOCUMENTS, D, index, query, table


def _where(ix: Index, node: A.Node, *columns: str) -> DataFrame:
    return ix.df.where(Compiler(ix).predicate(node)).select(*columns)


def _events(spark, sf_dir, text: str, *columns: str) -> DataFrame:
    ix = index(spark, sf_dir, "events")
    return _where(ix, lang.parse(text, ix.mapping.default_fields), *(columns or ("event_id",)))


def _docs(spark, sf_dir, node: A.Node | dict | str) -> DataFrame:
    ix = index(spark, sf_dir, "documents")
    if isinstance(node, dict):
        node = dsl.parse(node, ix.mapping.default_fields)
    elif isinstance(node, str):
        node = lang.parse(node, ix.mapping.default_fields)
    return _where(ix, node, "doc_id")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "event_type:error", "event_id", "user_id", "value")


@query("SELECT event_id FROM events WHERE user_id = 7")
def term_integer(spark, sf_dir):
    return _events(spark, sf_dir, "user_id:7")


@query(D + "SELECT t.term, CAST(count(d.doc_id) AS BIGINT) AS hits FROM (VALUES ('The'), ('the')) t(term) LEFT JOIN d ON list_contains(d.tok, t.term) GROUP BY t.term")
def term_text_raw_case(spark, sf_dir):
    """A term is not analysed, so a capital letter finds nothing in lower-cased tokens."""
    ix = index(spark, sf_dir, "documents")
    c = Compiler(ix)
    counts = ix.df.agg(*[F.count(F.when(c.predicate(A.Term("text", t)), 1)).alias(f"n{i}") for i, t in enumerate(("The", "the"))])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(n).alias("hits")) for t, n in zip(("The", "the"), counts.columns, strict=True)])
    return counts.select(F.inline(pairs))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def term_set(spark, sf_dir):
    return _events(spark, sf_dir, "event_type: IN [error purchase]")


@query(D + "SELECT doc_id FROM d WHERE list_contains(tok, 'nicht') OR list_contains(tok, 'apache')")
def match_or(spark, sf_dir):
    return _docs(spark, sf_dir, {"match": {"text": {"query": "Nicht APACHE"}}})


@query(D + "SELECT doc_id FROM d WHERE list_contains(tok, 'the') AND list_contains(tok, 'of') AND list_contains(tok, 'ea')")
def match_and(spark, sf_dir):
    return _docs(spark, sf_dir, {"match": {"text": {"query": "the of, ea", "operator": "and"}}})


@query("SELECT CAST(count(*) AS BIGINT) AS hits FROM documents WHERE false")
def zero_terms_none(spark, sf_dir):
    return _docs(spark, sf_dir, {"match": {"text": {"query": "!?"}}}).agg(F.count("*").alias("hits"))


@query("SELECT CAST(count(*) AS BIGINT) AS hits FROM documents")
def zero_terms_all(spark, sf_dir):
    return _docs(spark, sf_dir, {"match": {"text": {"query": "!?", "zero_terms_query": "all"}}}).agg(F.count("*").alias("hits"))


_POS = "list_filter(range(1, len(tok) + 1), lambda p: tok[p] = '{}')"


def _phrase_sql(*terms: str) -> str:
    at = " AND ".join(f"tok[p + {i}] = '{t}'" for i, t in enumerate(terms))
    return f"SELECT doc_id FROM d WHERE len(list_filter(range(1, len(tok) + 1), lambda p: {at})) > 0"


@query(D + _phrase_sql("apache", "license", "version", "2", "0"))
def phrase(spark, sf_dir):
    return _docs(spark, sf_dir, 'text:"Apache License, Version 2.0"')


@query(
    D + f", p AS (SELECT doc_id, unnest({_POS.format('under')}) AS a, {_POS.format('license')} AS bs FROM d), "
    "q AS (SELECT doc_id, a, unnest(bs) - 1 AS b FROM p) SELECT DISTINCT doc_id FROM q WHERE greatest(a, b) - least(a, b) <= 4"
)
def phrase_slop(spark, sf_dir):
    return _docs(spark, sf_dir, {"match_phrase": {"text": {"query": "under license", "slop": 4}}})


@query(D + "SELECT doc_id FROM d WHERE len(list_filter(range(1, len(tok) + 1), lambda p: tok[p] = 'the' AND starts_with(tok[p + 1], 'lic'))) > 0 OR len(list_filter(range(1, len(tok) + 1), lambda p: tok[p] = 'mit' AND starts_with(tok[p + 1], 'lic'))) > 0")
def phrase_prefix(spark, sf_dir):
    return _docs(spark, sf_dir, {"bool": {"should": [{"match_phrase_prefix": {"text": {"query": "the lic"}}}, {"match_phrase_prefix": {"text": "MIT lic"}}]}})


@query(D + "SELECT doc_id FROM d WHERE list_contains(tok, 'gnu') OR len(list_filter(tok, lambda t: starts_with(t, 'lizen'))) > 0")
def bool_prefix(spark, sf_dir):
    return _docs(spark, sf_dir, {"match_bool_prefix": {"text": {"query": "gnu lizen"}}})


@query(D + "SELECT doc_id FROM d WHERE len(list_filter(tok, lambda t: starts_with(t, 'licen'))) > 0")
def wildcard_suffix(spark, sf_dir):
    return _docs(spark, sf_dir, "text:Licen*")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey BETWEEN 10 AND 20")
def range_int(spark, sf_dir):
    return _where(index(spark, sf_dir, "lineitem"), lang.parse("l_partkey:[10 TO 20]"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.02 AND l_discount < 0.05")
def range_float_excl(spark, sf_dir):
    return _where(index(spark, sf_dir, "lineitem"), lang.parse("l_discount:{0.02 TO 0.05}"), "l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07 12:00:00'")
def range_ts(spark, sf_dir):
    return _events(spark, sf_dir, "ts:[2024-01-05 TO 2024-01-07T12:00:00Z}")


@query("SELECT event_id FROM events WHERE date_trunc('second', ts) > TIMESTAMP '2024-01-10 00:00:10' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-11'")
def range_ts_precision(spark, sf_dir):
    """With a precision of seconds both values and bounds are truncated to it."""
    m = Mapping((Field("event_id", "i64"), Field("ts", "datetime", precision="seconds")), timestamp="ts", id_column="event_id")
    ix = Index(table(spark, sf_dir, "events"), m, "events")
    return _where(ix, A.Range("ts", gt="2024-01-10T00:00:10.7Z", lte="2024-01-11T00:00:00Z"), "event_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20")
def range_json_numeric(spark, sf_dir):
    return _events(spark, sf_dir, "props.k:[10 TO 20]")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 42")
def term_json(spark, sf_dir):
    return _events(spark, sf_dir, "props.k:42")


@query("SELECT CAST(count(*) AS BIGINT) AS hits FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def exists_json_path(spark, sf_dir):
    return _events(spark, sf_dir, "props.k:*").agg(F.count("*").alias("hits"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 50 AND NOT (user_id BETWEEN 3 AND 5)")
def bool_must_should(spark, sf_dir):
    """A should beside a must does not narrow the result."""
    ix = index(spark, sf_dir, "events")
    q = {"bool": {"must": {"term": {"event_type": "click"}}, "should": [{"term": {"user_id": 1}}], "must_not": [{"range": {"user_id": {"gte": 3, "lte": 5}}}], "filter": [{"range": {"value": {"gt": 50}}}]}}
    return _where(ix, dsl.parse(q), "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' OR user_id = 1")
def bool_should_only(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    return _where(ix, dsl.parse({"bool": {"should": [{"term": {"event_type": {"value": "click"}}}, {"term": {"user_id": 1}}]}}), "event_id")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL OR o.o_orderpriority <> '1-URGENT'")
def bool_must_not_null_safe(spark, sf_dir):
    """A row without the field passes a must_not."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    df = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return _where(Index(df), lang.parse("NOT o_orderpriority:1-URGENT"), "c_custkey", "o_orderkey")


@query("SELECT CAST(count(*) AS BIGINT) AS hits FROM events")
def bool_empty(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    return _where(ix, dsl.parse({"bool": {}}), "event_id").agg(F.count("*").alias("hits"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' AND event_type = 'view'")
def time_interval(spark, sf_dir):
    ix = index(spark, sf_dir, "events")
    return search.matching(ix, search.Request("event_type:view", start_timestamp=1704240000, end_timestamp=1704326400)).select("event_id")


@query("SELECT event_id FROM events WHERE user_id BETWEEN 4 AND 300")
def ip_range(spark, sf_dir):
    """An address per user; the range 10.0.0.4 to 10.0.1.44."""
    u = F.col("user_id")
    ip = F.concat_ws(".", F.lit("10"), F.floor(u / 65536).cast("string"), F.pmod(F.floor(u / 256), F.lit(256)).cast("string"), F.pmod(u, F.lit(256)).cast("string"))
    df = table(spark, sf_dir, "events").withColumn("host", scalars.ip_to_hex(ip))
    ix = Index(df, Mapping((Field("event_id", "i64"), Field("host", "ip")), id_column="event_id"))
    return _where(ix, lang.parse("host:[10.0.0.4 TO 10.0.1.44]"), "event_id")


@query(D + "SELECT doc_id FROM d WHERE (list_contains(tok, 'license') OR len(list_filter(tok, lambda t: starts_with(t, 'lizenz'))) > 0) AND lang IN ('en', 'de') AND n_chars > 500 AND NOT list_contains(tok, 'gnu')")
def mini_language_mix(spark, sf_dir):
    return _docs(spark, sf_dir, "(license OR lizenz*) AND lang: IN [en de] AND n_chars:>500 AND NOT gnu")


@query(D + "SELECT doc_id FROM d WHERE (list_contains(tok, 'apache') AND list_contains(tok, 'license')) OR list_contains(tok, 'mit')")
def mini_language_default_and(spark, sf_dir):
    return _docs(spark, sf_dir, "'apache license' OR +mit")


@query(D + "SELECT doc_id FROM d WHERE list_contains(tok, 'apache') OR list_contains(tok, 'gnu')")
def es_query_string(spark, sf_dir):
    return _docs(spark, sf_dir, {"query_string": {"query": "Apache GNU", "fields": ["text"]}})


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'es')")
def es_terms(spark, sf_dir):
    return _docs(spark, sf_dir, {"terms": {"lang": ["fr", "es"], "boost": 2}})


@query(D + "SELECT doc_id FROM d WHERE list_contains(tok, 'src7') OR list_contains(tok, 'src3') OR source IN ('src7', 'src3')")
def es_multi_match(spark, sf_dir):
    m = Mapping((*[f for f in DOCUMENTS.fields if f.name != "source"], Field("source", "text", tokenizer="default")), id_column="doc_id")
    ix = Index(table(spark, sf_dir, "documents"), m, "documents")
    return _where(ix, dsl.parse({"multi_match": {"query": "src7 src3", "fields": ["text", "source"]}}), "doc_id")


@query(D + _phrase_sql("public", "license"))
def es_multi_match_phrase(spark, sf_dir):
    return _docs(spark, sf_dir, {"multi_match": {"query": "public license", "fields": ["text"], "type": "phrase"}})


@query("SELECT event_id FROM events WHERE starts_with(event_type, 'p')")
def wildcard_raw(spark, sf_dir):
    """On an untokenized field the prefix reaches the scan."""
    return _events(spark, sf_dir, "event_type:p*")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id >= 10")
def lenient_literal(spark, sf_dir):
    """A literal that its field cannot hold matches nothing where that is asked for."""
    ix = index(spark, sf_dir, "documents")
    q = lang.parse("lang:de AND doc_id:>=10 AND NOT n_chars:many")
    return ix.df.where(Compiler(ix, lenient=True).predicate(q)).select("doc_id")


@query(D + _phrase_sql("public", "license"))
def es_match_phrase(spark, sf_dir):
    return _docs(spark, sf_dir, {"match_phrase": {"text": {"query": "Public License"}}})


@query("SELECT CAST(count(*) AS BIGINT) AS count FROM events WHERE event_type = 'error' AND value >= 50")
def es_count(spark, sf_dir):
    n = api.es_count(index(spark, sf_dir, "events"), {"query": {"bool": {"must": [{"term": {"event_type": "error"}}], "filter": [{"range": {"value": {"gte": 50}}}]}}})
    return spark.createDataFrame([(n,)], "count long")

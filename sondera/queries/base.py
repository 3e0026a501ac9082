"""Tables of a folder as indexes, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..mapping import Field, Index, Mapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = Mapping(
    (
        Field("event_id", "i64"), Field("ts", "datetime"), Field("user_id", "i64"), Field("event_type", "text", tokenizer="raw"), Field("value", "f64"), Field("props", "json", tokenizer="raw"),
    ),
    timestamp="ts", tags=("event_type",), default_fields=("event_type",), id_column="event_id",
)
DOCUMENTS = Mapping(
    (
        Field("doc_id", "i64"), Field("text", "text", tokenizer="default", record="position", fieldnorms=True, fast=False), Field("lang", "text", tokenizer="raw"), Field("source", "text", tokenizer="raw"), Field("n_chars", "i64"),
    ),
    tags=("lang",), default_fields=("text",), id_column="doc_id",
)
ORDERS = Mapping((Field("o_orderkey", "i64"), Field("o_custkey", "i64"), Field("o_orderstatus", "text", tokenizer="raw"), Field("o_totalprice", "f64"), Field("o_orderdate", "datetime"), Field("o_orderpriority", "text", tokenizer="raw")), timestamp="o_orderdate", id_column="o_orderkey")
MAPPINGS = {"events": EVENTS, "documents": DOCUMENTS, "orders": ORDERS}

#: The tokens of ``documents.text`` as SQL.
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) <= 255)"
D = f"WITH d AS (SELECT doc_id, lang, source, n_chars, {TOKENS} AS tok FROM documents) "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with its SQL where it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, name: str) -> Index:
    return Index(table(spark, sf_dir, name), MAPPINGS.get(name) or Mapping(id_column={"lineitem": "l_orderkey"}.get(name)), name)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the shape of spans: a user is a trace, an event type a service."""
    e = table(spark, sf_dir, "events")
    none = F.create_map().cast("map<string,string>")
    start = F.col("ts").cast("timestamp")
    kind = F.lit(2)
    return e.select(
        F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("event_type").alias("service_name"),
        F.concat(F.lit("op"), F.pmod("event_id", F.lit(4)).cast("string")).alias("span_name"), kind.alias("span_kind"), start.alias("span_start_timestamp"), F.floor("value").cast("long").alias("span_duration_millis"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("span_attributes"), none.alias("resource_attributes"),
        F.struct(F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("code"), F.lit(None).cast("string").alias("message")).alias("span_status"),
        F.array().cast("array<struct<timestamp:timestamp,name:string,attributes:map<string,string>>>").alias("events"),
        scalars.span_fingerprint(F.col("event_type"), kind, F.concat(F.lit("op"), F.pmod("event_id", F.lit(4)).cast("string"))).alias("span_fingerprint"),
    )

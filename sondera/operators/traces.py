"""Trace lookup: services, operations, and two-phase search for whole traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import scalars

KINDS = {0: "unspecified", 1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
#: A page of trace ids is joined by broadcast; it never holds more than this.
MOST_TRACES = 10_000


def services(spans: DataFrame) -> DataFrame:
    return spans.select("service_name").where("service_name is not null").distinct().orderBy("service_name")


def operations(spans: DataFrame, service: str, kind: int | None = None) -> DataFrame:
    """Distinct (span_name, span_kind) of a service, by the range of its fingerprints."""
    f = scalars.span_fingerprint(F.col("service_name"), F.col("span_kind"), F.col("span_name"))
    low = service + "\0" + ("" if kind is None else f"{kind}\0")
    found = spans.where((f >= low) & (f < low[:-1] + "\1")).select("span_name", "span_kind").distinct()
    return found.orderBy("span_name", "span_kind")


def predicate(service: str | None = None, name: str | None = None, tags: dict[str, str] | None = None, start_min=None, start_max=None, duration_min_ms: int | None = None, duration_max_ms: int | None = None) -> Column:
    """Spans that a trace must have one of.  A tag may stand on the span, its events or
    its resource; ``error`` is the span's status."""
    out = F.lit(True)
    if service:
        out &= F.col("service_name") == service
    if name:
        out &= F.col("span_name") == name
    for k, v in (tags or {}).items():
        if k == "error" and v in ("true", "false"):
            is_error = F.coalesce(F.col("span_status.code") == "error", F.lit(False))
            out &= is_error if v == "true" else ~is_error
        else:
            any_of = F.coalesce(F.col("span_attributes")[k] == v, F.lit(False)) | F.coalesce(F.col("resource_attributes")[k] == v, F.lit(False))
            out &= any_of
    ts = F.col("span_start_timestamp")
    if start_min is not None:
        out &= ts >= F.lit(start_min)
    if start_max is not None:
        out &= ts <= F.lit(start_max)
    if duration_min_ms is not None:
        out &= F.col("span_duration_millis") >= duration_min_ms
    if duration_max_ms is not None:
        out &= F.col("span_duration_millis") <= duration_max_ms
    return F.coalesce(out, F.lit(False))


def find_trace_ids(spans: DataFrame, where: Column, k: int = 20) -> DataFrame:
    from .aggs import trace_ids

    if not 0 < k <= MOST_TRACES:
        raise QueryError(f"at most {MOST_TRACES} traces")
    return trace_ids(spans.where(where), "trace_id", "span_start_timestamp", k)


def find_traces(spans: DataFrame, where: Column, k: int = 20, window: str = "1 hour") -> DataFrame:
    """All spans of the latest k matching traces.  The second read is bound to the ids
    and to a window around their timestamps."""
    ids = find_trace_ids(spans, where, k)
    around = F.expr(f"interval {window}")
    hit = F.broadcast(ids.select(F.col("trace_id").alias("_t"), F.col("span_timestamp").alias("_ts")))
    ts = F.col("span_start_timestamp")
    return spans.join(hit, (F.col("trace_id") == F.col("_t")) & (ts >= F.col("_ts") - around) & (ts <= F.col("_ts") + around), "left_semi")


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id)


def jaeger_span(spans: DataFrame) -> DataFrame:
    """Spans in the shape of a trace viewer."""
    def tags(c: Column) -> Column:
        return F.transform(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>")))), lambda e: F.struct(e["key"].alias("key"), F.lit("string").alias("type"), e["value"].alias("value")))

    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    own = F.array(F.struct(F.lit("span.kind").alias("key"), F.lit("string").alias("type"), F.try_element_at(kind, F.col("span_kind")).alias("value")))
    failed = F.when(F.col("span_status.code") == "error", F.array(F.struct(F.lit("error").alias("key"), F.lit("bool").alias("type"), F.lit("true").alias("value")))).otherwise(F.array().cast("array<struct<key:string,type:string,value:string>>"))
    parent = F.when(F.col("parent_span_id").isNotNull(), F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_span_id").alias("spanID"))))
    return spans.select(
        F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("span_name").alias("operationName"), parent.alias("references"),
        F.unix_micros(F.col("span_start_timestamp").cast("timestamp")).alias("startTime"), (F.col("span_duration_millis") * 1000).cast("long").alias("duration"),
        F.concat(tags(F.col("span_attributes")), own, failed).alias("tags"),
        F.transform("events", lambda e: F.struct(F.unix_micros(e["timestamp"].cast("timestamp")).alias("timestamp"), F.concat(F.array(F.struct(F.lit("event").alias("key"), F.lit("string").alias("type"), e["name"].alias("value"))), tags(e["attributes"])).alias("fields"))).alias("logs"),
        F.struct(F.col("service_name").alias("serviceName"), tags(F.col("resource_attributes")).alias("tags")).alias("process"),
    )

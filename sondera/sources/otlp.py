"""OpenTelemetry messages to rows: resource, scope and record exploded, and the fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floor_div, span_fingerprint

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTR = f"array<struct<key:string,value:{_VALUE}>>"
_TRACES = (
    f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTR},droppedAttributesCount:bigint>,scopeSpans:array<struct<scope:struct<name:string,version:string,attributes:{_ATTR}>,spans:array<struct<traceId:string,spanId:string,traceState:string,parentSpanId:string,name:string,kind:string,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTR},events:array<struct<timeUnixNano:string,name:string,attributes:{_ATTR}>>,links:array<struct<traceId:string,spanId:string,attributes:{_ATTR}>>,status:struct<message:string,code:string>>>>>>>>"
)
_LOGS = (
    f"struct<resourceLogs:array<struct<resource:struct<attributes:{_ATTR},droppedAttributesCount:bigint>,scopeLogs:array<struct<scope:struct<name:string,version:string,attributes:{_ATTR}>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:{_VALUE},attributes:{_ATTR},traceId:string,spanId:string,flags:bigint>>>>>>>"
)
_KINDS = {"SPAN_KIND_UNSPECIFIED": 0, "SPAN_KIND_INTERNAL": 1, "SPAN_KIND_SERVER": 2, "SPAN_KIND_CLIENT": 3, "SPAN_KIND_PRODUCER": 4, "SPAN_KIND_CONSUMER": 5}

#: The schema of :func:`spans`, as DDL.
SPAN = (
    "trace_id string, span_id string, trace_state string, parent_span_id string, service_name string, resource_attributes map<string,string>, scope_name string, scope_version string, span_name string, span_kind int, span_start_timestamp timestamp, span_end_timestamp timestamp, "
    "span_start_timestamp_nanos bigint, span_end_timestamp_nanos bigint, span_duration_millis bigint, span_attributes map<string,string>, span_status struct<code:string,message:string>, events array<struct<timestamp:timestamp,name:string,attributes:map<string,string>>>, event_names array<string>, "
    "links array<struct<trace_id:string,span_id:string,attributes:map<string,string>>>, span_fingerprint string, is_root boolean"
)


def _text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def _map(attrs: Column) -> Column:
    kept = F.filter(attrs, lambda a: a["key"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda a: F.struct(a["key"], _text(a["value"]))))


def _ts(nanos: Column) -> Column:
    return F.timestamp_micros(floor_div(nanos, 1000))


def _number(c: Column, names: dict[str, int]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(c.try_cast("int"), F.try_element_at(m, c), F.lit(0))


def spans(raw: DataFrame, column: str = "value") -> DataFrame:
    """A row for each span of the messages."""
    m = raw.select(F.explode(F.from_json(F.col(column), _TRACES)["resourceSpans"]).alias("r"))
    m = m.select(_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("s"))
    m = m.select("res", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("p"))
    start, end = F.col("p.startTimeUnixNano").cast("long"), F.col("p.endTimeUnixNano").cast("long")
    service = F.coalesce(F.col("res")["service.name"], F.lit("unknown_service"))
    kind = _number(F.col("p.kind"), _KINDS)
    code = _number(F.col("p.status.code"), {"STATUS_CODE_UNSET": 0, "STATUS_CODE_OK": 1, "STATUS_CODE_ERROR": 2})
    parent = F.when(F.col("p.parentSpanId") != "", F.col("p.parentSpanId"))
    no_service = F.map_filter("res", lambda k, _: k != "service.name")
    return m.select(
        F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"), F.col("p.traceState").alias("trace_state"), parent.alias("parent_span_id"), service.alias("service_name"), no_service.alias("resource_attributes"),
        F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version"), F.col("p.name").alias("span_name"), kind.alias("span_kind"), _ts(start).alias("span_start_timestamp"), _ts(end).alias("span_end_timestamp"),
        start.alias("span_start_timestamp_nanos"), end.alias("span_end_timestamp_nanos"), floor_div(end - start, 1_000_000).alias("span_duration_millis"), _map(F.col("p.attributes")).alias("span_attributes"),
        F.struct(F.when(code == 1, "ok").when(code == 2, "error").otherwise("unset").alias("code"), F.col("p.status.message").alias("message")).alias("span_status"),
        F.transform("p.events", lambda e: F.struct(_ts(e["timeUnixNano"].cast("long")).alias("timestamp"), e["name"].alias("name"), _map(e["attributes"]).alias("attributes"))).alias("events"),
        F.transform("p.events", lambda e: e["name"]).alias("event_names"),
        F.transform("p.links", lambda e: F.struct(e["traceId"].alias("trace_id"), e["spanId"].alias("span_id"), _map(e["attributes"]).alias("attributes"))).alias("links"),
        span_fingerprint(service, kind, F.col("p.name")).alias("span_fingerprint"), parent.isNull().alias("is_root"),
    )


def logs(raw: DataFrame, column: str = "value") -> DataFrame:
    """A row for each log record of the messages; the observed time stands in for a missing time."""
    m = raw.select(F.explode(F.from_json(F.col(column), _LOGS)["resourceLogs"]).alias("r"))
    m = m.select(_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeLogs").alias("s"))
    m = m.select("res", F.col("s.scope").alias("scope"), F.explode("s.logRecords").alias("p"))
    at = F.coalesce(F.nullif(F.col("p.timeUnixNano").cast("long"), F.lit(0)), F.col("p.observedTimeUnixNano").cast("long"))
    return m.select(
        at.alias("timestamp_nanos"), _ts(at).alias("timestamp"), F.col("p.observedTimeUnixNano").cast("long").alias("observed_timestamp_nanos"), F.coalesce(F.col("res")["service.name"], F.lit("unknown_service")).alias("service_name"), F.col("p.severityText").alias("severity_text"),
        F.col("p.severityNumber").alias("severity_number"), _text(F.col("p.body")).alias("body"), _map(F.col("p.attributes")).alias("attributes"), F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"),
        F.map_filter("res", lambda k, _: k != "service.name").alias("resource_attributes"), F.col("scope.name").alias("scope_name"), F.col("scope.version").alias("scope_version"),
    )

"""OpenTelemetry messages in protocol buffers, read by field number into their JSON form."""

from __future__ import annotations

import json
import struct
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field numbers of the public message definitions, with JSON name and kind;
# a kind is another message, repeated if it ends with *, or how the bytes are written.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "Traces": {1: ("resourceSpans", "ResourceSpans*")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scopeSpans", "ScopeSpans*")},
    "Resource": {1: ("attributes", "KeyValue*"), 2: ("droppedAttributesCount", "number")},
    "ScopeSpans": {1: ("scope", "Scope"), 2: ("spans", "Span*")},
    "Scope": {1: ("name", "text"), 2: ("version", "text"), 3: ("attributes", "KeyValue*")},
    "Span": {
        1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "text"), 4: ("parentSpanId", "hex"), 5: ("name", "text"), 6: ("kind", "number"), 7: ("startTimeUnixNano", "long"), 8: ("endTimeUnixNano", "long"), 9: ("attributes", "KeyValue*"),
        11: ("events", "Event*"), 13: ("links", "Link*"), 15: ("status", "Status"),
    },
    "Event": {1: ("timeUnixNano", "long"), 2: ("name", "text"), 3: ("attributes", "KeyValue*")},
    "Link": {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "text"), 4: ("attributes", "KeyValue*")},
    "Status": {2: ("message", "text"), 3: ("code", "number")},
    "KeyValue": {1: ("key", "text"), 2: ("value", "AnyValue")},
    "AnyValue": {1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "long"), 4: ("doubleValue", "double"), 7: ("stringValue", "hex")},
    "Logs": {1: ("resourceLogs", "ResourceLogs*")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scopeLogs", "ScopeLogs*")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("logRecords", "LogRecord*")},
    "LogRecord": {1: ("timeUnixNano", "long"), 2: ("severityNumber", "number"), 3: ("severityText", "text"), 5: ("body", "AnyValue"), 6: ("attributes", "KeyValue*"), 8: ("flags", "number"), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "long")},
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number does not end")
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _fields(data: bytes):
    """Field number and value; a value is a number or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else _varint(data, at)
            if at + size > len(data):
                raise ValueError("a field does not end")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"there is no wire type {wire}")
        yield tag >> 3, value


def _number(value: int | bytes, signed: bool = True) -> int:
    n = value if isinstance(value, int) else int.from_bytes(value, "little")
    return n - (1 << 64) if signed and n >= 1 << 63 else n


def read(data: bytes, message: str) -> dict[str, Any]:
    """A message as the dictionary that its JSON form holds; unknown fields are skipped."""
    out: dict[str, Any] = {}
    for number, value in _fields(data):
        name, kind = MESSAGES[message].get(number, ("", ""))
        if not name:
            continue
        if kind.endswith("*"):
            out.setdefault(name, []).append(read(value, kind[:-1]))
        elif kind in MESSAGES:
            out[name] = read(value, kind)
        elif kind == "text":
            out[name] = value.decode()
        elif kind == "hex":
            out[name] = value.hex()
        elif kind == "bool":
            out[name] = bool(value)
        elif kind == "double":
            out[name] = struct.unpack("<d", value)[0]
        else:
            out[name] = _number(value) if kind == "number" else str(_number(value))
    return out


def to_json(raw: DataFrame, message: str, column: str = "value") -> DataFrame:
    """The messages of a binary column as JSON text in ``value``; null where one cannot be read."""

    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else json.dumps(read(data, message))
        except (ValueError, AttributeError, TypeError, struct.error):
            return None

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([one(x) for x in b.column(0).to_pylist()], pa.string())], names=["value"])

    return raw.select(F.col(column).cast("binary").alias("value")).mapInArrow(work, "value string")

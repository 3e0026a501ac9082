"""Value streams of all matches, and hits as JSON."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import scalars
from ..mapping import Index
from . import search

_STREAMED = ("i64", "u64", "datetime")


def stream(index: Index, request: search.Request, fast_field: str, partition_by: str | None = None) -> DataFrame:
    """One fast field of every match, in no order; with ``partition_by`` a row per
    partition value and value, which a writer partitions by."""
    r = index.resolve(fast_field)
    if r.field.kind not in _STREAMED or not r.field.fast:
        raise QueryError(f"{fast_field!r} of type {r.field.kind} cannot be streamed")
    df = search.matching(index, request)
    value = F.explode(r.column) if r.field.array else r.column
    if partition_by is None:
        return df.select(value.alias(fast_field)).where(F.col(fast_field).isNotNull())
    p = index.resolve(partition_by)
    if p.field.kind != r.field.kind:
        raise QueryError("the partition field has another type than the streamed field")
    return df.select(p.column.alias("_partition"), value.alias(fast_field)).where(F.col(fast_field).isNotNull())


def partitioned(streamed: DataFrame, field: str) -> DataFrame:
    """The values of each partition as a sorted list, merged over the whole index.  For
    partitions that fit in memory; larger ones are written with :func:`write_csv`."""
    return streamed.groupBy("_partition").agg(F.sort_array(F.collect_list(field)).alias("values"))


def write_csv(streamed: DataFrame, path: str) -> None:
    w = streamed.write
    if "_partition" in streamed.columns:
        w = w.partitionBy("_partition")
    w.csv(path)


def row_binary(streamed: DataFrame) -> DataFrame:
    """Little-endian 64-bit values packed into binary rows, an Arrow batch a row."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(0).to_numpy(zero_copy_only=False), "<i8").tobytes()], pa.binary())], names=["bytes"])

    c = F.col(streamed.columns[-1])
    kind = streamed.schema[-1].dataType.typeName()
    return streamed.select((F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("long")).alias("v")).mapInArrow(work, "bytes binary")


def frame(values: dict[int, list[int]]) -> bytes:
    """Partitions framed for a reader: key, count, values, all little-endian 64-bit."""
    return b"".join(struct.pack(f"<qQ{len(v)}q", k, len(v), *v) for k, v in sorted(values.items()))


def output(index: Index) -> list[Column]:
    """Every mapped column as it is given out: dates, numbers and bytes in the output
    format of their field."""
    out = []
    made = {f.tokens for f in index.mapping.fields if f.tokens}
    for f in index.df.schema.fields:
        if f.name in made:
            continue
        m = index.mapping.get(f.name)
        c = F.col(f"`{f.name}`")
        if m is not None and not m.array:
            if not m.stored:
                continue
            if m.kind == "datetime":
                c = scalars.format_datetime(c.cast("timestamp"), m.output_format)
            elif m.kind == "bytes":
                c = scalars.encode_bytes(c, "hex" if m.output_format == "hex" else "base64")
            elif m.kind in ("i64", "u64", "f64"):
                c = scalars.output_number(c, "string" if m.output_format == "string" else "number")
        out.append(c.alias(f.name))
    return out


def hits_json(index: Index, hits: DataFrame) -> DataFrame:
    """Each hit as a JSON object."""
    return hits.select(F.to_json(F.struct(*[c for c in output(index.with_df(hits))])).alias("json"))

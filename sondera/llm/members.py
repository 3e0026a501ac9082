"""Which ids may be in a set: a filter of fixed size that goes to every task.

The set's ids set bits of an array of ``2 ** BITS`` bits, 16 MB whatever the input.  It is
put together by segment, so the driver gets one row a segment.  Rows outside the set are
dropped where they are read, before a shuffle, but for those whose bit another id has set:
the exact join follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BITS, SEGMENT_BITS = 27, 17


def _place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << BITS))


def bits(at: DataFrame) -> np.ndarray:
    """The bits of the places ``at``, below ``2 ** BITS``, as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SEGMENT_BITS, bool)
        bits[table.column("at").to_numpy() & ((1 << SEGMENT_BITS) - 1)] = True
        return pa.table([pa.array([table.column("segment")[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "bits"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (SEGMENT_BITS - 3)
    for r in at.distinct().withColumn("segment", F.shiftright("at", SEGMENT_BITS)).groupBy("segment").applyInArrow(pack, "segment long, bits binary").collect():
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at the places are set."""
    at = at.astype(np.int64)
    return (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """The bits of a column's ids as bytes."""
    return bits(ids.select(_place(F.col(column)).alias("at")))


def near_set(rows: DataFrame, column: str, ids: DataFrame, id_column: str, work, schema: str) -> DataFrame:
    """``work`` of the Arrow batches of those rows whose ``column`` may be among the ids."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(ids, id_column))
    last = len(rows.columns)

    def some(batches):
        for b in batches:
            hit = np.flatnonzero(has(held.value, b.column(last).to_numpy()))
            if len(hit):
                yield b.take(pa.array(hit)).select(range(last))

    return rows.withColumn("_at", _place(F.col(column))).mapInArrow(shared.tidy(lambda batches: work(some(batches))), schema)

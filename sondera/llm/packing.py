"""Best-fit packing of token sequences.

Documents are tokenised, ended with id 1 and cut into pieces of at most
``capacity`` tokens.  Best-fit decreasing takes the pieces by falling length
and puts each into the open bin with the least room that still holds it.  A
segment tree over the remaining capacities finds that bin in logarithmic time.

Pieces of equal length are interchangeable, so the plan is made on the
histogram of lengths, which has at most ``capacity`` rows for any input: bins
of equal content form a range of bin numbers, and each step moves a whole range
at once.  Each step uses up a length or a range of bins, so the number of ranges
depends on the capacity (some 48,000 of 40 bytes at 4096, measured up to 10^8
pieces) and not on the pieces.  The result is that of best-fit decreasing over all pieces, one at a
time.  The plan's ranges are then joined with each piece's rank among the
pieces of its length, so no task or driver ever holds the corpus.

Defined results: null text is an empty document of the end id alone; an empty
table gives no sequences; repeated rows are packed each; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .bpe import WordBpe, ended

CAPACITY, END_ID = 4096, 1


class FreeTree:
    """Which remaining capacities have open bins: the least one of at least n is found in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)

    def set(self, r: int, value: bool) -> None:
        i = r + self.size
        self.some[i] = value
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def least(self, n: int) -> int:
        """The least open capacity of at least ``n``, or -1."""
        i = n + self.size
        if self.some[i]:
            return n
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Ranges (length, first rank, n, first bin, offset) and the number of bins."""
    tree, open_bins, out, n_bins = FreeTree(capacity), {}, [], 0

    def push(r: int, first: int, n: int) -> None:
        if r and n:
            open_bins.setdefault(r, []).append((first, n))
            tree.set(r, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = tree.least(length)
            if r < 0:
                r, first, n = capacity, n_bins, -(-left // (capacity // length))
                n_bins += n
            else:
                first, n = open_bins[r].pop()
                if not open_bins[r]:
                    tree.set(r, False)
            each = r // length  # as many go into one bin before the next is tighter
            full = min(n, left // each)
            for i in range(each) if full else ():
                out.append((length, rank, full, first, capacity - r + i * length))
                rank += full
            left -= full * each
            push(r - each * length, first, full)
            if full < n and left and left < each:
                for i in range(left):
                    out.append((length, rank, 1, first + full, capacity - r + i * length))
                    rank += 1
                push(r - left * length, first + full, 1)
                left, full = 0, full + 1
            push(r, first + full, n - full)
    return np.array(sorted(out), np.int64).reshape(-1, 5), n_bins


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A table in the shared folder: doc_id, piece, start, length, part and k (the
    piece's place among those of its length in its part), and ids (little-endian
    unsigned 32-bit integers, compressed)."""

    def work(batches):
        bpe, part, seen = WordBpe.of(tokenizer_path), TaskContext.get().partitionId(), {}
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, at = ended(*bpe.encode_column(batch.column(1)), end_id)
            planes = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
            n_pieces = -(-np.diff(at) // capacity)
            row = np.repeat(np.arange(batch.num_rows), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(np.diff(at)[row] - start, capacity)
            k = np.empty(len(row), np.int64)
            for i, n in enumerate(length.tolist()):
                seen[n] = k[i] = seen.get(n, -1) + 1
            first = (at[row] + start).tolist()
            packed = [pack.compress(np.ascontiguousarray(planes[:, a : a + n])) for a, n in zip(first, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(k), pa.array(packed, pa.binary())],
                names=["doc_id", "piece", "start", "length", "part", "k", "ids"],
            )

    docs = shared.id_and_text(documents)
    return shared.materialize(docs.mapInArrow(shared.tidy(work), "doc_id long, piece int, start long, length long, part int, k long, ids binary"), "pieces")


def unpack(blob: bytes) -> bytes:
    """The ids of a piece as little-endian unsigned 32-bit integers."""
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).tobytes()


def assign(table: DataFrame, columns: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``columns`` of the pieces with sequence_id and offset."""
    counts = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = shared.materialize(counts, "counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges, _ = plan(total, capacity)
    held = table.sparkSession.sparkContext.broadcast(ranges)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_l"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = table.join(base, (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p")), "left").select(
        *columns, F.col("length").alias("_length"), (F.col("_base") + F.col("k")).alias("_rank")
    )
    schema = ranked.select(*columns).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        r = held.value
        key = r[:, 0] * (1 << 48) + r[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (len(columns), len(columns) + 1))
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(columns))), pa.array(r[at, 3] + rank - r[at, 1], pa.int64()), pa.array(r[at, 4], pa.int64())],
                names=schema.names,
            )

    return ranked.mapInArrow(shared.tidy(place), schema)


def crc32s(table: DataFrame) -> DataFrame:
    """The pieces without their ids, but with ids_crc32."""

    def work(batches):
        for b in batches:
            crc = [zlib.crc32(unpack(x)) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])

    cols = ["doc_id", "piece", "start", "length", "part", "k"]
    schema = table.select(*cols).schema.add("ids_crc32", "long")
    return table.select(*cols, "ids").mapInArrow(shared.tidy(work), schema)


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (compressed), sequence_id, offset."""
    return assign(pieces(documents, tokenizer_path, capacity, end_id), ["doc_id", "piece", "start", "length", "ids"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int> and the documents' offsets.
    A sequence is bounded by the capacity, so a group is small."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["offset"])
        ids = np.concatenate([np.frombuffer(unpack(r["ids"]), "<u4") for r in rows]).astype(np.int32)
        return pa.table(
            [pa.array([rows[0]["sequence_id"]], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([[r["doc_id"] for r in rows]], pa.list_(pa.int64())), pa.array([[r["offset"] for r in rows]], pa.list_(pa.int64()))],
            names=["sequence_id", "ids", "doc_ids", "offsets"],
        )

    return packed.select("sequence_id", "offset", "doc_id", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>, doc_ids array<long>, offsets array<long>")


def digest(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The placement of every piece with the checksum of its ids in their place."""
    table = crc32s(pieces(documents, tokenizer_path, capacity, end_id))
    return assign(table, ["doc_id", "piece", "start", "length", "ids_crc32"], capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

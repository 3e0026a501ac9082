"""Token-id files in a byte-aligned code of variable length.

Ids are ranked by their frequency over the whole corpus, so that frequent ids
get small ranks.  A rank takes one to four bytes.  Two bits per rank tell how
many, kept in separate control bytes of four ranks each; a decoder finds the
lengths of four ranks in a table by one control byte and gathers the data bytes
with numpy.

A store is a folder in the shared file system: part files in ascending order of
doc_id and a table of the ranks.  Part files hold blocks of whole documents:

    b"SVB1", uint32 n_docs, uint64 n_ids, uint64 control bytes, uint64 data bytes,
    int64 doc_ids[n_docs], uint8 has_id[n_docs], uint64 lengths[n_docs], control, data

all little-endian.  A part's row in the manifest gives its place in the order.

Defined results: null text is an empty text, so a document of the end id alone;
an empty table gives an empty store; rows with equal doc_id all appear, side by
side, in a fixed order; a null doc_id comes first; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import shared
from .bpe import ByteBpe, ended

END_ID, BLOCK_IDS, PART_IDS = 0, 1 << 20, 1 << 24
_HEAD = "<4sIQQQ"

#: Lengths in bytes of the four ranks of each control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    r = np.ascontiguousarray(ranks, "<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    keep = np.arange(4)[None, :] <= code[:, None]
    data = r.view(np.uint8).reshape(-1, 4)[keep]
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    c = padded.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    d = np.frombuffer(data, np.uint8)
    start = np.cumsum(length, dtype=np.int64) - length
    out = d[start].astype(np.uint32)
    for b in (1, 2, 3):
        at = np.flatnonzero(length > b)
        if not len(at):
            break
        out[at] |= d[start[at] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def _squeeze(ids: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    planes = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T
    return pack.compress(np.ascontiguousarray(planes))


def _expand(blob: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(unpack.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def tokenized(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """A table in the shared folder: doc_id, n_tokens, ids (compressed); and from each task
    a row with ``counts``, how often it met each id (compressed)."""

    def work(batches):
        bpe, total, pack = ByteBpe.of(tokenizer_path), np.zeros(0, np.int64), zstandard.ZstdCompressor(level=3)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        for b in batches:
            ids, at = ended(*bpe.encode_column(b.column(1)), end_id)
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
            packed = [_squeeze(ids[a:z], pack) for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(packed, pa.binary()), pa.nulls(b.num_rows, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zstandard.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=names)

    docs = shared.id_and_text(documents)
    return shared.materialize(docs.mapInArrow(shared.tidy(work), "doc_id long, n_tokens long, ids binary, counts binary"), "tokens")


def frequencies(tokens: DataFrame) -> DataFrame:
    """How often each id occurs in the whole corpus, from the tasks' own counts."""

    def work(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n = np.frombuffer(zstandard.decompress(x), "<i8") if x else np.zeros(0, np.int64)
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return tokens.select("counts").where("counts is not null").mapInArrow(shared.tidy(work), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Store:
    """A written store: its manifest (part, path, n_docs, n_ids, base) and ids by rank."""

    def __init__(self, manifest: DataFrame, ids_by_rank: np.ndarray):
        self.manifest, self.ids_by_rank = manifest, ids_by_rank


def write(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, part_ids: int = PART_IDS) -> Store:
    """Tokenise, rank and write all documents in ascending order of doc_id."""
    spark = documents.sparkSession
    tokens = tokenized(documents, tokenizer_path, end_id)
    # One row per id of the vocabulary, whatever the corpus.
    counted = sorted(((r["n"], r["id"]) for r in frequencies(tokens).collect()), key=lambda x: (-x[0], x[1]))
    ids_by_rank = np.array([i for _, i in counted], np.uint32)
    rank_of = np.zeros(int(ids_by_rank.max()) + 1 if len(ids_by_rank) else 1, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank))
    ranks, folder = spark.sparkContext.broadcast(rank_of), shared.new_folder(spark, "token_store")
    n_parts = max(1, -(-sum(n for n, _ in counted) // part_ids))

    def blocks(batches, seen):
        docs, size, unpack = [], 0, zstandard.ZstdDecompressor()
        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append((doc, ranks.value[_expand(x, unpack)]))
                size += len(docs[-1][1])
                if size >= BLOCK_IDS:
                    yield from block(docs, seen)
                    docs, size = [], 0
        if docs:
            yield from block(docs, seen)

    def block(docs, seen):
        r = np.concatenate([x for _, x in docs])
        control, data = encode(r)
        seen["docs"] += len(docs)
        seen["ids"] += len(r)
        yield struct.pack(_HEAD, b"SVB1", len(docs), len(r), len(control), len(data))
        yield np.array([d or 0 for d, _ in docs], "<i8").tobytes()
        yield np.array([d is not None for d, _ in docs], np.uint8).tobytes()
        yield np.array([len(x) for _, x in docs], "<u8").tobytes()
        yield control
        yield data

    def put(batches):
        seen, part = {"docs": 0, "ids": 0}, TaskContext.get().partitionId()
        path, _ = shared.write_file(folder, f"part-{part:08d}", blocks(batches, seen))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int64()), (path, pa.string()), (seen["docs"], pa.int64()), (seen["ids"], pa.int64()))], names=["part", "path", "n_docs", "n_ids"])

    ordered = tokens.where("counts is null").select("doc_id", "ids").repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    manifest = shared.materialize(ordered.mapInArrow(shared.tidy(put), "part long, path string, n_docs long, n_ids long"), "manifest")
    shared.remove(tokens)
    # A row per part file of many million ids, so one task can sum them.
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return Store(manifest.where("n_docs > 0").withColumn("base", base), ids_by_rank)


def read(spark: SparkSession, store: Store, with_ids: bool = False) -> DataFrame:
    """The documents of a store in order of start: doc_id, start, n_tokens, ids_crc32
    and, if asked for, ids."""
    table = spark.sparkContext.broadcast(store.ids_by_rank.astype("<u4"))

    def work(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with shared.read_file(path) as f:
                    while head := f.read(struct.calcsize(_HEAD)):
                        magic, n_docs, n_ids, n_control, n_data = struct.unpack(_HEAD, head)
                        if magic != b"SVB1":
                            raise ValueError(f"{path} is not a token store")
                        doc = np.frombuffer(f.read(8 * n_docs), "<i8")
                        null = np.frombuffer(f.read(n_docs), np.uint8) == 0
                        size = np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)
                        ids = table.value[decode(f.read(n_control), f.read(n_data), n_ids)]
                        cut = np.concatenate([[0], np.cumsum(size)])
                        crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(cut, cut[1:], strict=False)]
                        cols = [pa.array(doc, pa.int64(), mask=null), pa.array(base + cut[:-1], pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
                        base += n_ids
                        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    schema = S.StructType([S.StructField(c, S.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    if with_ids:
        schema = schema.add("ids", S.ArrayType(S.IntegerType()))
    n = max(1, store.manifest.count())
    return store.manifest.select("path", "base").repartition(n, "path").mapInArrow(shared.tidy(work), schema)

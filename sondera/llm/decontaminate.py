"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words and winnowed: of each ``w``
consecutive k-grams the one with the smallest hash is kept, with
``k + w - 1 = window``.  Two texts that share a span of ``window`` words select
the same k-gram inside it, so the join of the fingerprints misses no shared
span.  Each joined fingerprint is extended to the whole windows around it.  An item of fewer words than a window is one
window of its own length; documents are searched for each such length with
``w = 1``.

Both sides stay in Spark.  A window's fingerprint is the smallest hash of its k-grams;
the benchmark's distinct windows and the documents' candidates are joined by fingerprint
and compared word by word.  What goes to every task is a bit array of fixed size (16 MB,
see ``members``) of the benchmark's fingerprints, which keeps all else out of the shuffle;
a benchmark that fills the bits makes the shuffle larger and leaves the result as it is.
The join is dealt over :data:`SALTS` parts of each fingerprint, as a passage may stand in
a third of all documents.

Defined results: null or empty text has no words, is never contaminated and
has ``n_items`` 0; an item without words or id is never found; items of one id are one
item; each row is judged by itself, also where rows are equal or share a doc_id or have
none; an empty benchmark hits nothing; other columns are ignored by
:func:`decontaminate` and kept by :func:`keep_clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import members, shared
from . import text as T

WINDOW, KGRAM, SALTS = 13, 7, 16

def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each ``w`` consecutive hashes;
    of fewer than ``w``, the smallest of all."""
    if not len(h):
        return np.empty(0, np.int64)
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    v = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(len(v)) + (w - 1 - np.argmin(v[:, ::-1], axis=1)))


def selected(h: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the winnowed k-grams of each row."""
    pos, wo = T.windows(first, k)
    g = T.window_hashes(h, pos, k)
    if w == 1 or not len(g):
        return pos, g
    # A running minimum over all rows; windows that cross rows are masked out.
    v = np.lib.stride_tricks.sliding_window_view(np.concatenate([g, np.full(w - 1, ~T.U64(0))]), w)
    at = np.arange(len(g)) + (w - 1 - np.argmin(v[:, ::-1], axis=1))
    n = np.diff(wo)
    end = np.repeat(wo[1:], n)
    keep = np.zeros(len(g), bool)
    keep[at[np.arange(len(g)) + w <= end]] = True
    for r in np.flatnonzero((n > 0) & (n < w)):
        keep[wo[r] + winnow(g[wo[r] : wo[r + 1]], w)] = True
    return pos[keep], g[keep]


def _words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = T.buffers(texts)
    data = T.LOWER[data]
    s, e, first = T.split_words(data, off, T.ALNUM)
    return data, s, e, first


def grams(size: int, window: int, k: int) -> tuple[int, int]:
    """The k-gram length of windows of ``size`` words, and how many k-grams a window has."""
    k = min(k, size) if size == window else size
    return k, size - k + 1


def candidates(h: np.ndarray, first: np.ndarray, size: int, k: int, w: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and fingerprints of the windows whose smallest k-gram hash may be one of
    the benchmark's; they lie around a k-gram that may be."""
    pos, wo = T.windows(first, k)
    g = T.window_hashes(h, pos, k)
    at = np.flatnonzero(members.has(bits, g >> T.U64(64 - members.BITS)))
    if not len(at):
        return at, g[:0].view(np.int64)
    row = np.searchsorted(wo, at, "right") - 1
    near = at[:, None] - np.arange(w)
    inside = (near >= wo[row][:, None]) & (near + w <= wo[row + 1][:, None])
    near = np.unique(near[inside])
    fp = g[near[:, None] + np.arange(w)].min(axis=1) if len(near) else g[:0]
    keep = members.has(bits, fp >> T.U64(64 - members.BITS))
    return pos[near[keep]], fp[keep].view(np.int64)


def _join_words(d: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, size: int) -> list[bytes]:
    return [b" ".join(d[s[q] : e[q]].tobytes() for q in range(p, p + size)) for p in at.tolist()]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """The distinct windows: fp, words, size, and the items that have them (sorted)."""

    def work(batches):
        for b in batches:
            data, s, e, first = _words(b.column(1))
            h = T.span_hashes(data, s, e)
            for r in range(b.num_rows):
                n = int(first[r + 1] - first[r])
                if not n:
                    continue
                size = min(window, n)
                kk, w = grams(size, window, k)
                pos, _ = T.windows(first[r : r + 2], size)
                g = T.window_hashes(h, np.arange(first[r], first[r + 1] - kk + 1), kk)
                fp = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(_join_words(data, s, e, pos, size), pa.binary()), pa.array(np.full(len(pos), size), pa.int32()), pa.array([b.column(0)[r].as_py()] * len(pos), pa.string())],
                    names=["fp", "words", "size", "item_id"],
                )

    b = shared.bounded(benchmark).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return b.mapInArrow(shared.tidy(work), "fp long, words binary, size int, item_id string").groupBy("fp", "words", "size").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


_SCANNED = "row long, doc_id long, text_hash long, n_words long, fp long, at int, size int, words binary"


def scan(documents: DataFrame, sizes: list[int], bits: np.ndarray, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """A row per row of the documents (fp is null), with a number of its own, and a row per
    candidate window."""
    held = documents.sparkSession.sparkContext.broadcast(bits)
    names = [c.split()[0] for c in _SCANNED.split(", ")]

    def work(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = T.buffers(batch.column(1))
            for i, j in T.slices(off):
                d = T.LOWER[data[off[i] : off[j]]]
                s, e, first = T.split_words(d, off[i : j + 1] - off[i], T.ALNUM)
                none = lambda t, n=j - i: pa.nulls(n, t)
                doc, hashes = batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i)
                rows = number + np.arange(j - i)
                number += j - i
                yield pa.RecordBatch.from_arrays([pa.array(rows), doc, hashes, pa.array(np.diff(first), pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.binary())], names=names)
                h = T.span_hashes(d, s, e)
                for size in sizes:
                    at, fp = candidates(h, first, size, *grams(size, window, k), held.value)
                    for lo in range(0, len(at), 4096):
                        p = at[lo : lo + 4096]
                        r = np.searchsorted(first, p, "right") - 1
                        no = pa.nulls(len(p), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(rows[r]), no, no, no, pa.array(fp[lo : lo + 4096]), pa.array(p - first[r], pa.int32()), pa.array(np.full(len(p), size), pa.int32()), pa.array(_join_words(d, s, e, p, size), pa.binary())], names=names)

    docs = shared.id_and_text(documents).withColumn("text_hash", F.xxhash64("text"))
    return docs.mapInArrow(shared.tidy(work), _SCANNED)


def _found(documents: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    spark = documents.sparkSession
    wins = shared.materialize(benchmark_windows(benchmark, window, k), "benchmark_windows")
    # One number for each length of a window, of which there are at most ``window``.
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())
    bits = members.bits(wins.select(F.shiftrightunsigned("fp", 64 - members.BITS).alias("at")))
    scanned = shared.materialize(scan(documents, sizes, bits, window, k), "scanned")
    rows = scanned.where("fp is null").select("row", "doc_id", "text_hash", "n_words")
    # Equal candidates of one row differ in place only; each meets at most one window.
    asked = scanned.where("fp is not null").select("row", "at", "fp", "words", F.pmod("row", F.lit(SALTS)).alias("salt"))
    salted = wins.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = asked.join(salted, ["fp", "words", "salt"]).select("row", "at", "size", "items")
    per_row = hits.groupBy("row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(at, at + size - 1)"))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out = rows.join(per_row, "row", "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (found item ids, sorted), contaminated.

    A document is contaminated where at least a twentieth of its words are hit.
    """
    return _found(documents, benchmark, window, k).drop("text_hash")


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """The rows that are not contaminated, with all their columns.  A row is told by its
    doc_id and its text, so rows that share a doc_id, or have none, go one by one."""
    gone = _found(documents, benchmark, window, k).where("contaminated").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    same = documents["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & F.xxhash64(documents["text"].cast("string")).eqNullSafe(gone["_gone_text"])
    return documents.join(gone, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The items as a count and a SHA-256 of their comma-joined ids."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )

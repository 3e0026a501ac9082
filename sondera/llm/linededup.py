"""Repeated passages of lines, found with content-defined chunks.

The lines of a document are cut into chunks.  A hash that rolls over the hashes of
two neighbouring lines sets a boundary before the two where it is divisible by
``divisor``, and one behind the two where it leaves a remainder of one, so the same
lines are cut alike wherever they stand, whatever precedes and follows them.  A
chunk between such boundaries has at least two lines.  A line
of at least ``long_words`` words is a passage of its own, with a boundary on
either side.  Chunks of two or more lines, and long lines, are counted over all
documents.  Of each chunk that occurs again, the occurrence with the smallest
(doc_id, place) stays; every other one is removed after its bytes have been
compared with those of the one that stays.

``dedup_passages`` also counts, from each line and to each line, the shortest run of
lines with ``long_words`` words.  These depend on nothing but their own lines, and
together they cover every repeated run of so many words, which therefore goes whole.
Their keys are 64-bit hashes; runs are joined and compared byte by byte as chunks are.

Defined results: null text stays null, empty text stays empty; single short
lines are never removed; blank lines alone are no chunk; rows that share a
doc_id are one document, whose equal chunks in equal places are one occurrence;
a row with a null doc_id loses nothing and makes others lose nothing; other
columns are untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as T

DIVISOR, LONG_WORDS = 2, 50


def chunk_cuts(hashes: np.ndarray, words: np.ndarray, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[int]:
    """First lines of the chunks of one document, and the number of its lines."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolling = T.mix(hashes[:-1] * T.U64(3) + hashes[1:] * T.U64(0x9E3779B97F4A7C15))
    left = rolling % T.U64(divisor)
    may = np.zeros(n + 1, bool)  # a boundary before line i
    may[: n - 1] |= left == 0
    may[2 : n + 1] |= left == 1 % divisor
    may = may.tolist()
    big = (words >= long_words).tolist()
    cuts = [0]
    for i in range(1, n):
        if big[i] or big[i - 1] or (may[i] and i - cuts[-1] >= 2):
            cuts.append(i)
    return [*cuts, n]


def chunks(texts, divisor: int = DIVISOR, long_words: int = LONG_WORDS):
    """For each text its bytes and the spans (start, end, countable) of its chunks."""
    data, off = T.buffers(texts)
    for i, j in T.slices(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        ls, le, first = T.split_lines(d, o)
        h = T.span_hashes(d, ls, le)
        s, _, _ = T.split_words(d, o, T.NOT_SPACE)
        words = np.searchsorted(s, le) - np.searchsorted(s, ls)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            w = words[a:b]
            cuts = chunk_cuts(h[a:b], w, divisor, long_words)
            spans = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                counted = w[x] >= long_words or (y - x > 1 and w[x:y].any())
                spans.append((int(ls[a + x] - o[r]), int(le[a + y - 1] - o[r]), bool(counted)))
            yield d[o[r] : o[r + 1]].tobytes(), spans


def _key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def occurrences(documents: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The countable chunks: key, doc_id, place."""
    schema = [("key", pa.binary()), ("doc_id", pa.int64()), ("place", pa.int32())]

    def work(batches):
        for b in batches:
            rows = []
            for doc, (text, spans) in zip(b.column(0).to_pylist(), chunks(b.column(1), divisor, long_words), strict=True):
                rows += [(_key(text[x:y]), doc, p) for p, (x, y, counted) in enumerate(spans) if counted]
            yield _batch(rows, schema)

    return shared.id_and_text(documents).where("doc_id is not null").mapInArrow(shared.tidy(work), "key binary, doc_id long, place int")


def marked(documents: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents in the shared folder, with a column ``_places``: the places of
    chunks that occur again, their keys, and whether they are to go."""
    occ = shared.materialize(occurrences(documents, divisor, long_words), "chunks")
    groups = occ.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).where("n > 1").select("key", F.col("first.doc_id").alias("fd"), F.col("first.place").alias("fp"))
    again = occ.join(groups, "key").select("doc_id", "place", "key", ((F.col("doc_id") != F.col("fd")) | (F.col("place") != F.col("fp"))).alias("gone"))
    # At most the chunks of one document.
    lists = again.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("place", "key", "gone")).alias("_places"))
    out = shared.materialize(documents.join(lists, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc"), "marked")
    shared.remove(occ)
    return out


def _texts(docs: DataFrame, divisor: int, long_words: int) -> DataFrame:
    """key, doc_id, place, gone and the bytes of each repeated chunk."""
    schema = [("key", pa.binary()), ("doc_id", pa.int64()), ("place", pa.int32()), ("gone", pa.bool_()), ("chunk", pa.binary())]

    def work(batches):
        for b in batches:
            rows = []
            for doc, places, (text, spans) in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), chunks(b.column(1), divisor, long_words), strict=True):
                for p in places:
                    if p["place"] < len(spans):
                        x, y, _ = spans[p["place"]]
                        if _key(text[x:y]) == p["key"]:
                            rows.append((p["key"], doc, p["place"], p["gone"], text[x:y]))
            yield _batch(rows, schema)

    d = docs.where("_places is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_places")
    return d.mapInArrow(shared.tidy(work), "key binary, doc_id long, place int, gone boolean, chunk binary")


def unequal(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """Occurrences (doc, place) whose bytes differ from those of the chunk that stays."""
    t = _texts(docs, divisor, long_words)
    stay = t.where("not gone").select(F.col("key").alias("k"), F.col("chunk").alias("c")).dropDuplicates(["k"])
    return t.where("gone").join(stay, F.col("key") == F.col("k")).where("chunk <> c").select(F.col("doc_id").alias("_doc"), "place").distinct()


def dedup_lines(documents: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents with their columns, ``text`` without the chunks that go, and
    columns _chunks_removed and _chars_removed behind them."""
    docs = marked(documents, divisor, long_words)
    other = shared.materialize(unequal(docs, divisor, long_words), "unequal")
    if not other.isEmpty():
        lists = other.groupBy("_doc").agg(F.collect_set("place").alias("_stay"))
        docs = docs.join(lists, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc")
        docs = docs.withColumn("_places", F.expr("filter(_places, p -> not array_contains(coalesce(_stay, array()), p.place))")).drop("_stay")
    at, columns = documents.columns.index("text"), len(documents.columns)

    def work(batches):
        for b in batches:
            marks = b.column(columns).to_pylist()
            texts, n, chars = b.column(at).to_pylist(), [0] * len(marks), [0] * len(marks)
            some = [r for r, m in enumerate(marks) if m and any(p["gone"] for p in m)]
            if some:
                for r, (text, spans) in zip(some, chunks(b.column(at).take(pa.array(some)), divisor, long_words), strict=True):
                    gone = {p["place"]: p["key"] for p in marks[r] if p["gone"]}
                    stay = [text[x:y] for p, (x, y, _) in enumerate(spans) if p not in gone or _key(text[x:y]) != gone[p]]
                    n[r] = len(spans) - len(stay)
                    if n[r]:
                        new = b"\n".join(stay).decode()
                        chars[r] = len(texts[r]) - len(new)
                        texts[r] = new
            cols = list(b.columns[:columns])
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(chars, pa.int64())], names=schema.names)

    schema = documents.select("*").schema.add("_chunks_removed", "long").add("_chars_removed", "long")
    return docs.mapInArrow(shared.tidy(work), schema)


# Whole passages: beside the chunks, every shortest run of lines with ``long_words`` words.


class Lines:
    """The lines of a slice of texts, with a 64-bit hash of any run of them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.ls, self.le, self.first = T.split_lines(data, off)
        self.h = T.span_hashes(data, self.ls, self.le)
        s, _, _ = T.split_words(data, off, T.NOT_SPACE)
        self.words = np.searchsorted(s, self.le) - np.searchsorted(s, self.ls)
        p, self.inverse = T._table(len(self.h))
        self.prefix = np.zeros(len(self.h) + 1, T.U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.h * p[: len(self.h)], out=self.prefix[1:])

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.prefix[b] - self.prefix[a]) * self.inverse[a]
            return T.mix(x ^ ((b - a).astype(T.U64) * T.U64(0x9E3779B97F4A7C15))).view(np.int64)

    def bytes(self, a: int, b: int) -> bytes:
        return self.data[self.ls[a] : self.le[b - 1]].tobytes()

    def spans(self, divisor: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First lines and ends of the countable runs, which depend on the run's own lines:
        from each line the shortest with ``long_words`` words, to each line the shortest,
        and the chunks."""
        n, size = len(self.h), np.diff(self.first)
        total = np.concatenate([[0], np.cumsum(self.words)])
        i = np.arange(n)
        e = np.searchsorted(total, total[:-1] + long_words)
        s = np.searchsorted(total, total[1:] - long_words, "right") - 1
        on, to = e <= np.repeat(self.first[1:], size), s >= np.repeat(self.first[:-1], size)
        codes = [i[on] * (n + 1) + e[on], s[to] * (n + 1) + i[to] + 1]
        for a, b in zip(self.first.tolist(), self.first[1:].tolist(), strict=False):
            cuts = np.array(chunk_cuts(self.h[a:b], self.words[a:b], divisor, long_words)) + a
            x, y = cuts[:-1], cuts[1:]
            counted = (self.words[x] >= long_words) | ((y - x > 1) & (total[y] > total[x]))
            codes.append(x[counted] * (n + 1) + y[counted])
        code = np.unique(np.concatenate(codes))
        return code // (n + 1), code % (n + 1)


_AGAIN = ("place", "lines", "key", "fd", "fp")


def _slices(column):
    """Ranges of rows and their lines."""
    data, off = T.buffers(column)
    for i, j in T.slices(off):
        yield i, j, Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])


def passage_occurrences(documents: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The countable runs: key, doc_id, place (first line), lines."""

    def work(batches):
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, t in _slices(b.column(1)):
                x, y = t.spans(divisor, long_words)
                row = np.searchsorted(t.first, x, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.keys(x, y)), pa.array(docs[i + row], pa.int64()), pa.array(x - t.first[row], pa.int32()), pa.array(y - x, pa.int32())],
                    names=["key", "doc_id", "place", "lines"],
                )

    return shared.id_and_text(documents).where("doc_id is not null").mapInArrow(shared.tidy(work), "key long, doc_id long, place int, lines int")


def _runs(t: Lines, docs: np.ndarray, again):
    """The runs of lines that go from the rows of a slice: arrays of row, first line, end,
    the document and first line that stay, and the run's key.  Rows of ``again`` that
    go on in the same document at the same distance are one run."""
    off = again.offsets.to_numpy()
    v = again.values.slice(off[0], off[-1] - off[0])
    place, lines, key, fd, fp = (v.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _AGAIN)
    row = np.repeat(np.arange(len(docs)), np.diff(off))
    start = t.first[row] + place
    fits = np.flatnonzero(start + lines <= t.first[row + 1])
    fits = fits[t.keys(start[fits], start[fits] + lines[fits]) == key[fits]]  # not another row's of the same doc_id
    row, start, lines, fd, fp, place = (c[fits] for c in (row, start, lines, fd, fp, place))
    # A run that overlaps the one that stays goes without the lines that both share.
    both = np.where((fd == docs[row]) & (fp < place), np.maximum(fp + lines - place, 0), 0)
    start, end, away = start + both, start + lines, fp - place
    order = np.lexsort((start, away, fd, row))
    row, start, end, fd, away = (c[order] for c in (row, start, end, fd, away))
    if not len(row):
        return row, start, end, fd, start, start
    group = np.concatenate([[0], np.cumsum((np.diff(row) != 0) | (np.diff(fd) != 0) | (np.diff(away) != 0))])
    wide = len(t.h) + 1
    reach = np.maximum.accumulate(end + group * wide)
    new = np.flatnonzero(np.concatenate([[True], (start[1:] + group[1:] * wide > reach[:-1]) | (np.diff(group) != 0)]))
    row, start, end, fd, away = row[new], start[new], np.maximum.reduceat(end, new), fd[new], away[new]
    return row, start, end, fd, start - t.first[row] + away, t.keys(start, end)


def repeated(documents: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents in the shared folder, with a last column, ``_again`` where the table has
    none of that name: their runs that occur before, and where each occurs first."""
    occ = shared.materialize(passage_occurrences(documents, divisor, long_words), "passages")
    groups = occ.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).where("n > 1").select("key", F.col("first.doc_id").alias("fd"), F.col("first.place").alias("fp"))
    again = occ.join(groups, "key").where("doc_id <> fd or place <> fp")
    # At most the runs of one document.
    name, doc = shared.fresh(documents, "_again"), shared.fresh(documents, "_doc")
    lists = again.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct(*_AGAIN)).alias(name))
    out = shared.materialize(documents.join(lists, documents["doc_id"].cast("long") == F.col(doc), "left").drop(doc), "repeated")
    shared.remove(occ)
    return out


_RUN = "doc_id long, start int, lines int, fd long, fs int, key long"


def _run_texts(docs: DataFrame) -> DataFrame:
    """The runs that are to go, with their bytes."""

    def work(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, t in _slices(b.column(1)):
                row, start, end, fd, fs, key = _runs(t, ids[i:j], b.column(2).slice(i, j - i))
                cols = [ids[i + row], start - t.first[row], end - start, fd, fs, key]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                texts = [t.bytes(x, y) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, types, strict=True)), pa.array(texts, pa.binary())], names=["doc_id", "start", "lines", "fd", "fs", "key", "chunk"])

    d = docs.where(F.col(docs.columns[-1]).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), docs.columns[-1])
    return d.mapInArrow(shared.tidy(work), _RUN + ", chunk binary")


def _texts_asked(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes of the runs that stay: sd, ss, sn, c."""
    schema = [("sd", pa.int64()), ("ss", pa.int32()), ("sn", pa.int32()), ("c", pa.binary())]
    asked = runs.select("fd", "fs", "lines").distinct().groupBy("fd").agg(F.collect_list(F.struct("fs", "lines")).alias("asked"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(asked, F.col("doc_id") == F.col("fd")).select("doc_id", "text", "asked")

    def work(batches):
        for b in batches:
            ids, asks, rows = b.column(0).to_pylist(), b.column(2).to_pylist(), []
            for i, j, t in _slices(b.column(1)):
                for r in range(j - i):
                    a, z = int(t.first[r]), int(t.first[r + 1])
                    rows += [(ids[i + r], q["fs"], q["lines"], t.bytes(a + q["fs"], a + q["fs"] + q["lines"])) for q in asks[i + r] if a + q["fs"] + q["lines"] <= z]
            yield _batch(rows, schema)

    return d.mapInArrow(shared.tidy(work), "sd long, ss int, sn int, c binary")


def unequal_runs(docs: DataFrame) -> DataFrame:
    """Runs whose bytes differ from those of the run that stays."""
    runs = shared.materialize(_run_texts(docs), "runs")
    there = _texts_asked(docs, runs)
    same = (F.col("fd") == F.col("sd")) & (F.col("fs") == F.col("ss")) & (F.col("lines") == F.col("sn")) & (F.col("chunk") == F.col("c"))
    out = shared.materialize(runs.join(there, same, "left_anti").drop("chunk"), "unequal")
    shared.remove(runs)
    return out


def dedup_passages(documents: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """As :func:`dedup_lines`, and every repeated run of lines with ``long_words`` words
    or more goes whole, whatever stands around it.  The occurrence with the smallest
    (doc_id, first line) stays.  A run is the union of its shortest runs of so many
    words, each of which is counted; _chunks_removed counts the gaps left in the text.
    Where the table has columns of these two names, they get underscores behind them."""
    docs = repeated(documents, divisor, long_words)
    other = unequal_runs(docs)
    name, doc = shared.fresh(docs, "_stay"), shared.fresh(docs, "_doc")
    if other.isEmpty():
        docs = docs.withColumn(name, F.lit(None).cast("array<struct<start:int,lines:int,fd:bigint,fs:int,key:bigint>>"))
    else:
        lists = other.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("start", "lines", "fd", "fs", "key")).alias(name))
        docs = docs.join(lists, docs["doc_id"].cast("long") == F.col(doc), "left").drop(doc)
    at, key, columns = documents.columns.index("text"), documents.columns.index("doc_id"), len(documents.columns)

    def work(batches):
        for b in batches:
            texts, n, chars = b.column(at).to_pylist(), [0] * b.num_rows, [0] * b.num_rows
            some = b.column(columns).is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
            if len(some):
                take = pa.array(some)
                ids = b.column(key).take(take).cast(pa.int64()).to_numpy(zero_copy_only=False)
                again, stay = b.column(columns).take(take), b.column(columns + 1).take(take).to_pylist()
                for i, j, t in _slices(b.column(at).take(take)):
                    row, start, end, fd, fs, keys = _runs(t, ids[i:j], again.slice(i, j - i))
                    edge = np.zeros(len(t.h) + 1, np.int64)
                    for r, x, y, d, f, k in zip(*(c.tolist() for c in (row, start, end, fd, fs, keys)), strict=True):
                        if stay[i + r] and {"start": x - int(t.first[r]), "lines": y - x, "fd": d, "fs": f, "key": k} in stay[i + r]:
                            continue
                        edge[x] += 1
                        edge[y] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    for r in np.unique(row):
                        a, z = int(t.first[r]), int(t.first[r + 1])
                        g = np.concatenate([[True], gone[a:z], [True]])
                        turn = np.flatnonzero(g[1:] != g[:-1])  # starts and ends of what stays
                        new = b"\n".join(t.bytes(a + x, a + y) for x, y in turn.reshape(-1, 2).tolist()).decode()
                        q = int(some[i + r])
                        n[q] = int((g[1:-1] & ~np.concatenate([[False], g[1:-2]])).sum())
                        chars[q] = len(texts[q]) - len(new)
                        texts[q] = new
            cols = list(b.columns[:columns])
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(chars, pa.int64())], names=schema.names)

    schema = documents.select("*").schema.add(shared.fresh(documents, "_chunks_removed"), "long").add(shared.fresh(documents, "_chars_removed"), "long")
    return docs.mapInArrow(shared.tidy(work), schema)

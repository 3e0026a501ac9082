"""Quality rules with an isolation forest over their statistics.

A document first meets two fixed rules (too few words; more than half of the
words in repeated three-word windows).  Of those that pass, an isolation forest
tells the anomalous ones: each tree splits a small sample at random values of
random statistics, and a document that few splits set apart from the rest has a
short path.  All statistics of the rules take part.  How likely a split takes one
follows from the labelled rows: it is the square of the largest distance between the
classes' distributions of that statistic, as a statistic that varies alike in both
only lengthens and shortens paths at random.  The forest is fitted on at most
``max_fit_rows`` labelled rows (a documented bound, half of them of each class, taken
in the order of a hash of the doc_id), of which good ones and so many bad ones that
they are rare among them.  The threshold comes from the score histogram of all
labelled rows.

Defined results: null and empty text has no words and fails the base rules; a
label without a document, or with a null, is not used, nor are labels of one doc_id
that disagree; where no labelled row
remains, or only one class, only the base rules decide; repeated rows are each
judged; other columns pass through :func:`keep_good` unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as T

MAX_FIT_ROWS, BAD_SHARE, TREES, SAMPLE, BINS, SEED = 20_000, 0.05, 200, 128, 2000, 11
#: Of the good labelled rows that pass the base rules, the share that has to stay.
GOOD_KEPT = 0.995

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Symbols a word on three scales; shares of the lines with a word and of the words.
FEATURES = ["mean_chars", "symbols", "symbols_root", "symbols_log", "dup_lines", "repeat_words", "log_words"]
#: The least chance of a statistic relative to one that parts the classes wholly.
LEAST_CHANCE = 1e-4

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CHAR = (np.arange(256) & 0xC0) != 0x80


def statistics(texts) -> tuple[np.ndarray, np.ndarray]:
    """The five counts and the statistics of the forest, a row for each text."""
    data, off = T.buffers(texts)
    counts, feats = np.zeros((len(off) - 1, 5), np.int64), np.zeros((len(off) - 1, len(FEATURES)))
    for i, j in T.slices(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, first = T.split_words(d, o, T.NOT_SPACE)
        h = T.span_hashes(d, s, e)
        n = np.diff(first)
        chars = T.totals(_CHAR[d] & T.NOT_SPACE[d], o)
        symbols = T.totals(_SYMBOL[d], o)
        # Lines that have a word and equal an earlier one.
        ls, le, lfirst = T.split_lines(d, o)
        worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
        lh = T.span_hashes(d, ls, le)
        pos, wo = T.windows(first, 3)
        g = T.window_hashes(h, pos, 3)
        dup, rep = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
        for r in range(j - i):
            x = lh[lfirst[r] : lfirst[r + 1]][worded[lfirst[r] : lfirst[r + 1]]]
            dup[r] = len(x) - len(np.unique(x))
            x = g[wo[r] : wo[r + 1]]
            if len(x) > 1:
                order = np.argsort(x, kind="stable")
                same = x[order][1:] == x[order][:-1]
                if same.any():
                    twice = np.zeros(len(x), bool)
                    twice[order[1:][same]] = True
                    twice[order[:-1][same]] = True
                    cover = np.zeros(len(x) + 2, bool)
                    for t in range(3):
                        cover[t : t + len(x)] |= twice
                    rep[r] = cover.sum()
        counts[i:j] = np.stack([n, chars, symbols, dup, rep], axis=1)
        per_word = symbols / np.maximum(n, 1)
        some = np.maximum(n, 1)
        feats[i:j] = np.stack([chars / some, per_word, np.sqrt(per_word), np.log1p(100 * per_word), dup / np.maximum(T.totals(worded, lfirst), 1), rep / some, np.log1p(n)], axis=1)
    return counts, feats


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _usual_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays of nodes; scores are 2 ** (-mean path / usual path)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, chances: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        deepest = max(1, math.ceil(math.log2(max(sample, 2))))
        self.usual = float(_usual_path(sample)) or 1.0
        chances = np.ones(x.shape[1]) if chances is None else chances
        self.trees = [self._grow(x[rng.choice(len(x), sample, replace=False)], deepest, rng, chances) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, deepest: int, rng, chances: np.ndarray) -> tuple[np.ndarray, ...]:
        feature, cut, left, value = [], [], [], []

        def node() -> int:
            for column, v in ((feature, -1), (cut, 0.0), (left, 0), (value, 0.0)):
                column.append(v)
            return len(feature) - 1

        todo = [(node(), x, 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            can = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) < 2 or not len(can):
                value[at] = depth + float(_usual_path(len(rows)))
                continue
            f = int(rng.choice(can, p=chances[can] / chances[can].sum()))
            c = float(rng.uniform(low[f], high[f]))
            feature[at], cut[at] = f, c
            a, b = node(), node()
            left[at] = a
            todo += [(a, rows[rows[:, f] < c], depth + 1), (b, rows[rows[:, f] >= c], depth + 1)]
        return np.array(feature), np.array(cut), np.array(left), np.array(value)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (go := feature[at] >= 0).any():
                rows = every[go]
                a = at[rows]
                at[rows] = left[a] + (x[rows, feature[a]] >= cut[a])
            total += value[at]
        return 2.0 ** (-total / len(self.trees) / self.usual)


class Model:
    """A fitted forest and its threshold; documents of a higher score go."""

    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def verdict(self, counts: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.zeros(len(feats))
        passed = ~base_failed(counts)
        if self.forest is not None and passed.any():
            score[passed] = self.forest.score(feats[passed])
        return passed & (score <= self.threshold), score


def separation(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The largest distance between the two distributions of each statistic, squared."""
    out = np.zeros(good.shape[1])
    for c in range(len(out)):
        g, b = np.sort(good[:, c]), np.sort(bad[:, c])
        at = np.concatenate([g, b])
        out[c] = np.abs(np.searchsorted(g, at, "right") / len(g) - np.searchsorted(b, at, "right") / len(b)).max()
    return np.maximum(out**2, LEAST_CHANCE)


def measured(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the five counts and x, the forest's statistics; no text."""

    def work(batches):
        for b in batches:
            counts, feats = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, c], pa.int64()) for c in range(5)), pa.array(list(feats), pa.list_(pa.float64()))], names=["doc_id", *COUNTS, "x"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>"
    return shared.id_and_text(documents).mapInArrow(shared.tidy(work), schema)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, x) of the labelled documents that pass the base rules; of rows
    that share a doc_id, one."""
    good = (F.col("quality").cast("long") > 0).cast("long")
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), good.alias("quality")).where("_id is not null and quality is not null")
    lab = lab.groupBy("_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    passed = rows.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").select("doc_id", "x")
    return passed.join(lab, passed["doc_id"] == lab["_id"]).groupBy("doc_id", "quality").agg(F.min("x").alias("x"))


def _sample(rows: DataFrame, n: int, most: int) -> list[list[float]]:
    """The statistics of the ``most`` of ``n`` rows with the smallest hashes.  Rows that are
    surely too many stay where they are, so that the driver gets about as many as it needs."""
    h = F.xxhash64("doc_id")
    share = (most + 6 * math.sqrt(most) + 10) / max(n, 1)
    if share < 1:
        rows = rows.where(h < int(share * 2**64) - 2**63)
    found = sorted(rows.select(h.alias("h"), "doc_id", "x").collect(), key=lambda r: (r["h"], r["doc_id"]))
    return [r["x"] for r in found[:most]]


def fit(rows: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, good_kept: float = GOOD_KEPT, trees: int = TREES, sample: int = SAMPLE) -> Model:
    """Forest from a bounded sample of the labelled of the ``measured`` rows, threshold from all of them."""
    rows = shared.materialize(_labelled(rows, labels), "labelled")
    n_good, n_bad = rows.agg(F.count(F.when(F.col("quality") > 0, 1)), F.count(F.when(F.col("quality") <= 0, 1))).first()
    good = np.array(_sample(rows.where("quality > 0"), n_good, max_fit_rows // 2))
    bad = np.array(_sample(rows.where("quality <= 0"), n_bad, max_fit_rows // 2))
    if not len(good) or not len(bad) or len(good) + len(bad) < 8:
        return Model(None, 1.0)
    few = bad[: max(4, int(BAD_SHARE * len(good)))]
    forest = IsolationForest(np.concatenate([good, few]), trees, sample, chances=separation(good, bad))
    held = rows.sparkSession.sparkContext.broadcast(forest)

    def bins(batches):
        total = np.zeros((2, BINS + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist())
                at = np.ceil(held.value.score(x) * BINS).astype(int)
                np.add.at(total, ((b.column(0).to_numpy() > 0).astype(int), at), 1)
        q, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(at, pa.int64()), pa.array(total[q, at], pa.int64())], names=["good", "bin", "n"])

    counts = np.zeros((2, BINS + 1), np.int64)
    for r in rows.select("quality", "x").mapInArrow(shared.tidy(bins), "good long, bin long, n long").groupBy("good", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["good"], r["bin"]] = r["n"]
    return Model(forest, threshold(counts, good_kept))


def threshold(counts: np.ndarray, good_kept: float) -> float:
    """The score bin that best parts the classes and keeps ``good_kept`` of the good rows."""
    below = counts.cumsum(axis=1)
    bad, good = below[:, -1]
    if not bad or not good:
        return 1.0
    right = np.where(below[1] >= good_kept * good, below[1] / good + (bad - below[0]) / bad, -1.0)
    best = np.flatnonzero(right == right.max())
    return float(best[len(best) // 2]) / BINS


def judge(rows: DataFrame, model: Model) -> DataFrame:
    """Per ``measured`` row: doc_id, the five counts, base_failed, kept, score."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            if b.num_rows:
                counts = np.stack([b.column(c).to_numpy() for c in COUNTS], axis=1)
                feats = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                kept, score = held.value.verdict(counts, feats)
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(base_failed(counts)), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return rows.select("doc_id", *COUNTS, "x").mapInArrow(shared.tidy(work), schema)


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of the documents that are kept, with all their columns."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def work(batches):
        for b in batches:
            yield b.filter(pa.array(held.value.verdict(*statistics(b.column(at)))[0]))

    return shared.bounded(documents).mapInArrow(shared.tidy(work), documents.schema)

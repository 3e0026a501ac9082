"""Near-duplicate documents by HyperMinHash.

A document is the set of its word shingles.  Each 64-bit shingle hash falls in
one of ``m`` buckets by its leading bits; of the smallest rest in a bucket the
register keeps the number of leading zeros and some mantissa bits after them.
Documents with identical sets are folded into one node first, numbered as written.  Registers of the
others, with empty buckets filled from other buckets by a fixed random order,
are cut into bands; documents that share a band meet that band's member with
the smallest id.  The Jaccard similarity of such a pair is estimated from the
registers, corrected for chance collisions of registers; pairs that can be close
are then confirmed on the full shingle sets.

What is kept of a pair is its exact difference: the shingles that one has and the
other lacks.  Members that met the same hub are compared through it,

    |A & B| = |H| - |(H - A) | (H - B)| + |(A - H) & (B - H)|,

which is exact and needs the differences only, so that members of different
components are confirmed against each other without their texts and only links
leave the task.  A band is done once all its members have met one hub.  Until then
those that are not close to the hub get further hubs among themselves; what is left
after ``rounds`` of them meets one more, whatever the registers say.  So no pair that
shares a band is lost, and no pair but that of a member and a hub of its band is
ever a row: the rows that a large group makes stay in proportion to its size.

Sets so small that one further shingle brings the similarity under the threshold
link with equal sets only and need no bands.  From 0.85 on there are 25 bands of
5 registers, below that 32 of 4; of pairs at exactly 0.85 or 0.8 they miss fewer
than one in a million.

Defined results: null, empty and wordless text has an empty set, links with
nothing and is kept; a text of fewer words than a shingle has one shingle; rows
that share a doc_id are one document, which links with all that any of them links with,
and all get its result; a null doc_id
links with nothing and is kept, with a null component; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as T
from .components import components
from .members import near_set

M, MANTISSA = 128, 10
BLOCK, ROUNDS = 1024, 4
#: Differences that a block holds on each side.
BLOCK_BYTES = 32 << 20
#: Parts that the rows of a group of more than a block are dealt in.
SALTS = 32
#: Pairs of at least this similarity keep their difference.  A member that is closer to
#: its hub by the distance of a link cannot link with one that is further off than this.
CLOSE = 0.45

SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest binary, registers binary"


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = T.buffers(texts)
    out: list[np.ndarray] = []
    for i, j in T.slices(off):
        d = T.LOWER[data[off[i] : off[j]]]
        s, e, first = T.split_words(d, off[i : j + 1] - off[i], T.NOT_SPACE)
        h = T.span_hashes(d, s, e)
        pos, wo = T.windows(first, k)
        g = T.window_hashes(h, pos, k)
        n = np.diff(first)
        for r in range(j - i):
            if n[r] >= k:
                out.append(np.unique(g[wo[r] : wo[r + 1]]))
            elif n[r]:
                out.append(T.window_hashes(h, first[r : r + 1], int(n[r])))
            else:
                out.append(np.empty(0, T.U64))
    return out


def registers(hashes: np.ndarray, m: int = M, mantissa: int = MANTISSA) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes; 0 is an empty bucket."""
    bits = m.bit_length() - 1
    at = np.searchsorted(hashes, np.arange(m, dtype=T.U64) << T.U64(64 - bits))
    out = np.zeros(m, np.uint16)
    some = at < len(hashes)
    x = hashes[at[some]]
    some[some] = (x >> T.U64(64 - bits)) == np.flatnonzero(some).astype(T.U64)
    rest = (hashes[at[some]] << T.U64(bits)) | T.U64((1 << bits) - 1)
    top = np.frexp((rest >> T.U64(11)).astype(np.float64))[1]  # bit length of the upper 53 bits
    zeros = np.minimum(53 - top, 62)
    after = rest << (zeros + 1).astype(T.U64)
    out[some] = ((zeros + 1).astype(np.uint16) << mantissa) | (after >> T.U64(64 - mantissa)).astype(np.uint16)
    return out


_tries: dict[int, np.ndarray] = {}


def densify(reg: np.ndarray) -> np.ndarray:
    """Rows of registers with each empty bucket filled from a bucket that a fixed
    random sequence of its own reaches first."""
    m = reg.shape[1]
    if m not in _tries:
        _tries[m] = np.random.default_rng(7 * m).integers(0, m, (4000, m))
    out = reg.copy()
    rows = np.flatnonzero((reg == 0).any(axis=1) & (reg != 0).any(axis=1))
    for seq in _tries[m]:
        if not len(rows):
            return out
        sub = out[rows]
        out[rows] = np.where(sub == 0, reg[rows][:, seq], sub)
        rows = rows[(out[rows] == 0).any(axis=1)]
    for r in rows:  # after 4000 tries: the next filled bucket
        full = np.flatnonzero(reg[r])
        for j in np.flatnonzero(out[r] == 0):
            out[r, j] = reg[r, full[np.searchsorted(full, j) % len(full)]]
    return out


def band_keys(reg: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bands = reg.shape[1] // rows
    full = densify(reg)[:, : bands * rows].reshape(len(reg), bands, rows).astype(T.U64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to((np.arange(bands, dtype=T.U64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15), full.shape[:2]).copy()
        for i in range(rows):
            acc = T.mix(acc + full[:, :, i] * T.U64(0xC2B2AE3D27D4EB4F))
    return acc.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of paired rows, and how many buckets they rest on."""
    some = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    chance = 0.169919487159739 / 2**mantissa  # of unequal minima, per bucket
    j = same / np.maximum(some, 1)
    return np.clip((j - chance) / (1 - chance), 0, 1), some


def may_reach(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the estimate is within five standard errors of the similarity, or above."""
    j, n = estimate(a, b)
    return j >= similarity - 5 * np.sqrt(similarity * (1 - similarity) / np.maximum(n, 1))


def signatures(documents: DataFrame, k: int, percent: int) -> DataFrame:
    def work(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) * (100 - percent) >= percent else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "registers"],
            )

    return shared.id_and_text(documents).withColumn("text_hash", F.xxhash64("text")).mapInArrow(shared.tidy(work), SIGNATURE)


def _reg(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


COMPARED = "a long, b long, na long, both long, minus binary, plus binary"


def candidate_texts(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """A table in the shared folder: node and the compressed text of each node of the pairs.
    A node's text is told by the doc_id and the hash of the text that it was first met with."""

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [pack.compress(t.as_buffer()) for t in part.column(1).cast(pa.large_string()).fill_null("")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(texts, pa.binary())], names=["rep", "rep_text", "text"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep", "rep_text"), "node")
    asked = shared.materialize(asked.withColumn("pair", F.xxhash64("rep", "rep_text")), "asked")
    rows = docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text")).withColumn("pair", F.xxhash64("doc_id", "text_hash"))
    some = near_set(rows, "pair", asked, "pair", squeeze, "rep long, rep_text long, text binary")
    out = shared.materialize(some.join(asked.select("node", "rep", "rep_text"), ["rep", "rep_text"]).select("node", "text").dropDuplicates(["node"]), "texts")
    shared.remove(asked)
    return out


def _unpacked(column) -> pa.Array:
    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(x) for x in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """A table in the shared folder: the pairs with the size of a's set, of the intersection,
    and their differences a - b and b - a on full sets."""

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                x, y = shingle_sets(_unpacked(part.column(2)), k), shingle_sets(_unpacked(part.column(3)), k)
                minus, plus = [], []
                for p, q in zip(x, y, strict=True):
                    minus.append(np.setdiff1d(p, q, assume_unique=True))
                    plus.append(np.setdiff1d(q, p, assume_unique=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(p) for p in x], pa.int64()), pa.array([len(p) - len(m) for p, m in zip(x, minus, strict=True)], pa.int64()),
                        pa.array([m.tobytes() for m in minus], pa.binary()), pa.array([q.tobytes() for q in plus], pa.binary()),
                    ],
                    names=["a", "b", "na", "both", "minus", "plus"],
                )

    texts = candidate_texts(docs, pairs, nodes)
    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    out = shared.materialize(full.select("a", "b", "ta", "tb").mapInArrow(shared.tidy(work), COMPARED), "compared")
    shared.remove(texts)
    return out


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the registers do not rule out."""

    def work(batches):
        for b in batches:
            if b.num_rows:
                yield b.select([0, 1]).filter(pa.array(may_reach(_reg(b.column(2)), _reg(b.column(3)), threshold)))

    r = reps.select(F.col("rep"), F.col("registers"))
    full = pairs.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b")
    return full.select("a", "b", "ra", "rb").mapInArrow(shared.tidy(work), "a long, b long")


class _Group:
    """Members of one hub in one block, and the counts that pairs of them share."""

    def __init__(self, minus: list[np.ndarray], plus: list[np.ndarray]):
        self.n = len(minus)
        self.sizes = [np.array([len(x) for x in v]) for v in (minus, plus)]
        self.index = []
        for v in (minus, plus):
            owner = np.repeat(np.arange(self.n), [len(x) for x in v])
            values = np.concatenate([*v, np.empty(0, T.U64)])
            order = np.argsort(values, kind="stable")
            self.index.append((values[order], owner[order]))

    def shared(self, which: int, values: np.ndarray) -> np.ndarray:
        keys, owner = self.index[which]
        lo, hi = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=self.n)

    def both(self, hub: int, minus: np.ndarray, plus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the intersections and unions with all members of the block."""
        gone = self.sizes[0] + len(minus) - self.shared(0, minus)
        both = hub - gone + self.shared(1, plus)
        sizes = hub - self.sizes[0] + self.sizes[1]
        return both, sizes + hub - len(minus) + len(plus) - both


def _hashes(column) -> list[np.ndarray]:
    return [np.frombuffer(x, T.U64) for x in column.to_pylist()]


def _through_hub(percent: int):
    def work(table: pa.Table) -> pa.Table:
        """Links between the left members of a block and its right ones in other components,
        one for each pair of components."""
        role, rep, comp, na = (table.column(c).to_numpy() for c in ("role", "b", "component", "na"))
        minus, plus = _hashes(table.column("minus")), _hashes(table.column("plus"))
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(left) and len(right):
            group = _Group([minus[i] for i in right], [plus[i] for i in right])
            for i in left:
                both, either = group.both(int(na[i]), minus[i], plus[i])
                for j in right[(100 * both >= percent * either) & (comp[right] != comp[i])]:
                    found.setdefault((min(comp[i], comp[j]), max(comp[i], comp[j])), (rep[i], rep[j]))
        return pa.table([pa.array([p[0] for p in found.values()], pa.int64()), pa.array([p[1] for p in found.values()], pa.int64())], names=["a", "b"])

    return work


def in_blocks(rows: DataFrame, group: str, left: DataFrame, work, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """Every left row of a group against all its rows, in blocks of about ``block`` rows,
    or of fewer where their ``size`` in bytes is above ``BLOCK_BYTES``.
    A group of one block needs no numbers; the rows of larger ones are dealt by ``salt``, so
    that neither the numbers nor the blocks of a group come together in one task."""
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.lit(0) if size is None else size) / BLOCK_BYTES))
    count = lambda df, name: df.groupBy(group).agg(blocks.alias(name))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    large = count(rows, "nj").join(count(left, "ni"), group, "left").withColumn("ni", F.coalesce("ni", F.lit(1).cast("long"))).where("ni > 1 or nj > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    def numbered(df: DataFrame) -> DataFrame:
        one = F.lit(1).cast("long")
        dealt = df.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS).cast("long"))).join(large, [group, "salt"], "left")
        return dealt.withColumn("ni", F.coalesce("ni", one)).withColumn("nj", F.coalesce("nj", one)).withColumn("at", F.xxhash64("b", F.lit(1)))

    a = numbered(left).withColumn("i", F.pmod("at", "ni")).withColumn("j", every("nj")).withColumn("role", F.lit(0))
    b = numbered(rows).withColumn("j", F.pmod("at", "nj")).withColumn("i", every("ni")).withColumn("role", F.lit(1))
    cols = [*rows.columns, "i", "j", "role"]
    return a.select(cols).unionByName(b.select(cols)).groupBy(group, "i", "j").applyInArrow(work, "a long, b long")


def through_hubs(met: DataFrame, comps: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between members of the same hub in different components.  The members
    outside the hub's largest component are compared with all of them."""
    of = comps.select(F.col("node").alias("b"), "component")
    hubs = met.select("a", F.col("a").alias("b"), "na", F.lit(b"").alias("minus"), F.lit(b"").alias("plus")).dropDuplicates(["a"])
    m = met.select("a", "b", "na", "minus", "plus").unionByName(hubs).join(of, "b", "left").withColumn("component", F.coalesce("component", "b"))
    by = m.groupBy("a", "component").agg(F.count("*").alias("n"))
    main = by.groupBy("a").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    m = shared.materialize(m.join(main.select("a", "main"), "a").select("a", "b", "na", "minus", "plus", "component", "main"), "hub_members")
    rows = m.drop("main")
    out = shared.materialize(in_blocks(rows, "a", m.where("component <> main").drop("main"), _through_hub(percent), block, F.octet_length("minus") + F.octet_length("plus")).distinct(), "hub_links")
    shared.remove(m)
    return out


def links(documents: DataFrame, k: int = 5, percent: int = 80, rounds: int = ROUNDS):
    """Signatures, rows with the nodes of their sets, the nodes, links and components of nodes."""
    threshold = percent / 100
    close = min(CLOSE, threshold)
    docs = shared.id_and_text(documents)
    sig = shared.materialize(signatures(docs, k, percent), "signatures")
    named = sig.where("doc_id is not null and digest is not null")
    firsts = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    nodes = shared.materialize(firsts.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_text"), F.monotonically_increasing_id().alias("node")), "nodes")
    rows = shared.materialize(named.select("doc_id", "n_shingles", "digest").join(nodes.select("digest", "node", "rep"), "digest").drop("digest"), "rows")
    # Different texts of one doc_id are one document.
    several = rows.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    same_id = rows.join(several, "doc_id").where("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    first = (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_text")) & (F.col("digest") == F.col("d"))
    reps = shared.materialize(
        named.where("registers is not null").select("doc_id", "text_hash", "digest", "registers").join(nodes.withColumnRenamed("digest", "d"), first).select(F.col("node").alias("rep"), "registers").dropDuplicates(["rep"]),
        "representatives",
    )

    def bands(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(_reg(b.column(1)), 5 if percent >= 85 else 4)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]), pa.int64())], names=["key", "rep"])

    keyed = reps.mapInArrow(shared.tidy(bands), "key long, rep long").withColumn("unmet", F.lit(True))
    met, tables, links_ = None, [], F.col("both") * 100 >= percent * (F.col("na") + F.octet_length("plus") / 8)
    for n in range(rounds + 1):
        # A band whose members have all met one hub is done: they are compared through it.
        hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n"), F.bool_or("unmet").alias("open")).where("n > 1 and open").select("key", "hub")
        members = shared.materialize(keyed.join(hubs, "key").where("rep <> hub").select("key", "rep", "hub"), "members")
        shared.remove(keyed)
        pairs = members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        if met is not None:
            pairs = pairs.join(met.select("a", "b"), ["a", "b"], "left_anti")
        pairs = shared.materialize(estimated(pairs, reps, close) if n < rounds else pairs, "candidates")
        if n == 0 or not pairs.isEmpty():
            tables.append(compared(pairs, docs, nodes, k))
            met = tables[0] if met is None else met.unionByName(tables[-1])
        # Close to its hub by more than the distance of a link: settled in this band.
        settled = F.col("both") >= (close + 1 - threshold) * (F.col("na") + F.octet_length("plus") / 8)
        state = members.join(met.select(F.col("a").alias("hub"), F.col("b").alias("rep"), settled.alias("settled")), ["hub", "rep"], "left")
        keyed = shared.materialize(state.where("settled is null or not settled").select("key", "rep", F.col("settled").isNull().alias("unmet")), "unsettled")
        shared.remove(pairs)
        shared.remove(members)
        if keyed.where("unmet").isEmpty():
            break
    edges = shared.materialize(met.where(links_).select("a", "b").unionByName(same_id), "links")
    comps = components(edges)
    found = through_hubs(met, comps, percent)
    if not found.isEmpty():
        edges = edges.unionByName(found)
        comps = components(edges)
    for t in (*tables, reps, keyed):
        shared.remove(t)
    return sig, rows, nodes, edges, comps


def deduplicate(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach), kept (it is that document)."""
    sig, rows, nodes, _, comps = links(documents, k, percent)
    smallest = comps.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of = comps.join(smallest, "component").select("node", "component_id")
    linked = rows.join(of, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    alone = sig.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""The thin query of each operator over the tables of a folder, and its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, linededup, neardup, packing, quality, secrets, shared, tokenstore, warc, wordpieces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenstore.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenstore.read(spark, store)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.materialize(quality.measured(_table(spark, sf_dir, "documents")), "measured")
    return quality.judge(rows, quality.fit(rows, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.fit())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_chunks_removed").alias("chunks_removed"), F.col("_chars_removed").alias("chars_removed"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_ids, op2_quality_rules, op3_token_counts, op4_best_fit_packing, op5_warc, op6_decontaminate, op7_secret_scan, op8_line_dedup, op9_minhash_near_dedup, op10_html_extract)}


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""

_WORDS6 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS6} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dp AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
dw AS (SELECT doc_id, size, i, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win FROM dp),
h AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM h)),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_WORDS9 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP9_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS9} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.both >= 85 * (na.n + nb.n - x.both)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op6_decontaminate": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL}

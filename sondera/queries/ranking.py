"""Queries of hits: sorting, paging, scores, highlights, value streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mapping import Index
from ..operators import export, search, termstats
from ..plans import dsl
from .. import api, scratch
from .base import DOCUMENTS, D, ORDERS, index, query, table

_O = ("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def topk_one_key(spark, sf_dir):
    return search.top(index(spark, sf_dir, "orders"), search.Request(max_hits=10, sort=search.parse_sort("o_totalprice"))).select(*_O)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey ASC, o_totalprice DESC, o_orderkey ASC LIMIT 25")
def topk_two_keys(spark, sf_dir):
    return search.top(index(spark, sf_dir, "orders"), search.Request(max_hits=25, sort=search.parse_sort("-o_custkey,+o_totalprice"))).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 490000 THEN o_totalprice END AS price FROM orders) ORDER BY price ASC NULLS LAST, o_orderkey ASC LIMIT 1000")
def topk_nulls_last(spark, sf_dir):
    """Most orders have no value; they follow those that have one."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 490000), F.col("o_totalprice")).alias("price"))
    return search.top(Index(df), search.Request(max_hits=1000, sort=[("price", False)]))


@query("SELECT event_id, user_id FROM events ORDER BY user_id DESC, event_id DESC LIMIT 40")
def topk_tiebreak(spark, sf_dir):
    return search.top(index(spark, sf_dir, "events"), search.Request(max_hits=40, sort=[("user_id", True)])).select("event_id", "user_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20")
def topk_unsorted(spark, sf_dir):
    return search.top(index(spark, sf_dir, "events"), search.Request()).select("event_id")


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 30")
def page_offset(spark, sf_dir):
    got = search.top(index(spark, sf_dir, "events"), search.Request("event_type:error", max_hits=10, start_offset=30, sort=[("ts", True)]))
    return got.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey < 100) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15")
def search_after(spark, sf_dir):
    r = search.Request(max_hits=15, sort=[("o_totalprice", True)], search_after=[200000.0, 100])
    return search.top(index(spark, sf_dir, "orders"), r).select(*_O)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100 OFFSET 100")
def scroll_page2(spark, sf_dir):
    s = search.Scroll(index(spark, sf_dir, "orders"), search.Request(max_hits=100, sort=[("o_totalprice", True)]), scratch.folder(spark, "scroll"))
    s.next()
    return s.next().select(*_O)


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def late_fetch(spark, sf_dir):
    """Ids are ranked first; the documents of the page are joined to them."""
    r = search.Request(max_hits=10, sort=[("o_totalprice", True)])
    return search.late(index(spark, sf_dir, "orders"), r).select("o_orderkey", "o_custkey", "o_orderpriority")


_BM25 = (
    D + ", s AS (SELECT count(*) AS n, avg(len(tok)) AS mean FROM d), t AS (SELECT unnest(['apache', 'license']) AS term), "
    "f AS (SELECT t.term, count(*) AS df FROM t JOIN d ON list_contains(d.tok, t.term) GROUP BY t.term), "
    "x AS (SELECT d.doc_id, ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * 2.2 * len(list_filter(d.tok, lambda w: w = f.term)) / (len(list_filter(d.tok, lambda w: w = f.term)) + 1.2 * (0.25 + 0.75 * len(d.tok) / s.mean)) AS part FROM d, f, s WHERE list_contains(d.tok, f.term)) "
    "SELECT doc_id, round(sum(part), 6) AS score FROM x GROUP BY doc_id ORDER BY score DESC, doc_id DESC LIMIT 20"
)


@query(_BM25)
def bm25_topk(spark, sf_dir):
    ix = index(spark, sf_dir, "documents")
    r = search.Request(dsl.parse({"match": {"text": "apache license"}}), max_hits=20, sort=[("_score", True)])
    return search.top(ix, r).select("doc_id", F.round("_score", 6).alias("score"))


@query(_BM25)
def bm25_topk_from_statistics(spark, sf_dir):
    """As ``bm25_topk``, with the frequencies looked up in a table written before."""
    ix = index(spark, sf_dir, "documents")
    ix.stats = termstats.collect(ix, ["text"], scratch.folder(spark, "terms"))
    r = search.Request(dsl.parse({"match": {"text": "apache license"}}), max_hits=20, sort=[("_score", True)])
    return search.top(ix, r).select("doc_id", F.round("_score", 6).alias("score"))


@query()
def snippet_highlight(spark, sf_dir):
    r = search.Request("text:apache", max_hits=10, snippet_fields=["text"], sort=[("n_chars", True)])
    return search.snippets(index(spark, sf_dir, "documents"), r)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND value > 100")
def hits_json(spark, sf_dir):
    """Hits written as JSON, and read back from it."""
    ix = index(spark, sf_dir, "events")
    got = export.hits_json(ix, search.matching(ix, search.Request("event_type:signup AND value:>100")))
    return got.select(*[F.get_json_object("json", f"$.{c}").cast("long").alias(c) for c in ("event_id", "user_id")])


@query("SELECT user_id FROM events WHERE event_type = 'purchase'")
def stream_field(spark, sf_dir):
    return export.stream(index(spark, sf_dir, "events"), search.Request("event_type:purchase"), "user_id")


@query("SELECT user_id AS part, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def stream_partitioned(spark, sf_dir):
    s = export.stream(index(spark, sf_dir, "events"), search.Request("event_type:purchase"), "event_id", "user_id")
    v = export.partitioned(s, "event_id")
    return v.select(F.col("_partition").alias("part"), F.size("values").cast("long").alias("n"), F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"))


@query("SELECT CAST(8 * count(*) AS BIGINT) AS bytes FROM events WHERE event_type = 'purchase'")
def stream_row_binary(spark, sf_dir):
    s = export.stream(index(spark, sf_dir, "events"), search.Request("event_type:purchase"), "event_id")
    return export.row_binary(s).agg(F.sum(F.octet_length("bytes")).alias("bytes"))


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000)")
def olap_semi_join(spark, sf_dir):
    """Ids that a search streams, as a semi join of another table."""
    ids = export.stream(Index(table(spark, sf_dir, "orders"), ORDERS), search.Request("o_orderpriority:1-URGENT AND o_totalprice:>250000"), "o_orderkey")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(ids, lines["l_orderkey"] == ids["o_orderkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query(D + "SELECT doc_id FROM d WHERE list_contains(tok, 'apache') AND lang = 'en' ORDER BY n_chars ASC, doc_id ASC LIMIT 5")
def topk_text_query(spark, sf_dir):
    ix = Index(table(spark, sf_dir, "documents"), DOCUMENTS, "documents")
    return search.top(ix, search.Request("apache AND lang:en", max_hits=5, sort=[("n_chars", False)])).select("doc_id")


@query("SELECT page, o_orderkey FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1) // 50 AS INTEGER) AS page FROM orders WHERE o_totalprice >= 480000) WHERE page < 3")
def es_scroll(spark, sf_dir):
    """The first three pages of a scroll."""
    ix = index(spark, sf_dir, "orders")
    scrolls = api.Scrolls(scratch.folder(spark, "scrolls"))
    page = scrolls.begin(ix, {"query": {"range": {"o_totalprice": {"gte": 480000}}}, "size": 50, "sort": [{"o_totalprice": "desc"}]}, {"scroll": "1m"})
    rows = []
    for k in range(3):
        rows += [(k, int(h["_id"])) for h in page["hits"]["hits"]]
        page = scrolls.next(page["_scroll_id"])
    return spark.createDataFrame(rows, "page int, o_orderkey long")

"""The calls of the search interfaces, native and JSON, as functions on indexes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError
from .functions import literals
from .mapping import Index
from .operators import aggs as aggregations
from .operators import export, meta, search
from .plans import dsl, lang

_BODY = {"query", "from", "size", "sort", "aggs", "aggregations", "track_total_hits", "stored_fields", "search_after", "_source", "timeout"}
MOST_AT_ONCE = 10


def native(index: Index, params: dict) -> dict:
    """The native search: parameters to a count, hits, snippets and aggregations."""
    known = {"query", "search_field", "snippet_fields", "start_timestamp", "end_timestamp", "max_hits", "start_offset", "sort_by", "sort_by_field", "aggs", "format", "count_all"}
    if unknown := set(params) - known:
        raise QueryError(f"search does not know {sorted(unknown)}")
    split = lambda v: [x.strip() for x in v.split(",")] if isinstance(v, str) else list(v or [])
    r = search.Request(
        params.get("query", "*"), params.get("start_timestamp"), params.get("end_timestamp"), params.get("max_hits", 20), params.get("start_offset", 0),
        search.parse_sort(params.get("sort_by") or params.get("sort_by_field") or ""), aggs=params.get("aggs"), snippet_fields=split(params.get("snippet_fields")), search_fields=split(params.get("search_field")),
    )
    return run(index, r)


def run(index: Index, r: search.Request) -> dict:
    """Count, hits and aggregations.  Only the columns that aggregations read are held
    between their actions; the hits are ranked in a scan of their own."""
    matching = search.matching(index, r)
    slim = None
    if r.aggs:
        names = sorted({index.column_of(f) for f in aggregations.fields(r.aggs)})
        slim = matching.select(*[F.col(f"`{n}`") for n in names]).persist()
    try:
        out: dict[str, Any] = {"num_hits": (matching if slim is None else slim).count() if r.count_all else None, "hits": []}
        if r.max_hits:
            hits = search.top(index, r)
            out["hits"] = [x["json"] for x in export.hits_json(index, hits).collect()]
            if r.snippet_fields:
                out["snippets"] = [x.asDict() for x in search.snippets(index, r, hits).collect()]
        if slim is not None:
            out["aggregations"] = aggregations.run(index.with_df(slim), slim, r.aggs)
        return out
    finally:
        if slim is not None:
            slim.unpersist()


def request_of(index: Index, body: dict | None = None, params: dict | None = None) -> search.Request:
    """A JSON search body with its URL parameters."""
    body, params = body or {}, params or {}
    if unknown := set(body) - _BODY:
        raise QueryError(f"a search body does not know {sorted(unknown)}")
    if "q" in params:
        query = lang.parse(params["q"], index.mapping.default_fields, params.get("default_operator", "or").lower())
    else:
        query = dsl.parse(body.get("query", {"match_all": {}}), index.mapping.default_fields)
    sort = params.get("sort") or body.get("sort") or []
    if isinstance(sort, str):
        sort = sort.split(",")
    return search.Request(query, max_hits=int(params.get("size", body.get("size", 10))), start_offset=int(params.get("from", body.get("from", 0))), sort=search.parse_es_sort(sort) if sort else [], search_after=body.get("search_after"), count_all=params.get("track_total_hits", body.get("track_total_hits", True)) not in (False, "false"), aggs=body.get("aggs") or body.get("aggregations"))


def es_search(index: Index, body: dict | None = None, params: dict | None = None) -> dict:
    """A JSON search to a JSON answer; every hit carries its sort values."""
    r = request_of(index, body, params)
    got = run(index, search.Request(**{**r.__dict__, "max_hits": 0}))
    hits = _hits(index, search.top(index, r), r) if r.max_hits else []
    # A total that was not asked for is not counted.
    total = {"value": got["num_hits"], "relation": "eq"} if r.count_all else {"value": r.start_offset + len(hits), "relation": "gte"}
    out = {"took": 0, "timed_out": False, "hits": {"total": total, "max_score": None, "hits": hits}}
    if "aggregations" in got:
        out["aggregations"] = got["aggregations"]
    return out


def _hits(index: Index, top: DataFrame, r: search.Request) -> list[dict]:
    """The hits of a page with their sort values."""
    names = [n for n, _ in r.sort]
    keys = [search._key(index, n).alias(f"_sort{i}") for i, n in enumerate(names)]
    rows = top.select(F.to_json(F.struct(*export.output(index.with_df(top)))).alias("json"), F.col(index.id).alias("_hit"), *[_sort_value(index, n, k).alias(f"_sort{i}") for i, (n, k) in enumerate(zip(names, keys, strict=True))])
    hits = []
    for x in rows.collect():
        hit = {"_index": index.name, "_id": str(x["_hit"]), "_source": x["json"]}
        if names:
            hit["sort"] = [x[f"_sort{i}"] for i in range(len(names))] + [x["_hit"]]
        hits.append(hit)
    return hits


class Scrolls:
    """Open scrolls by id.  The ranked documents of each lie in ``folder``."""

    def __init__(self, folder: str):
        self.folder, self._open = folder, {}

    def begin(self, index: Index, body: dict | None = None, params: dict | None = None) -> dict:
        """The first page of a search with ``scroll`` (how long it lives) among its parameters."""
        params = dict(params or {})
        ttl = literals.human_duration_ms(params.pop("scroll", "5m"))
        r = request_of(index, body, params)
        if r.start_offset:
            raise QueryError("a scroll begins with the first hit")
        s = search.Scroll(index, r, self.folder, ttl)
        self._open[s.id] = (s, index, r, search.count(index, r).first()["count"])
        return self.next(s.id)

    def next(self, scroll_id: str) -> dict:
        """The page that follows; without hits behind the last one."""
        if scroll_id not in self._open:
            raise QueryError(f"there is no scroll {scroll_id!r}")
        s, index, r, total = self._open[scroll_id]
        try:
            page = s.next()
        except QueryError:
            self.end(scroll_id)
            raise
        return {"_scroll_id": scroll_id, "timed_out": False, "hits": {"total": {"value": total, "relation": "eq"}, "max_score": None, "hits": _hits(index, page, r)}}

    def end(self, scroll_id: str) -> None:
        self._open.pop(scroll_id, None)


def _sort_value(index: Index, name: str, key):
    if name in ("_score", "_doc", "_shard_doc"):
        return key
    return F.unix_millis(key.cast("timestamp")) if index.resolve(name).field.kind == "datetime" else key


def es_count(index: Index, body: dict | None = None, params: dict | None = None) -> int:
    return search.count(index, request_of(index, body, params)).first()["count"]


def msearch(indexes: dict[str, Index], lines: list[tuple[dict, dict]]) -> list[dict]:
    """Several searches at once, at most ten at a time; each fails for itself."""
    def one(pair: tuple[dict, dict]) -> dict:
        head, body = pair
        try:
            names = head.get("index")
            if not names:
                raise QueryError("a search names its index")
            return es_search(meta.multi_index(indexes, names), body) | {"status": 200}
        except QueryError as e:
            return {"status": 400, "error": str(e)}

    with ThreadPoolExecutor(MOST_AT_ONCE) as pool:
        return list(pool.map(one, lines))

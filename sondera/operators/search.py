"""Search: a request over an index to hits, counts, pages and highlights."""

from __future__ import annotations

import html
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import literals
from ..mapping import Index
from ..plans import ast as A
from ..plans import lang
from ..plans.compile import Compiler
from .rank import Ranked

MOST_HITS = 10_000


@dataclass
class Request:
    """What to search for.  ``query`` is text of the compact language or a tree."""

    query: str | A.Node = "*"
    start_timestamp: int | None = None
    end_timestamp: int | None = None
    max_hits: int = 20
    start_offset: int = 0
    sort: list[tuple[str, bool]] = field(default_factory=list)  # field and whether descending
    search_after: list[Any] | None = None
    aggs: dict | None = None
    snippet_fields: list[str] = field(default_factory=list)
    search_fields: list[str] = field(default_factory=list)
    count_all: bool = True
    lenient: bool = False


def parse_sort(text: str) -> list[tuple[str, bool]]:
    """The native form: ``f`` or ``+f`` descending, ``-f`` ascending, up to two."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        out.append((part.lstrip("+-"), not part.startswith("-")))
    if len(out) > 2:
        raise QueryError("at most two sort fields")
    return out


def parse_es_sort(sort) -> list[tuple[str, bool]]:
    """The JSON form: ascending but for ``_score``."""
    out = []
    for s in sort if isinstance(sort, list) else [sort]:
        if isinstance(s, str):
            name, _, order = s.partition(":")
            out.append((name, order == "desc" if order else name == "_score"))
        else:
            ((name, o),) = s.items()
            order = o if isinstance(o, str) else o.get("order", "desc" if name == "_score" else "asc")
            out.append((name, order == "desc"))
    if len(out) > 2:
        raise QueryError("at most two sort fields")
    return out


def tree(index: Index, request: Request) -> A.Node:
    q = request.query
    if isinstance(q, str):
        q = lang.parse(q, request.search_fields or index.mapping.default_fields)
    return A.simplify(q)


def interval(index: Index, start: int | None, end: int | None) -> Column:
    """Documents in [start, end) seconds; those without a timestamp are out."""
    if start is None and end is None:
        return F.lit(True)
    if not index.mapping.timestamp:
        raise QueryError("a time interval needs a timestamp field")
    ts = F.col(index.mapping.timestamp).cast("timestamp")
    out = ts.isNotNull()
    if start is not None:
        out &= ts >= F.lit(literals.from_micros(start * 1_000_000)).cast("timestamp")
    if end is not None:
        out &= ts < F.lit(literals.from_micros(end * 1_000_000)).cast("timestamp")
    return F.coalesce(out, F.lit(False))


def matching(index: Index, request: Request) -> DataFrame:
    """All documents that match, with all their columns."""
    q = tree(index, request)
    return index.df.where(interval(index, request.start_timestamp, request.end_timestamp)).where(Compiler(index, request.lenient).predicate(q))


def count(index: Index, request: Request) -> DataFrame:
    """One row with the exact number of hits.  Without a query it is the sum of the
    row counts of file footers."""
    return matching(index, request).agg(F.count("*").alias("count"))


def _key(index: Index, name: str) -> Column:
    if name == "_score":
        return F.col("_score")
    if name in ("_doc", "_shard_doc"):
        return F.col(index.id)
    r = index.resolve(name)
    if r.field.kind == "json":
        return F.try_variant_get(index.variant(r), r.path, "double")
    if r.field.kind in ("text", "bytes", "object"):
        raise QueryError(f"{name!r} of type {r.field.kind} cannot be sorted by")
    if not r.field.fast:
        raise QueryError(f"sorting needs {name!r} to be a fast field")
    return F.get(r.column, 0) if r.field.array else r.column


def ordering(index: Index, sort: list[tuple[str, bool]]) -> list[Column]:
    """Missing values last either way; ties by the document in the first key's direction.
    Without keys, the latest document first."""
    keys = [_key(index, n).desc_nulls_last() if desc else _key(index, n).asc_nulls_last() for n, desc in sort]
    if not any(n in ("_doc", "_shard_doc") for n, _ in sort):
        first_desc = sort[0][1] if sort else True
        keys.append(F.col(index.id).desc() if first_desc else F.col(index.id).asc())
    return keys


def after(index: Index, sort: list[tuple[str, bool]], values: list[Any]) -> Column:
    """Documents strictly behind the given key values, null being last."""
    names = list(sort)
    if len(values) == len(names) + 1:
        names.append(("_doc", sort[0][1] if sort else True))
    if len(values) != len(names):
        raise QueryError("search_after has a value for each sort field")
    out, equal = F.lit(False), F.lit(True)
    for (n, desc), v in zip(names, values, strict=True):
        c = _key(index, n)
        if n not in ("_score", "_doc", "_shard_doc") and v is not None:
            r = index.resolve(n)
            if r.field.kind == "datetime":
                c = c.cast("timestamp")
                v = F.lit(literals.from_micros(literals.parse_datetime(v))).cast("timestamp")
        if v is None:
            behind, same = F.lit(False), c.isNull()
        else:
            behind, same = F.coalesce((c < v) if desc else (c > v), F.lit(True)), F.coalesce(c == v, F.lit(False))
        out = out | (equal & behind)
        equal = equal & same
    return out


def top(index: Index, request: Request) -> DataFrame:
    """The hits of one page in their order; ``_score`` is there if it was asked for."""
    if request.max_hits > MOST_HITS or request.start_offset > MOST_HITS or min(request.max_hits, request.start_offset) < 0:
        raise QueryError(f"max_hits and start_offset are at most {MOST_HITS}")
    df = matching(index, request)
    if any(n == "_score" for n, _ in request.sort):
        df = df.withColumn("_score", Compiler(index).score(tree(index, request)))
    if request.search_after is not None:
        df = df.where(after(index, request.sort, request.search_after))
    df = df.orderBy(*ordering(index, request.sort))
    return df.offset(request.start_offset).limit(request.max_hits) if request.start_offset else df.limit(request.max_hits)


def late(index: Index, request: Request) -> DataFrame:
    """As :func:`top`, fetching the documents of the ranked ids afterwards: only ids and
    keys are sorted, and the page's ids (at most ``max_hits``) are joined back."""
    ids = top(index, request).select(F.col(index.id), *(["_score"] if any(n == "_score" for n, _ in request.sort) else []))
    ranked = ids.withColumn("_rank", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    return index.df.join(F.broadcast(ranked), index.id).orderBy("_rank")


class Scroll:
    """Pages over the documents as they were at the first call.  The ranked
    documents are written once; a page is a range of positions."""

    def __init__(self, index: Index, request: Request, folder: str, ttl_ms: int = 300_000):
        if request.search_after is not None:
            raise QueryError("a scroll has no search_after")
        if ttl_ms > 30 * 60_000:
            raise QueryError("a scroll lives 30 minutes at most")
        self.id, self.size, self.page_no, self.until = uuid.uuid4().hex, request.max_hits, 0, time.time() + ttl_ms / 1000
        df = matching(index, request)
        if any(n == "_score" for n, _ in request.sort):
            df = df.withColumn("_score", Compiler(index).score(tree(index, request)))
        self.ranked = Ranked.write(df, ordering(index, request.sort), f"{folder}/scroll-{self.id}")

    def next(self) -> DataFrame:
        if time.time() > self.until:
            raise QueryError("the scroll has expired")
        low = self.page_no * self.size
        self.page_no += 1
        return self.ranked.slice(low, low + self.size)


def highlight(text: str | None, terms: dict[str, float], most: int = 150) -> list[str]:
    """The best window of the text with its terms in bold; none where no term occurs."""
    import re

    if not text:
        return []
    found = [(m.start(), m.end(), terms[m.group().lower()]) for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in terms]
    if not found:
        return []
    best, best_score = found[0][0], -1.0
    for s, _, _ in found:
        inside = {text[a:b].lower(): w for a, b, w in found if a >= s and b <= s + most}
        if sum(inside.values()) > best_score:
            best, best_score = s, sum(inside.values())
    start = max(0, min(best - 20, len(text) - most))
    if start:
        start = text.find(" ", start) + 1 if 0 <= text.find(" ", start) < best else best
    end = min(len(text), start + most)
    out, at = [], start
    for a, b, _ in found:
        if a >= start and b <= end:
            out += [html.escape(text[at:a]), "<b>", html.escape(text[a:b]), "</b>"]
            at = b
    return ["".join([*out, html.escape(text[at:end])])]


def snippets(index: Index, request: Request, hits: DataFrame | None = None) -> DataFrame:
    """The page's ids with a highlight list per field; terms weigh 1 / (1 + df)."""
    hits = hits if hits is not None else top(index, request)
    c = Compiler(index)
    words: dict[str, list[str]] = {}
    for f, ts, _ in c.score_terms(tree(index, request)):
        if f in request.snippet_fields:
            words.setdefault(f, []).extend(ts)
    weights: dict[str, dict[str, float]] = {}
    words = {f: list(dict.fromkeys(ws)) for f, ws in words.items()}
    if words:
        df = (index.stats.lookup(words) if index.stats is not None else c.frequencies(words))[1]
        weights = {f: {w: 1 / (1 + df[f, w]) for w in ws} for f, ws in words.items()}

    def udf(f: str):
        ws = weights.get(f, {})

        @F.pandas_udf("array<string>")
        def run(t):
            return t.map(lambda x: highlight(x, ws))

        return run

    import pandas as pd

    for_field = []
    for f in request.snippet_fields:
        run = udf(f)
        run.func.__annotations__ = {"t": pd.Series, "return": pd.Series}
        for_field.append(run(F.col(f)).alias(f))
    return hits.select(F.col(index.id).alias("_id"), *for_field)

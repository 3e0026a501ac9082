"""Query trees to columns: a two-valued predicate, and a BM25 score.

Predicates are built-in expressions only, so that Spark can push them to the
scan.  Every leaf is null-safe: a missing field does not match, and its negation
does.
"""

from __future__ import annotations

import math
import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import analysis, literals
from ..mapping import Index, Resolved
from . import ast as A

K1, B = 1.2, 0.75


def safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs) if cs else F.lit(False)


def _all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs) if cs else F.lit(True)


def bound(tokens: Column, body) -> Column:
    """``body`` of the tokens, which are made once; in a lambda they would be made again
    for each position."""
    return F.get(F.transform(F.array(tokens), body), F.lit(0))


def occurrences(tokens: Column, words: list[str]) -> Column:
    """A struct of the number of tokens (``size``) and whether each word is one (``w0``, ``w1`` ...)."""
    return bound(tokens, lambda t: F.struct(F.size(t).alias("size"), *[F.array_contains(t, w).alias(f"w{i}") for i, w in enumerate(words)]))


def phrase(tokens: Column, terms: list[str], slop: int = 0, prefix: bool = False) -> Column:
    """Whether the terms stand in order; with a slop, positions less their index may
    differ by at most that."""
    return bound(tokens, lambda t: _phrase(t, terms, slop, prefix))


def _phrase(tokens: Column, terms: list[str], slop: int, prefix: bool) -> Column:
    def fits(i: int, t: Column) -> Column:
        return t.startswith(terms[i]) if prefix and i == len(terms) - 1 else t == terms[i]

    n = len(terms)
    exact = terms[:-1] if prefix else terms
    has = _all([F.array_contains(tokens, t) for t in dict.fromkeys(exact)])
    if n == 1:
        return F.exists(tokens, lambda t: fits(0, t)) if prefix else has
    size = F.size(tokens)
    if slop == 0:
        def starts(p: Column) -> Column:
            return _all([fits(i, F.get(tokens, p + i)) for i in range(n)])

        return has & (size >= n) & F.exists(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), starts)

    def at(i: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), size - 1), lambda p: fits(i, F.get(tokens, p)))
        return F.transform(places, lambda p: p - i)

    # The places of each term less its index, found once; a lowest one has one of each term
    # within the slop above it.
    def search(places: Column) -> Column:
        return F.exists(F.flatten(places), lambda low: F.forall(places, lambda ps: F.exists(ps, lambda p: (p >= low) & (p <= low + slop))))

    found = bound(F.array(*[at(i) for i in range(n)]), search)
    return F.when(has & (size > 0), found).otherwise(F.lit(False))


def phrase_count(tokens: Column, terms: list[str]) -> Column:
    n = len(terms)
    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda p: _all([F.get(tokens, p + i) == t for i, t in enumerate(terms)])))


class Compiler:
    """``lenient``: literals that do not fit a field match nothing instead of being errors."""

    def __init__(self, index: Index, lenient: bool = False):
        self.index, self.lenient = index, lenient

    def predicate(self, node: A.Node) -> Column:
        return self._node(A.simplify(node))

    def _node(self, node: A.Node) -> Column:
        if isinstance(node, A.MatchAll):
            return F.lit(True)
        if isinstance(node, A.MatchNone):
            return F.lit(False)
        if isinstance(node, A.Boost):
            return self._node(node.query)
        if isinstance(node, A.Bool):
            if node == A.Bool():
                return F.lit(True)
            required = [self._node(n) for n in (*node.must, *node.filter)]
            if node.should and not required:
                required = [_any([self._node(n) for n in node.should])]
            return _all(required + [~self._node(n) for n in node.must_not])
        try:
            return safe(self._leaf(node))
        except QueryError:
            if self.lenient:
                return F.lit(False)
            raise

    def _leaf(self, node: A.Node) -> Column:
        if isinstance(node, A.Term):
            return self.term(self.index.resolve(node.field), node.value)
        if isinstance(node, A.TermSet):
            return _any([self._set(f, vs) for f, vs in node.values.items()])
        if isinstance(node, A.FullText):
            return self.full_text(node)
        if isinstance(node, A.PhrasePrefix):
            r = self.index.resolve(node.field)
            terms = self._terms(r, node.phrase, node.analyzer)
            if not terms:
                return F.lit(False)
            return self._having(r, terms, phrase(self.index.tokens(r), terms, prefix=True))
        if isinstance(node, A.Wildcard):
            return self.wildcard(node)
        if isinstance(node, A.Range):
            return self.range(node)
        if isinstance(node, A.Exists):
            return self.exists(node.field)
        raise QueryError(f"{type(node).__name__} is no query")

    def _terms(self, r: Resolved, text: str, analyzer: str | None = None) -> list[str]:
        return analysis.query_tokens(text, analyzer or r.field.tokenizer)

    def _text(self, r: Resolved) -> Column | None:
        """The text that every token of the field is a part of.  That a text holds a term
        at all is told faster than its tokens are made; so most documents never are."""
        f = r.field
        if f.kind != "text" or f.array or r.path is not None or f.tokens:
            return None
        if f.tokenizer in ("default", "chinese_compatible", "multilang_default"):
            return F.lower(r.column)
        return r.column if f.tokenizer in ("whitespace", "simple") else None

    def _having(self, r: Resolved, parts: list[str], found: Column, every: bool = True) -> Column:
        """``found``, worked out where the text holds all (or any) of the parts."""
        text = self._text(r)
        if text is None:
            return found
        return (_all if every else _any)([text.contains(p) for p in dict.fromkeys(parts)]) & found

    def _all_terms(self, r: Resolved, terms: list[str]) -> Column:
        tokens = self.index.tokens(r)
        found = F.array_contains(tokens, terms[0]) if len(terms) == 1 else F.size(F.array_except(F.array(*map(F.lit, terms)), tokens)) == 0
        return self._having(r, terms, found)

    def _any_term(self, r: Resolved, terms: list[str]) -> Column:
        return self._having(r, terms, F.arrays_overlap(self.index.tokens(r), F.array(*map(F.lit, terms))), every=False)

    def literal(self, r: Resolved, value):
        f = r.field
        if f.kind in ("i64", "u64", "f64") and not f.coerce and isinstance(value, str):
            raise QueryError(f"{value!r} is text and {f.name!r} does not coerce")
        v = literals.coerce(value, f.kind, list(f.input_formats) + ["iso8601"] if f.kind == "datetime" else None)
        if f.kind == "datetime" and f.precision != "microseconds":
            v = literals.from_micros(literals.truncate(literals.micros(v), f.precision))
        return v

    def _value(self, r: Resolved) -> Column:
        """The column as queries compare it."""
        if r.field.kind == "datetime":
            c = r.column.cast("timestamp") if not r.field.array else r.column
            return c if r.field.precision in ("microseconds", "nanoseconds") else F.date_trunc({"seconds": "second", "milliseconds": "millisecond"}[r.field.precision], c)
        return r.column

    def _lit(self, r: Resolved, v) -> Column:
        return F.lit(v).cast("timestamp") if r.field.kind == "datetime" else F.lit(v)

    def term(self, r: Resolved, value) -> Column:
        f = r.field
        if f.kind == "json":
            return self._json_term(r, value)
        if f.kind == "text":
            v = literals.coerce(value, "text")
            if f.tokenizer == "raw" and not f.tokens:
                if len(v.encode()) > analysis.LONGEST:
                    return F.lit(False)
                return F.array_contains(r.column, v) if f.array else r.column == v
            return self._all_terms(r, [v])
        v = self.literal(r, value)
        return F.array_contains(r.column, self._lit(r, v)) if f.array else self._value(r) == self._lit(r, v)

    def _json_term(self, r: Resolved, value) -> Column:
        """A JSON value matches as what it looks like, and as text."""
        v = self.index.variant(r)
        kind = F.schema_of_variant(F.try_variant_get(v, r.path, "variant"))
        found = []
        if not isinstance(value, bool):
            try:
                x = literals.coerce(value, "f64")
                found.append(self._json_number(v, r.path) == F.lit(x))
            except QueryError:
                pass
        if isinstance(value, bool) or value in ("true", "false"):
            found.append((kind == "BOOLEAN") & (F.try_variant_get(v, r.path, "boolean") == F.lit(value in (True, "true"))))
        text = F.when(kind == "STRING", F.try_variant_get(v, r.path, "string"))
        run = analysis.tokenizer(r.field.tokenizer)
        found.append(F.array_contains(run(text), literals.coerce(value, "text")))
        return _any([safe(c) for c in found])

    @staticmethod
    def _json_number(v: Column, path: str) -> Column:
        """The number at a path; null where the value is none."""
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, path, "double"))

    def _set(self, name: str, values: tuple) -> Column:
        r = self.index.resolve(name)
        f = r.field
        if not values:
            return F.lit(False)
        if f.kind == "json":
            return _any([self.term(r, v) for v in values])
        if f.kind == "text":
            texts = [literals.coerce(v, "text") for v in values]
            if f.tokenizer == "raw" and not f.array and not f.tokens:
                return r.column.isin([t for t in texts if len(t.encode()) <= analysis.LONGEST])
            return self._any_term(r, texts)
        lits = [self._lit(r, self.literal(r, v)) for v in values]
        return F.arrays_overlap(r.column, F.array(*lits)) if f.array else self._value(r).isin(*lits)

    def full_text(self, node: A.FullText) -> Column:
        r = self.index.resolve(node.field)
        f = r.field
        if f.kind not in ("text", "json"):
            return self.term(r, node.text)
        if f.kind == "json" and f.tokenizer == "raw":
            return self.term(r, node.text)
        terms = self._terms(r, node.text, node.analyzer)
        if not terms:
            return F.lit(node.zero_terms_all)
        if f.kind == "text" and f.tokenizer == "raw" and not f.tokens and node.mode != "bool_prefix":
            return self.term(r, node.text)
        unique = list(dict.fromkeys(terms))
        if node.mode == "bool_prefix":
            first, last = list(dict.fromkeys(terms[:-1])), terms[-1]
            tokens = self.index.tokens(r)
            start = self._having(r, [last], F.exists(tokens, lambda t: t.startswith(last)))
            if not first:
                return start
            return self._all_terms(r, first) & start if node.operator == "and" else safe(self._any_term(r, first)) | start
        if node.mode == "phrase" or (node.mode == "phrase_or_and" and f.record == "position"):
            if len(terms) == 1:
                return self._all_terms(r, terms)
            if f.record != "position" and f.kind == "text" and node.mode == "phrase" and self.index.mapping.get(f.name) is not None:
                raise QueryError(f"{f.name!r} records no positions")
            return self._having(r, terms, phrase(self.index.tokens(r), terms, node.slop))
        return self._any_term(r, unique) if node.mode == "bool" and node.operator == "or" else self._all_terms(r, unique)

    def wildcard(self, node: A.Wildcard) -> Column:
        m = re.fullmatch(r"((?:[^*?\\]|\\.)*)\*", node.value, re.S)
        if m is None:
            raise QueryError(f"{node.value!r}: an asterisk may only end a value")
        r = self.index.resolve(node.field)
        if r.field.kind not in ("text", "json"):
            raise QueryError(f"{node.field!r} holds no text")
        start = re.sub(r"\\(.)", r"\1", m[1], flags=re.S)
        if r.field.tokenizer != "raw":
            start = start.lower()
        if r.field.kind == "text" and r.field.tokenizer == "raw" and not r.field.array and not r.field.tokens:
            return r.column.startswith(start)
        return self._having(r, [start], F.exists(self.index.tokens(r), lambda t: t.startswith(start)))

    def range(self, node: A.Range) -> Column:
        r = self.index.resolve(node.field)
        f = r.field
        ends = [(op, v) for op, v in (("gte", node.gte), ("gt", node.gt), ("lte", node.lte), ("lt", node.lt)) if v is not None]
        ops = {"gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v}
        if f.kind == "json":
            c = self._json_number(self.index.variant(r), r.path)
            return _all([c.isNotNull()] + [ops[op](c, F.lit(literals.coerce(v, "f64"))) for op, v in ends])
        if f.kind in ("text", "bool", "bytes", "object"):
            raise QueryError(f"a range over {node.field!r} of type {f.kind} is not supported")
        if not f.fast:
            raise QueryError(f"a range needs {node.field!r} to be a fast field")
        c = self._value(r)
        if node.formats and f.kind == "datetime":
            r = replace(r, field=replace(f, input_formats=node.formats))
        if f.kind in ("i64", "u64"):
            bounds = [(op, self._number(v)) for op, v in ends]
        else:
            bounds = [(op, self.literal(r, v)) for op, v in ends]
        if f.array:
            return F.exists(r.column, lambda x: _all([ops[op](x, self._lit(r, v)) for op, v in bounds]))
        return _all([c.isNotNull()] + [ops[op](c, self._lit(r, v)) for op, v in bounds])

    @staticmethod
    def _number(v):
        """A bound of an integer range, which may be a fraction or beyond the type."""
        x = literals.coerce(v, "f64")
        return int(v) if isinstance(v, int) or (isinstance(v, str) and v.lstrip("+-").isdigit() and abs(int(v)) < 2**63) else x

    def exists(self, name: str) -> Column:
        """Whether the field, or any field below that name, has a value."""
        try:
            r = self.index.resolve(name)
        except QueryError:
            below = [f.name for f in self.index.df.schema.fields if f.name.startswith(name + ".")]
            if not below:
                raise
            return _any([self.exists(b) for b in below])
        if r.field.kind == "json":
            return F.try_variant_get(self.index.variant(r), r.path, "variant").isNotNull() & (F.schema_of_variant(F.try_variant_get(self.index.variant(r), r.path, "variant")) != "VOID")
        return F.size(r.column) > 0 if r.field.array else r.column.isNotNull()

    # Scores

    def score_terms(self, node: A.Node) -> list[tuple[str, tuple[str, ...], float]]:
        """Field, terms (several for a phrase) and boost of each scored text leaf."""
        out: list[tuple[str, tuple[str, ...], float]] = []
        for leaf, boost in A.leaves(A.simplify(node)):
            if isinstance(leaf, A.Term):
                r = self.index.resolve(leaf.field)
                if r.field.kind == "text":
                    out.append((leaf.field, (literals.coerce(leaf.value, "text"),), boost))
            elif isinstance(leaf, A.FullText):
                r = self.index.resolve(leaf.field)
                if r.field.kind == "text":
                    terms = self._terms(r, leaf.text, leaf.analyzer)
                    if leaf.mode == "phrase" and len(terms) > 1:
                        out.append((leaf.field, tuple(terms), boost))
                    else:
                        out += [(leaf.field, (t,), boost) for t in terms]
        return out

    def frequencies(self, words: dict[str, list[str]]) -> tuple[dict[str, tuple[int, float]], dict[tuple[str, str], int]]:
        """Per field the number of documents and the mean length, and in how many documents
        each word is; in one aggregation over tokens that are made once."""
        seen = [occurrences(self.index.tokens(self.index.resolve(f)), ws).alias(f"f{k}") for k, (f, ws) in enumerate(words.items())]
        aggs = [F.count("*").alias("n")]
        for k, ws in enumerate(words.values()):
            aggs += [F.sum(f"f{k}.size").alias(f"len{k}"), *[F.count(F.when(F.col(f"f{k}.w{i}"), 1)).alias(f"df{k}_{i}") for i in range(len(ws))]]
        s = self.index.df.select(*seen).agg(*aggs).first()
        totals = {f: (s["n"], (s[f"len{k}"] or 0) / s["n"] if s["n"] else 0.0) for k, f in enumerate(words)}
        return totals, {(f, w): s[f"df{k}_{i}"] for k, (f, ws) in enumerate(words.items()) for i, w in enumerate(ws)}

    def score(self, node: A.Node) -> Column:
        """BM25 over the node's text leaves, with document frequencies and mean lengths of
        the whole index: those written for it, or taken in one aggregation."""
        terms = self.score_terms(node)
        if not terms:
            return F.lit(1.0)
        fields = list(dict.fromkeys(f for f, _, _ in terms))
        of = {f: self.index.resolve(f) for f in fields}
        words = {f: list(dict.fromkeys(t for g, ts, _ in terms for t in ts if g == f)) for f in fields}
        totals, df = self.index.stats.lookup(words) if self.index.stats is not None else self.frequencies(words)
        total = None
        for f in fields:
            n, mean = totals.get(f, (0, 0.0))
            idf = {w: math.log(1 + (n - df[f, w] + 0.5) / (df[f, w] + 0.5)) for w in words[f]}
            mean = mean or 1.0
            mine = [(ts, boost) for g, ts, boost in terms if g == f]
            part = self._bm25(of[f], self.index.tokens(of[f]), mine, idf, mean)
            total = F.coalesce(part, F.lit(0.0)) if total is None else total + F.coalesce(part, F.lit(0.0))
        return total

    @staticmethod
    def _bm25(r: Resolved, tokens: Column, terms: list[tuple[tuple[str, ...], float]], idf: dict[str, float], mean: float) -> Column:
        def one(t: Column, ts: tuple[str, ...]) -> Column:
            tf = F.size(F.filter(t, lambda x: x == ts[0])) if len(ts) == 1 else phrase_count(t, list(ts))
            return tf.cast("double") if r.field.record != "basic" or len(ts) > 1 else (tf > 0).cast("double")

        def total(t: Column) -> Column:
            norm = K1 * (1 - B + B * F.size(t) / F.lit(mean))
            out = F.lit(0.0)
            for ts, boost in terms:
                tf = one(t, ts)
                out = out + F.lit(boost * sum(idf[w] for w in ts) * (K1 + 1)) * tf / (tf + norm)
            return out

        return bound(tokens, total)

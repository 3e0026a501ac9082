"""Compiled predicates against a plain evaluator on random documents and queries."""

from __future__ import annotations

import random
import re

from sondera.mapping import Field, Index, Mapping
from sondera.plans import ast as A
from sondera.plans.compile import Compiler

WORDS = ["red", "blue", "bike", "small", "Tiny", "shelter"]


def _tokens(text):
    return [] if text is None else [t for t in re.split(r"[\W_]+", text.lower()) if t]


def _leaf(node, doc) -> bool:
    if isinstance(node, (A.MatchAll, A.MatchNone)):
        return isinstance(node, A.MatchAll)
    if isinstance(node, A.Term):
        return node.value in _tokens(doc["text"]) if node.field == "text" else doc[node.field] == node.value
    if isinstance(node, A.TermSet):
        return any(_leaf(A.Term(f, v), doc) for f, vs in node.values.items() for v in vs)
    if isinstance(node, A.Range):
        v = doc[node.field]
        return v is not None and (node.gte is None or v >= node.gte) and (node.lt is None or v < node.lt)
    if isinstance(node, A.Exists):
        return doc[node.field] is not None
    if isinstance(node, A.Wildcard):
        return any(t.startswith(node.value[:-1].lower()) for t in _tokens(doc["text"]))
    have, want = _tokens(doc["text"]), _tokens(node.phrase if isinstance(node, A.PhrasePrefix) else node.text)
    if isinstance(node, A.PhrasePrefix):
        n = len(want)
        return any(have[i : i + n - 1] == want[:-1] and i + n <= len(have) and have[i + n - 1].startswith(want[-1]) for i in range(len(have)))
    if node.mode == "bool":
        return (all if node.operator == "and" else any)(t in have for t in want) if want else node.zero_terms_all
    if node.mode == "bool_prefix":
        hits = [t in have for t in want[:-1]] + [any(h.startswith(want[-1]) for h in have)]
        return (all if node.operator == "and" else any)(hits)

    def spread(i, low, high):
        if i == len(want):
            return high - low <= node.slop
        return any(spread(i + 1, min(low, p - i), max(high, p - i)) for p, h in enumerate(have) if h == want[i])

    return spread(0, 10**6, -(10**6)) if want else False


def evaluate(node, doc) -> bool:
    if isinstance(node, A.Boost):
        return evaluate(node.query, doc)
    if isinstance(node, A.Bool):
        required = [evaluate(n, doc) for n in (*node.must, *node.filter)]
        if node.should and not required:
            required = [any(evaluate(n, doc) for n in node.should)]
        return all(required) and not any(evaluate(n, doc) for n in node.must_not)
    return _leaf(node, doc)


def _random(r: random.Random, depth: int = 3) -> A.Node:
    if depth and r.random() < 0.55:
        some = lambda: tuple(_random(r, depth - 1) for _ in range(r.choice([0, 0, 1, 2])))
        return A.Bool(some(), some(), some(), some())
    phrase = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    return r.choice([
        lambda: A.MatchAll(), lambda: A.MatchNone(), lambda: A.Term("text", r.choice(WORDS)), lambda: A.Term("k", r.choice("ab")), lambda: A.Term("n", r.randint(0, 5)), lambda: A.TermSet({"k": ("a", "c"), "text": (r.choice(WORDS),)}),
        lambda: A.Range("n", gte=r.randint(0, 3), lt=r.randint(2, 6)), lambda: A.Exists(r.choice(["k", "n"])), lambda: A.Wildcard("text", r.choice(["s*", "bi*", "Ti*"])), lambda: A.PhrasePrefix("text", phrase(2)[:-2]),
        lambda: A.FullText("text", phrase(2), "bool", r.choice(["and", "or"])), lambda: A.FullText("text", phrase(r.randint(1, 3)), "phrase", slop=r.choice([0, 1, 2, 4])), lambda: A.FullText("text", phrase(2), "bool_prefix", r.choice(["and", "or"])),
        lambda: A.FullText("text", "!", zero_terms_all=r.random() < 0.5), lambda: A.Boost(A.Term("k", "a"), 2.0),
    ])()


def test_predicates_equal_the_plain_evaluator(spark):
    r = random.Random(5)
    docs = [{"_id": i, "text": r.choice([None, "", " ".join(r.choice(WORDS) for _ in range(r.randint(1, 9)))]) if i % 3 == 0 else " ".join(r.choice(WORDS) for _ in range(r.randint(1, 9))), "k": r.choice([None, "a", "b", "c"]), "n": r.choice([None, 0, 1, 2, 3, 4, 5])} for i in range(80)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "_id long, text string, k string, n long").cache()
    ix = Index(df, Mapping((Field("text", "text", record="position", fast=False),), id_column="_id"))
    queries = [_random(r) for _ in range(160)]
    for at in range(0, len(queries), 20):
        some = queries[at : at + 20]
        flags = df.select("_id", *[Compiler(ix).predicate(q).alias(f"q{i}") for i, q in enumerate(some)]).orderBy("_id").collect()
        for row, doc in zip(flags, docs, strict=True):
            for i, q in enumerate(some):
                assert row[f"q{i}"] == evaluate(q, doc), (q, doc)
    df.unpersist()

from __future__ import annotations

import random

import numpy as np
from llm_tools import documents, sentence, words

from sondera.llm import linededup as ld
from sondera.llm import text as T


def _chunks(text):
    """A document's chunks by the rule, line by line: (joined lines, countable)."""
    lines = text.split("\n")
    data = [np.frombuffer(x.encode(), np.uint8) for x in lines]
    h = [T.span_hashes(d, np.array([0]), np.array([len(d)]))[0] for d in data]
    n = [len(words(x)) for x in lines]

    def roll(i):
        with np.errstate(over="ignore"):
            return int(T.mix(h[i] * np.uint64(3) + h[i + 1] * np.uint64(0x9E3779B97F4A7C15)))

    cuts = [0]
    for i in range(1, len(lines)):
        if n[i] >= 50 or n[i - 1] >= 50:
            cuts.append(i)
        elif i - cuts[-1] >= 2 and ((i + 1 < len(lines) and roll(i) % ld.DIVISOR == 0) or roll(i - 2) % ld.DIVISOR == 1):
            cuts.append(i)
    cuts.append(len(lines))
    return [("\n".join(lines[a:b]), n[a] >= 50 or (b - a > 1 and any(n[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)]


def _want(rows):
    first: dict[str, tuple] = {}
    split = {(i, t): _chunks(t) for i, t in rows if t is not None}
    for (i, _), parts in split.items():
        for p, (c, counted) in enumerate(parts):
            if counted and i is not None:
                first[c] = min(first.get(c, (i, p)), (i, p))
    out = []
    for i, t in rows:
        if t is None or i is None:
            out.append((i, t))
        else:
            out.append((i, "\n".join(c for p, (c, counted) in enumerate(split[i, t]) if not counted or first[c] == (i, p))))
    return sorted(out, key=repr)


def _corpus(seed=3):
    r = random.Random(seed)
    passages = ["\n".join(sentence(r, r.randint(3, 20)) for _ in range(r.randint(6, 14))) for _ in range(5)] + [sentence(r, 60) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [sentence(r, r.randint(1, 12)) for _ in range(r.randint(1, 10))]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "one short line"), (105, "one short line"), (106, rows[5][1]), (None, passages[0]), (107, "a\n" * 50), (108, "end\n")]
    return rows, passages


def test_equals_the_plain_rule(spark):
    rows, _ = _corpus()
    out = ld.dedup_lines(documents(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == _want(rows)


def test_repeated_passages_stay_once(spark):
    rows, passages = _corpus()
    texts = [r["text"] for r in ld.dedup_lines(documents(spark, rows)).where("doc_id is not null").collect() if r["text"]]
    for p in passages[5:]:  # long lines
        assert sum(t.split("\n").count(p) for t in texts) <= 1
    for p in passages[:5]:  # between shift-resistant boundaries most of the lines of a passage go
        lines = [x for x in p.split("\n") if len(words(x)) > 2]
        before = sum((t or "").split("\n").count(x) for i, t in rows if i is not None for x in lines)
        assert sum(t.split("\n").count(x) for t in texts for x in lines) - len(lines) < 0.6 * (before - len(lines))
    unique = {x for i, t in rows if t and i is not None for x in t.split("\n")}
    assert unique == {x for t in texts for x in t.split("\n")} | {""}


def test_other_columns_and_counts(spark):
    rows, _ = _corpus()
    docs = documents(spark, rows)
    out = ld.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_chunks_removed", "_chars_removed"]
    before = {r["part"]: r for r in docs.collect()}
    for r in out.collect():
        b = before[r["part"]]
        assert (r["doc_id"], r["key"], r["n_chars"]) == (b["doc_id"], b["key"], b["n_chars"])
        assert r["_chars_removed"] == len(b["text"] or "") - len(r["text"] or "")
        assert (r["_chunks_removed"] > 0) == (r["text"] != b["text"])


def test_clean_tables_are_left_alone(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(sentence(r, 12) for _ in range(10))) for i in range(30)]
    out = ld.dedup_lines(documents(spark, rows)).collect()
    assert sorted((x["doc_id"], x["text"]) for x in out) == rows
    assert ld.dedup_lines(documents(spark, [])).count() == 0


def test_rows_of_one_document(spark):
    line = " ".join(f"w{i}" for i in range(60))
    out = ld.dedup_lines(documents(spark, [(1, line), (1, line), (2, line)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, line), (1, line), (2, "")]


def test_different_bytes_stay(spark, monkeypatch):
    """Chunks whose keys collide are told apart by their bytes."""
    rows = [(1, "x " * 60), (2, "y " * 60)]
    docs = ld.marked(documents(spark, rows))
    assert ld.unequal(docs).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(9)
    passage = "\n".join(sentence(r, 15) for _ in range(12))
    long = "\n".join(sentence(r, 10) for _ in range(20_000))
    out = ld.dedup_lines(documents(spark, [(1, passage), (2, long + "\n" + passage)])).where("doc_id = 2").first()
    assert out["_chunks_removed"] >= 1 and len(out["text"]) >= len(long)

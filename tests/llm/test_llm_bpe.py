"""Ids by cached parts against the library on whole texts."""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondera.llm import bpe
from sondera.llm.bpe import ByteBpe, WordBpe

MADE = {
    "byte": ByteBpe.of(public_tokenizers.path("byte_bpe_50k.json")),
    "word": WordBpe.of(public_tokenizers.path("word_bpe_49k.json")),
}
PIECES = [
    "the", "The", "THE", "don't", "we'll", "l'été", "Straße", "naïve", "東京", "ﬁ", "ß", "İ", "ǅ", "½", "٣", "x" * 40, "a1b2", "3.14", "1,000", "e-mail", "C++", "_id_", "(a)", "...", "?!", "–", "“q”", "|", "||", "--",
    " ", " ", " ", " ", "  ", "   ", "\n", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "\x85", "\x1c", "\x00", "​", "﻿", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "</w>", "Ġ", "Ċ", "'s", "'S", "’s", "👍🏽", "́", "é",
]


def check(kind: str, texts: list[str | None]) -> None:
    made = MADE[kind]
    ids, n = made.encode_column(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]]
    assert len(ids) == n.sum() and not made.whole
    want = [made.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for t, g, w in zip(texts, got, want, strict=True):
        assert g == w, repr(t)


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_documents(spark, sf, kind):
    check(kind, [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])
    check(kind, [r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()])


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_edges(kind):
    check(kind, ["", None, " ", "\n", "a", " a", "a ", "\na", "a\n", "a\n b", "a \nb", "a\nb", "a  b", "'s", " 's", "a's 's", "…", "|", "a|b |c| d"])
    check(kind, [a + b + c for a in PIECES for b in ("", " ", "\n", "'") for c in ("the", "'s", "!", "é", "7", "")])


@pytest.mark.parametrize("kind", ["byte", "word"])
@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(PIECES), max_size=14))
def test_random_joins(kind, parts):
    check(kind, ["".join(parts), " ".join(parts)])


@pytest.mark.parametrize("kind", ["byte", "word"])
@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(kind, text):
    check(kind, [text.encode("utf-8", "replace").decode()])


@pytest.mark.parametrize("make", [ByteBpe, WordBpe])
def test_full_tables_forget_and_learn_again(make, monkeypatch, spark, sf):
    monkeypatch.setattr(bpe, "SHORT", (2, 64))
    monkeypatch.setattr(bpe, "LONG", (6, 8))
    monkeypatch.setattr(bpe, "POOL", 300)
    path = public_tokenizers.path("byte_bpe_50k.json" if make is ByteBpe else "word_bpe_49k.json")
    small = make(path)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for i in range(0, len(texts), 7):
        part = texts[i : i + 7]
        ids, n = small.encode_column(pa.array(part, pa.string()))
        want = [small.tok.encode(t or "", add_special_tokens=False).ids for t in part]
        assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
        assert len(small.pool) == 300 and small.tables[0].count <= 64


def test_file_of_another_layout_is_not_cut(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        made = json.load(f)
    made["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    other = ByteBpe(str(path))
    ids, n = other.encode_column(pa.array(["the cat, the dog", None, "x"], pa.string()))
    want = [other.tok.encode(t, add_special_tokens=False).ids for t in ("the cat, the dog", "", "x")]
    assert other.whole and ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]

"""Stemming and source code on whole batches: what comes out, and what Python holds meanwhile."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondera.functions import analysis
from sondera.functions.porter import stem
from sondera.queries import QUERIES

TEXTS = ["Running dogs, running PONIES", None, "", "--", "dogs " * 40, "naïve 東京 hoping", "x" * 256 + " skis"]


def test_each_token_is_stemmed_once(spark, tmp_path):
    spark.createDataFrame([(t,) for t in TEXTS], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["tokens_en_stem"](spark, str(tmp_path))
    want = Counter(stem(x) for t in TEXTS if t for x in re.split(r"[\W_]+", t.lower()) if x and len(x) <= 255)
    assert {r["token"]: r["n"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [token" in plan[plan.index("ArrowEvalPython") :]


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_of_a_batch(monkeypatch, size, kind):
    monkeypatch.setattr(analysis, "_SLICE", size)
    r = random.Random(1)
    lists = [None if r.random() < 0.1 else [r.choice(["running", "dogs", "東京", "", None]) for _ in range(r.randint(0, 9))] for _ in range(200)]
    want = [None if x is None else [None if t is None else stem(t) for t in x] for x in lists]
    assert analysis.stems(pa.array(lists, pa.list_(kind))).to_pylist() == want
    assert analysis.stems(pa.array(lists, pa.list_(kind)).slice(50, 20)).to_pylist() == want[50:70]
    texts = [None if r.random() < 0.1 else " ".join(r.choice(["parseHTTP2", "fooBar_x", "x" * 300, "東"]) for _ in range(r.randint(0, 4))) for _ in range(200)]
    assert analysis.split_codes(pa.array(texts, kind)).to_pylist() == [None if t is None else analysis.split_code(t) for t in texts]
    for empty in (analysis.stems(pa.array([], pa.list_(kind))), analysis.split_codes(pa.array([], kind))):
        assert empty.to_pylist() == [] and empty.type == pa.list_(kind)


def test_a_row_of_many_tokens_takes_few_python_objects():
    """A million tokens of 40 bytes as Python's text are 90 MB at least."""
    batch = pa.array([[f"{i % 1000:040d}" for i in range(500_000)]] * 2, pa.list_(pa.string()))
    tracemalloc.start()
    try:
        out = analysis._stem.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        stem.cache_clear()
    assert [len(x) for x in out] == [500_000] * 2 and peak < 10e6


def test_columns_of_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", analysis.en_stem(F.col("text")).alias("t")).collect()}
    assert got[0] == ["run", "dog", "run", "poni"] and got[1] is None and got[2] == got[3] == [] and got[4] == ["dog"] * 40 and got[6] == ["ski"]

"""The pipeline's stages on a small folder of tables, each against plain versions."""

from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest
from llm_tools import ALNUM, lower, sentence, words

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    d = tmp_path_factory.mktemp("tables")
    clean = [(i, "\n".join(sentence(r, 40, 10**6) for _ in range(4))) for i in range(120)]
    passage = sentence(r, 70, 10**6)
    item = sentence(r, 30, 10**6)
    planted = [(200, clean[3][1]), (201, clean[4][1] + " tail"), (202, sentence(r, 60) + "\n" + passage), (203, sentence(r, 60) + "\n" + passage), (204, sentence(r, 60) + " " + item), (205, "too short"), (206, None), (207, "")]
    planted += [(300 + i, " ".join(r.choice(["$#", "%%", "<|>"]) + f"w{r.randrange(999)}" for _ in range(80))) for i in range(30)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in clean + planted]
    spark.createDataFrame(rows, TABLE).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean[:60]] + [(300 + i, 0, 0) for i in range(15)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), clean, item, passage


def test_stages(spark, folder, tmp_path):
    d, clean, item, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality, lines, near, last = seen.values()
    ids = {i for i, _ in clean}
    assert not {205, 206, 207} & set(quality) and len(set(range(300, 330)) & set(quality)) <= 2
    assert len(ids & set(quality)) >= 117
    assert sum(passage in (t or "") for t in lines.values()) == 1 and {202, 203} <= set(lines)
    assert 200 not in near and len(ids & set(near)) >= len(ids & set(quality)) - 1
    assert set(near) - set(last) == {i for i, t in near.items() if " ".join(words(lower(item), ALNUM)) in " ".join(words(lower(t), ALNUM))} == {204}
    for r in docs.collect():
        assert r["n_chars"] == len(r["text"])
    packed = cp.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in packed} == set(last)


def test_run(spark, folder):
    d, *_ = folder
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_empty_and_odd_documents(spark, folder):
    d, clean, *_ = folder
    empty = spark.createDataFrame([], TABLE)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, d).count() == 0
    odd = spark.createDataFrame([(None, clean[0][1], "en", "s", 1, 5), (1, clean[1][1], None, None, None, 5), (1, clean[1][1], None, None, None, 5), (2, None, "en", "s", 0, 5), (3, "", "en", "s", 0, 5)], TABLE + ", kept int")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns
        kept = [r["doc_id"] for r in out.collect()]
        assert kept.count(None) == 1 and kept.count(1) == 2, name

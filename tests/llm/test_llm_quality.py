from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from llm_tools import documents, sentence, words

from sondera.llm import quality


def _counts(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    inside = {i + t for i, g in enumerate(grams) if g in twice for t in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(inside)]


def test_counts_equal_the_plain_ones():
    r = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a b a b a b", "é ü x 東京 a|b", "x\nx\n x\nx", "# $ <>\n# $ <>", "a\x0bb\x0cc\rd", "\x1ca b"]
    texts += ["\n".join(" ".join(r.choice(["a", "b", "é", "#1", "<x>"]) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 8))) for _ in range(80)]
    got, feats = quality.statistics(pa.array(texts, pa.string()))
    assert got.tolist() == [_counts(t) for t in texts]
    assert np.isfinite(feats).all()


def _corpus():
    r = random.Random(8)
    good = [(i, sentence(r, r.randint(60, 200))) for i in range(300)]
    bad = [(1000 + i, " ".join(r.choice(["#", "$$", "<|>", "%%%", "w1"]) + sentence(r, 1) for _ in range(r.randint(60, 120)))) for i in range(40)]
    return good, bad


def _labels(spark, good, bad):
    return spark.createDataFrame([(i, 1, 0) for i, _ in good[:150]] + [(i, 0, 0) for i, _ in bad[:20]] + [(77777, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_anomalous_documents_go_and_others_stay(spark):
    good, bad = _corpus()
    short = [(5000, "too few words"), (5001, None), (5002, ""), (5003, "again and again " * 60)]
    docs = documents(spark, good + bad + short)
    rows = quality.measured(docs)
    model = quality.fit(rows, _labels(spark, good, bad))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(rows, model).collect()}
    failed = {r["doc_id"] for r in quality.judge(rows, model).where("base_failed").collect()}
    assert failed == {5000, 5001, 5002, 5003} and not any(kept[i] for i in failed)
    assert sum(kept[i] for i, _ in good[150:]) >= 147
    assert sum(not kept[i] for i, _ in bad[20:]) >= 18
    out = quality.keep_good(docs, model)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, k in kept.items() if k)


def test_without_labels_the_base_rules_decide(spark):
    good, bad = _corpus()
    rows = quality.measured(documents(spark, good[:20] + [(9, "few")]))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(i, 1, 0) for i, _ in good[:20]], "doc_id long, quality int, toxic int")
    for labels in (none, one_class):
        got = quality.judge(rows, quality.fit(rows, labels)).where("doc_id > 20 or doc_id <> 9").collect()
        assert all(r["kept"] != r["base_failed"] for r in got)


def test_empty_table_and_repeated_rows(spark):
    good, bad = _corpus()
    labels = _labels(spark, good, bad)
    empty = quality.measured(documents(spark, []))
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0
    rows = quality.measured(documents(spark, [*good, *bad, good[0], good[0]]))
    got = quality.judge(rows, quality.fit(rows, labels)).where("doc_id = 0").collect()
    assert len(got) == 3 and len(set(map(tuple, got))) == 1


def test_forest_isolates_outliers():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (500, 3)), [[8, 8, 8]]])
    s = quality.IsolationForest(x).score(x)
    assert s.argmax() == 500 and 0 < s.min() < s.max() < 1


def test_held_out_labels(spark, sf):
    """Fitted on half of the labelled rows, judged on the other half."""
    big = sf.replace("sf0.001", "sf0.01")
    rows = quality.measured(spark.read.parquet(f"{big}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{big}/labels.parquet").cache()
    model = quality.fit(rows, labels.where("doc_id % 2 = 0"))
    got = quality.judge(rows, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in got if r["quality"]], [r["kept"] for r in got if not r["quality"]]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_labels_that_disagree_are_not_used(spark):
    good, bad = _corpus()
    rows = quality.measured(documents(spark, good + bad))
    labels = _labels(spark, good, bad)
    odd = labels.unionByName(spark.createDataFrame([(i, 0, 0) for i, _ in good[150:]] + [(i, 1, 0) for i, _ in good[150:]], labels.schema))
    one, two = quality.fit(rows, labels), quality.fit(rows, odd)
    assert one.threshold == two.threshold and (one.forest.score(np.ones((3, 7))) == two.forest.score(np.ones((3, 7)))).all()

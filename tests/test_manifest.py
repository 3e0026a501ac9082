"""Changes of the manifest in single steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sondera.catalog import Catalog
from sondera.manifest import Manifest
from sondera.operators import maintain
from sondera.plans import lang
from sondera.streaming import ingest

CONFIG = {
    "index_id": "logs",
    "doc_mapping": {"timestamp_field": "ts", "field_mappings": [{"name": "ts", "type": "datetime"}, {"name": "n", "type": "i64"}]},
    "indexing_settings": {"merge_policy": {"type": "limit_merge", "merge_factor": 2, "max_merge_factor": 2, "max_merge_ops": 3}},
}
DAY = 1_700_006_400


@pytest.fixture
def logs(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/root")
    mapping = cat.create(CONFIG)
    for k in range(4):
        _batch(spark, cat, mapping, k)
    return cat, mapping


def _batch(spark, cat, mapping, k):
    rows = spark.range(10).select(F.timestamp_seconds(F.lit(DAY + k * 86_400) + F.col("id")).alias("ts"), (F.col("id") + 10 * k).alias("n")).coalesce(1)
    docs = spark.createDataFrame(rows.collect(), mapping.schema()) if set(rows.columns) == set(mapping.schema().names) else rows
    ingest.write_splits(docs.coalesce(1), mapping, cat._folder("logs"), batch_id=k)


def _ns(cat):
    return sorted(r["n"] for r in cat.open("logs").df.select("n").collect())


def test_a_batch_that_comes_again_after_a_merge_adds_nothing(spark, logs):
    cat, mapping = logs
    assert _ns(cat) == list(range(40))
    assert cat.merge("logs") == 2
    m = cat.manifest("logs").where("state = 'published'").select("merge_ops", "num_docs").collect()
    assert sorted(map(tuple, m)) == [(1, 20), (1, 20)]  # each group counts its own merges
    for k in range(4):
        _batch(spark, cat, mapping, k)
    assert _ns(cat) == list(range(40))
    _batch(spark, cat, mapping, 4)
    assert _ns(cat) == list(range(50))


def test_a_change_that_dies_leaves_all_as_it_was(spark, logs, monkeypatch):
    cat, _ = logs

    def dies(self, name, held):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "_put", dies)
        with pytest.raises(RuntimeError):
            cat.delete_where("logs", lang.parse("n:<5"))
        with pytest.raises(RuntimeError):
            cat.merge("logs")
    assert _ns(cat) == list(range(40))
    assert cat.delete_where("logs", lang.parse("n:<5")) == 5
    assert _ns(cat) == list(range(5, 40))


def test_two_changes_at_once_both_take_effect(spark, logs):
    cat, _ = logs
    held = Manifest(spark, cat._folder("logs"))
    ids = sorted(r["split_id"] for r in held.read().collect())
    seen = []

    def slow(m):
        if not seen:  # another change comes first
            cat.mark_for_deletion("logs", ids[:1])
        seen.append(1)
        return maintain.marked(m, F.col("split_id") == ids[1], 5)

    held.change(slow)
    assert len(seen) == 2
    assert sorted(r["split_id"] for r in held.read().where("state = 'marked'").collect()) == ids[:2]


def test_an_old_split_marked_now_keeps_its_files_for_its_grace(spark, logs):
    cat, _ = logs
    held = Manifest(spark, cat._folder("logs"))
    held.change(lambda m: m.withColumn("create_time", F.lit(1).cast("long")).withColumn("update_time", F.lit(1).cast("long")))
    ids = [r["split_id"] for r in held.read().collect()]
    cat.mark_for_deletion("logs", ids[:1])
    assert cat.collect_garbage("logs") == 0
    assert cat.collect_garbage("logs", now=2**33) == 1

"""Indexes by name: create, describe, clear, delete; their sources and splits."""

from __future__ import annotations

import hashlib
import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import MappingError, QueryError
from .functions import analysis
from .functions.scalars import glob_match
from .manifest import Manifest
from .mapping import Index, Mapping
from .operators import maintain, meta, search
from .plans import ast as A
from .plans.compile import Compiler

_ID = re.compile(r"[a-zA-Z][a-zA-Z0-9_.\-]{2,254}")


class Catalog:
    """Folders below ``root``: a configuration, data, a manifest and a checkpoint each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, index_id: str) -> str:
        return f"{self.root}/{index_id}"

    def _write(self, path: str, config: dict) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(json.dumps(config, sort_keys=True).encode()))
        out.close()

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def config(self, index_id: str) -> dict:
        path = f"{self._folder(index_id)}/config.json"
        if not self._exists(path):
            raise QueryError(f"there is no index {index_id!r}")
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path).collect()))

    def create(self, config: dict, overwrite: bool = False) -> Mapping:
        index_id = config["index_id"]
        if not _ID.fullmatch(index_id):
            raise MappingError(f"{index_id!r} is no index id")
        mapping = Mapping.parse(config)
        maintain.policy(config.get("indexing_settings", {}).get("merge_policy"))
        if self._exists(f"{self._folder(index_id)}/config.json"):
            if not overwrite:
                raise MappingError(f"there is an index {index_id!r} already")
            self.delete(index_id)
        self._write(f"{self._folder(index_id)}/config.json", {"sources": {}, "create_time": int(time.time()), **config})
        return mapping

    def update(self, config: dict) -> None:
        """Settings may change, the mapping may not."""
        old = self.config(config["index_id"])
        digest = lambda c: hashlib.sha256(json.dumps(c.get("doc_mapping"), sort_keys=True).encode()).hexdigest()
        if digest(old) != digest(config):
            raise MappingError("the mapping of an index cannot change")
        self._write(f"{self._folder(config['index_id'])}/config.json", old | config)

    def names(self, pattern: str = "*") -> list[str]:
        if not self._exists(self.root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n for n in found if glob_match(pattern, n) and self._exists(f"{self._folder(n)}/config.json"))

    def delete(self, index_id: str, dry_run: bool = False) -> list[str]:
        self.config(index_id)
        paths = [r["path"] for r in self.manifest(index_id).select("path").collect()] if dry_run else []
        if not dry_run:
            self._fs.delete(self._path(self._folder(index_id)), True)
        return paths

    def clear(self, index_id: str) -> None:
        """Drop all documents and start the sources over."""
        self.config(index_id)
        for part in ("data", "manifest", "manifest-base", "manifest-versions", "checkpoint", "landing"):
            self._fs.delete(self._path(f"{self._folder(index_id)}/{part}"), True)

    def manifest(self, index_id: str) -> DataFrame:
        return Manifest(self.spark, self._folder(index_id)).read()

    def describe(self, index_id: str) -> DataFrame:
        return meta.describe(self.manifest(index_id)).withColumn("index_id", F.lit(index_id))

    def open(self, index_id: str, query: A.Node | None = None, start: int | None = None, end: int | None = None) -> Index:
        """The documents of an index; with a query, of the splits that can match it."""
        config = self.config(index_id)
        mapping = Mapping.parse(config)
        m = self.manifest(index_id)
        empty = Index(self.spark.createDataFrame([], mapping.schema()), mapping, index_id)
        if query is not None or start is not None or end is not None:
            m = meta.prune(m, empty, query or A.MatchAll(), start, end)
        paths = [r["path"] for r in m.where("state = 'published'").select("path").collect()]
        if not paths:
            return empty
        return Index(self.spark.read.option("mergeSchema", "true").parquet(*paths), mapping, index_id)

    def newest(self, index_id: str, request: search.Request, at_once: int = 16) -> list[dict]:
        """The hits of a request for the latest documents first, read from the newest splits
        on until no older split can hold a better hit.  Nothing is counted."""
        mapping = Mapping.parse(self.config(index_id))
        if not mapping.timestamp or request.sort != [(mapping.timestamp, True)] or request.start_offset:
            raise QueryError("the newest hits are sorted by the timestamp, descending, from the first")
        empty = Index(self.spark.createDataFrame([], mapping.schema()), mapping, index_id)
        m = meta.prune(self.manifest(index_id), empty, search.tree(empty, request), request.start_timestamp, request.end_timestamp)
        splits = m.where("state = 'published' and time_end is not null").select("path", "time_end").orderBy(F.desc("time_end")).collect()
        best: list[dict] = []
        while splits and not (len(best) == request.max_hits and best[-1]["_second"] > splits[0]["time_end"]):
            some, splits = splits[:at_once], splits[at_once:]
            ix = Index(self.spark.read.option("mergeSchema", "true").parquet(*[r["path"] for r in some]), mapping, index_id)
            hits = search.top(ix, request).withColumn("_second", F.unix_seconds(F.col(mapping.timestamp).cast("timestamp")))
            best += [r.asDict() for r in hits.collect()]
            best.sort(key=lambda r: (r[mapping.timestamp], r[ix.id]), reverse=True)
            del best[request.max_hits :]
            at_once *= 2
        return [{k: v for k, v in r.items() if k != "_second"} for r in best]

    # Sources

    def add_source(self, index_id: str, source: dict) -> None:
        c = self.config(index_id)
        if source["source_id"] in c["sources"]:
            raise MappingError(f"there is a source {source['source_id']!r} already")
        c["sources"][source["source_id"]] = {"enabled": True, **source}
        self._write(f"{self._folder(index_id)}/config.json", c)

    def delete_source(self, index_id: str, source_id: str) -> None:
        c = self.config(index_id)
        if c["sources"].pop(source_id, None) is None:
            raise QueryError(f"there is no source {source_id!r}")
        self._write(f"{self._folder(index_id)}/config.json", c)

    def toggle_source(self, index_id: str, source_id: str, enabled: bool) -> None:
        c = self.config(index_id)
        if source_id not in c["sources"]:
            raise QueryError(f"there is no source {source_id!r}")
        c["sources"][source_id]["enabled"] = enabled
        self._write(f"{self._folder(index_id)}/config.json", c)

    def reset_checkpoint(self, index_id: str) -> None:
        self._fs.delete(self._path(f"{self._folder(index_id)}/checkpoint"), True)

    # Splits

    def _change(self, index_id: str, f) -> None:
        Manifest(self.spark, self._folder(index_id)).change(f)

    def mark_for_deletion(self, index_id: str, split_ids: list[str]) -> None:
        self._change(index_id, lambda m: maintain.marked(m, F.col("split_id").isin(split_ids), int(time.time())))

    def retain(self, index_id: str, now: int | None = None) -> None:
        policy = self.config(index_id).get("retention")
        if policy:
            self._change(index_id, lambda m: maintain.retention(m, policy["period"], now or int(time.time())))

    def collect_garbage(self, index_id: str, now: int | None = None) -> int:
        """Delete the files of marked splits after their grace; returns how many."""
        now = now or int(time.time())
        gone = maintain.collectable(self.manifest(index_id), now).collect()
        for r in gone:
            self._fs.delete(self._path(r["path"]), False)
        ids = [r["split_id"] for r in gone]
        if ids:
            self._change(index_id, lambda m: m.where(~F.col("split_id").isin(ids)))
        return len(ids)

    def _swap(self, index_id: str, ids: list[str], new: DataFrame) -> None:
        """Mark splits and publish those that stand for them, so that no reader sees both or none."""
        self._change(index_id, lambda m: maintain.marked(m, F.col("split_id").isin(ids), int(time.time())).unionByName(new))

    def merge(self, index_id: str) -> int:
        """Run the merges that the index's policy plans; returns how many."""
        from .streaming.ingest import write_splits

        config = self.config(index_id)
        mapping = Mapping.parse(config)
        p = maintain.policy(config.get("indexing_settings", {}).get("merge_policy"))
        rows = self.manifest(index_id).where("state = 'published'").collect()
        paths = {r["split_id"]: r["path"] for r in rows}
        plans = p.plan([maintain.Split(r["split_id"], r["num_docs"], r["merge_ops"], r["maturity"], r["time_end"], r["create_time"], r["partition_id"]) for r in rows])
        for group in plans:
            df = self.spark.read.parquet(*[paths[s.split_id] for s in group])
            new = write_splits(df.coalesce(1), mapping, self._folder(index_id), publish=False)
            self._swap(index_id, [s.split_id for s in group], new.withColumn("merge_ops", F.lit(1 + max(s.merge_ops for s in group))))
        return len(plans)

    def delete_where(self, index_id: str, query: A.Node, start: int | None = None, end: int | None = None) -> int:
        """Rewrite the splits that hold matching documents without them; returns how many documents go."""
        from .streaming.ingest import write_splits

        mapping = Mapping.parse(self.config(index_id))
        m = self.manifest(index_id)
        hit = meta.prune(m, Index(self.spark.createDataFrame([], mapping.schema()), mapping), query, start, end).where("state = 'published'").collect()
        if not hit:
            return 0
        df = self.spark.read.option("mergeSchema", "true").parquet(*[r["path"] for r in hit])
        ix = Index(df, mapping, index_id)
        p = Compiler(ix).predicate(query) & search.interval(ix, start, end)
        gone = df.where(p).count()
        if gone:
            self._swap(index_id, [r["split_id"] for r in hit], write_splits(df.where(~p), mapping, self._folder(index_id), publish=False))
        return gone


def analyze(spark: SparkSession, text: str, config: str | dict) -> DataFrame:
    """The tokens of one text: position and token."""
    return analysis.analyze(spark.createDataFrame([(text,)], "text string"), "text", config)

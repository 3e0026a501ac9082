"""Streaming ingestion: parse, route, write splits and their manifest rows, exactly once."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MappingError
from ..functions.scalars import hash_mod
from ..manifest import Manifest
from ..mapping import Mapping
from ..sources import readers

MOST_TAGS = 1000


def routing(expr: str | None, most: int | None = None) -> Column:
    """The partition of a document: fields and ``hash_mod(expr, n)``, separated by
    commas.  Beyond ``most`` partitions, documents share them by hash."""
    if not expr:
        return F.lit(0).cast("long")
    parts = [_route(p) for p in _split(expr)]
    if len(parts) == 1 and expr.strip().startswith("hash_mod"):
        key = parts[0].cast("long")
    else:
        key = F.xxhash64(*parts)
    return F.pmod(key, F.lit(most)).cast("long") if most else key


def _split(expr: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(expr):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(expr[at:i])
            at = i + 1
    out.append(expr[at:])
    if depth or any(not p.strip() for p in out):
        raise MappingError(f"{expr!r} is no routing expression")
    return [p.strip() for p in out]


def _route(p: str) -> Column:
    m = re.fullmatch(r"hash_mod\((.*),\s*(\d+)\)", p)
    if m:
        inner = m[1].strip()
        inner = inner[1:-1] if inner.startswith("(") and inner.endswith(")") else inner
        return hash_mod(int(m[2]), *[_route(x) for x in _split(inner)])
    if not re.fullmatch(r"[\w.\-]+", p):
        raise MappingError(f"{p!r} is no field")
    return F.col(p)


@dataclass(frozen=True)
class Settings:
    """When a split is cut: by documents, or by the trigger's time."""

    commit_timeout: str = "60 seconds"
    split_docs: int = 10_000_000
    files_per_trigger: int | None = None


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_error").isNull()).drop("_error")


def counts(parsed: DataFrame) -> DataFrame:
    """How many documents are valid, and how many each error rejects."""
    return parsed.groupBy(F.coalesce("_error", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("docs"))


def write_splits(docs: DataFrame, mapping: Mapping, folder: str, batch_id: int | None = None, settings: Settings | None = None, publish: bool = True) -> DataFrame:
    """Write documents as Parquet files by day and partition; returns the manifest rows, of
    the new files alone where these are not to be published yet.

    The files of a batch lie in a folder named by the batch.  A batch that is tried again
    replaces them; one that is in the manifest already is not written again, as its files
    may have been merged since.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    name = f"batch={batch_id:012d}" if batch_id is not None else f"append={uuid.uuid4().hex}"
    path, held = f"{folder}/data/{name}", Manifest(spark, folder)
    if batch_id is not None and held.committed(name):
        return held.read()
    out = docs.withColumn("_partition", routing(mapping.partition_key, mapping.max_partitions))
    ts = F.col(mapping.timestamp).cast("timestamp") if mapping.timestamp else None
    out.write.mode("overwrite").option("maxRecordsPerFile", settings.split_docs).partitionBy("_partition").parquet(path)
    written = spark.read.schema(out.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_bytes"))
    tags = []
    for t in mapping.tags:
        values = F.slice(F.array_sort(F.collect_set(F.concat(F.lit(f"{t}:"), F.col(t).cast("string")))), 1, MOST_TAGS + 1)
        tags.append(F.when(F.size(values) <= MOST_TAGS, F.concat(F.array(F.lit(f"{t}!")), values)).otherwise(F.array().cast("array<string>")))
    now = int(time.time())
    rows = written.groupBy(F.col("_path").alias("path"), F.col("_partition").alias("partition_id")).agg(
        F.count("*").alias("num_docs"), F.max("_bytes").alias("bytes"),
        (F.min(F.unix_seconds(ts)) if ts is not None else F.lit(None).cast("long")).alias("time_start"),
        (F.max(F.unix_seconds(ts)) if ts is not None else F.lit(None).cast("long")).alias("time_end"),
        (F.concat(*tags) if tags else F.array().cast("array<string>")).alias("tags"),
    )
    manifest = rows.select(
        F.sha2("path", 256).substr(1, 26).alias("split_id"), "path", F.lit("published").alias("state"), "num_docs", F.col("bytes").cast("long"), "time_start", "time_end", "tags", F.col("partition_id").cast("long"),
        F.lit(now).cast("long").alias("create_time"), F.lit(0).cast("long").alias("maturity"), F.lit(0).cast("long").alias("delete_opstamp"), F.lit(0).alias("merge_ops"), F.lit(now).cast("long").alias("update_time"),
    )
    if not publish:
        return manifest
    held.add(manifest, name)
    return held.read()


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return Manifest(spark, folder).read()


def ingest(spark: SparkSession, source: dict, mapping: Mapping, folder: str, settings: Settings | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True):
    """Run a source into an index folder; returns the streaming query.

    ``transform`` takes and returns documents as JSON text in ``doc``.  Progress is in
    the checkpoint, and a batch's files carry its number, so each document is
    written once.  Rejected documents are counted in the query's observed metrics.
    """
    settings = settings or Settings()
    params = dict(source.get("params", {}))
    if settings.files_per_trigger:
        params["maxFilesPerTrigger"] = settings.files_per_trigger
    raw = readers.read_source(spark, source | {"params": params}, streaming=True)
    docs = readers.decode(raw, source.get("input_format", "json"))
    if transform is not None:
        docs = transform(docs)
    parsed = readers.parse(docs, mapping)
    observed = parsed.observe("ingested", F.count("*").alias("docs"), F.count("_error").alias("rejected"))
    w = valid(observed).writeStream.foreachBatch(lambda df, n: write_splits(df, mapping, folder, n, settings) and None).option("checkpointLocation", f"{folder}/checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=settings.commit_timeout)
    return w.start()


def append(spark: SparkSession, folder: str, lines: list[str], commit: str = "auto") -> str:
    """Put lines into the landing folder of the ingest API, as one file that appears whole."""
    if commit not in ("auto", "wait_for", "force"):
        raise MappingError(f"there is no commit mode {commit!r}")
    path = f"{folder}/landing/{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path

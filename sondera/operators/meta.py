"""Dictionaries, field listings, and the manifest of an index's splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import QueryError
from ..functions.scalars import glob_match
from ..mapping import Field, Index, kind_of
from ..plans import ast as A


def list_terms(index: Index, field: str, start: str | None = None, end: str | None = None, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """The sorted distinct terms of a field in [start, end)."""
    r = index.resolve(field)
    df = index.df if where is None else index.df.where(where)
    terms = df.select(F.explode(index.tokens(r)).alias("term")) if r.field.kind in ("text", "json") else df.select((F.explode(r.column) if r.field.array else r.column).alias("term")).where("term is not null")
    if start is not None:
        terms = terms.where(F.col("term") >= start)
    if end is not None:
        terms = terms.where(F.col("term") < end)
    out = terms.distinct().orderBy("term")
    return out.limit(limit) if limit is not None else out


_ES_TYPE = {"text": "keyword", "i64": "long", "u64": "unsigned_long", "f64": "double", "bool": "boolean", "datetime": "date", "ip": "ip", "bytes": "binary", "json": "object", "object": "object"}


def _walk(fields: Sequence[Field], prefix: str = ""):
    for f in fields:
        if f.kind == "object":
            yield from _walk(f.fields, f"{prefix}{f.name}.")
        else:
            yield prefix + f.name, f


def _of_schema(schema: S.StructType, prefix: str = ""):
    for f in schema.fields:
        if f.name.startswith("_"):
            continue
        if isinstance(f.dataType, S.StructType):
            yield from _of_schema(f.dataType, f"{prefix}{f.name}.")
        else:
            kind, array = kind_of(f.dataType)
            try:
                yield prefix + f.name, Field(f.name, kind, array)
            except ValueError:
                continue


def list_fields(indexes: Sequence[Index], patterns: Sequence[str] = ("*",), json_fields: bool = False) -> DataFrame:
    """Field and type with whether it can be searched and aggregated, over all indexes.
    Of JSON fields, the paths that occur are listed if asked for."""
    spark = indexes[0].df.sparkSession
    rows = []
    found: dict[tuple[str, str], list] = {}
    for ix in indexes:
        mapped = dict(_walk(ix.mapping.fields))
        names = mapped | {n: f for n, f in _of_schema(ix.df.schema) if n not in mapped and ix.mapping.mode == "dynamic"}
        for n, f in names.items():
            if any(glob_match(p, n, 1) for p in patterns):
                e = found.setdefault((n, f.kind), [True, True, []])
                e[0] &= f.indexed
                e[1] &= f.fast
                e[2].append(ix.name)
    for (n, k), (searchable, aggregatable, names) in sorted(found.items()):
        rows.append((n, k, _ES_TYPE[k], searchable, aggregatable, sorted(names)))
    schema = "field string, kind string, es_type string, searchable boolean, aggregatable boolean, indexes array<string>"
    out = spark.createDataFrame(rows, schema)
    if json_fields:
        for ix in indexes:
            for n, f in _walk(ix.mapping.fields):
                if f.kind == "json":
                    out = out.unionByName(json_paths(ix, n).select(F.concat(F.lit(n + "."), "path").alias("field"), "kind", F.col("kind").alias("es_type"), F.lit(True).alias("searchable"), F.lit(True).alias("aggregatable"), F.array(F.lit(ix.name)).alias("indexes")))
    return out


def json_paths(index: Index, field: str) -> DataFrame:
    """The first-level keys of a JSON field with the kinds of their values."""
    v = index.variant(index.resolve(field))
    exploded = index.df.select(v.alias("v")).where("v is not null").lateralJoin(index.df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    kind = F.regexp_extract(F.schema_of_variant(F.col("value")), r"^\w+", 0)
    return exploded.where("key is not null").groupBy(F.col("key").alias("path"), F.lower(kind).alias("kind")).agg(F.count("*").alias("docs"))


def field_caps(indexes: Sequence[Index], patterns: Sequence[str] = ("*",)) -> dict:
    """The JSON form of :func:`list_fields`."""
    out: dict = {"indices": [ix.name for ix in indexes], "fields": {}}
    for r in list_fields(indexes, patterns).collect():
        one = {"metadata_field": False, "searchable": r["searchable"], "aggregatable": r["aggregatable"], "type": r["es_type"]}
        if len(r["indexes"]) < len(indexes):
            one["indices"] = list(r["indexes"])
        out["fields"].setdefault(r["field"], {})[r["es_type"]] = one
    return out


SPLIT = S.StructType([
    S.StructField("split_id", S.StringType()), S.StructField("path", S.StringType()), S.StructField("state", S.StringType()), S.StructField("num_docs", S.LongType()), S.StructField("bytes", S.LongType()), S.StructField("time_start", S.LongType()), S.StructField("time_end", S.LongType()),
    S.StructField("tags", S.ArrayType(S.StringType())), S.StructField("partition_id", S.LongType()), S.StructField("create_time", S.LongType()), S.StructField("maturity", S.LongType()), S.StructField("delete_opstamp", S.LongType()), S.StructField("merge_ops", S.IntegerType()),
])


def split_filter(time_start: int | None = None, time_end: int | None = None, tags: dict[str, set] | None = None, states: Sequence[str] = ("published",), opstamp: int | None = None, mature_at: int | None = None) -> Column:
    """Which splits can hold a match.  A split without a time range always can; tags are
    kept as ``field:value`` with ``field!`` for the fields of a split."""
    out = F.col("state").isin(*states)
    if time_start is not None:
        out &= F.col("time_end").isNull() | (F.col("time_end") >= time_start)
    if time_end is not None:
        out &= F.col("time_start").isNull() | (F.col("time_start") < time_end)
    for f, values in (tags or {}).items():
        known = F.array_contains("tags", f"{f}!")
        out &= ~known | F.arrays_overlap("tags", F.array(*[F.lit(f"{f}:{v}") for v in sorted(map(str, values))]))
    if opstamp is not None:
        out &= F.col("delete_opstamp") < opstamp
    if mature_at is not None:
        out &= F.col("maturity") <= mature_at
    return out


def describe(manifest: DataFrame) -> DataFrame:
    """One row about the published splits of an index."""
    return manifest.where("state = 'published'").agg(
        F.count("*").alias("num_published_splits"), F.coalesce(F.sum("num_docs"), F.lit(0)).alias("num_published_docs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_published_splits"),
        F.min("time_start").alias("min_timestamp"), F.max("time_end").alias("max_timestamp"),
    )


def list_splits(manifest: DataFrame, offset: int = 0, limit: int = 100, **filters) -> DataFrame:
    return manifest.where(split_filter(**filters)).orderBy("split_id").offset(offset).limit(limit)


def prune(manifest: DataFrame, index: Index, query: A.Node, start: int | None = None, end: int | None = None) -> DataFrame:
    """The splits a query has to read: by its time interval, the bounds of its own
    clauses, and its tags."""
    from ..functions.literals import parse_datetime

    ts = index.mapping.timestamp
    if ts:
        low, high = A.time_bounds(query, ts)
        if low is not None:
            low = parse_datetime(low) // 1_000_000
            start = low if start is None else max(start, low)
        if high is not None:
            high = parse_datetime(high) // 1_000_000 + 1
            end = high if end is None else min(end, high)
    return manifest.where(split_filter(start, end, A.required_terms(query, index.mapping.tags)))


def multi_index(indexes: dict[str, Index], patterns: str | Sequence[str]) -> Index:
    """The documents of all named indexes as one.  A name that is missing is an error,
    a pattern that matches none is not; ``-name`` takes out what came before."""
    chosen: dict[str, Index] = {}
    for p in patterns.split(",") if isinstance(patterns, str) else patterns:
        if p.startswith("-"):
            chosen = {n: ix for n, ix in chosen.items() if not glob_match(p[1:], n)}
        elif "*" in p:
            chosen |= {n: ix for n, ix in indexes.items() if glob_match(p, n)}
        elif p in indexes:
            chosen[p] = indexes[p]
        else:
            raise QueryError(f"there is no index {p!r}")
    if not chosen:
        raise QueryError("no index matches")
    all_ = list(chosen.values())
    if len({ix.mapping.timestamp for ix in all_}) > 1:
        raise QueryError("the indexes have different timestamp fields")
    kinds: dict[str, str] = {}
    for ix in all_:
        for f in ix.mapping.fields:
            if kinds.setdefault(f.name, f.kind) != f.kind:
                raise QueryError(f"field {f.name!r} has different types")
    df = all_[0].df.withColumn("_index", F.lit(all_[0].name))
    for ix in all_[1:]:
        df = df.unionByName(ix.df.withColumn("_index", F.lit(ix.name)), allowMissingColumns=True)
    return Index(df, all_[0].mapping, ",".join(chosen))

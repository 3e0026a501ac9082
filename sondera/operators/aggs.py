"""Aggregations: a tree of buckets and metrics over the matching documents.

Each path of buckets is one ``groupBy`` with all its metrics.  A level keeps its
top buckets in Spark before the next level is grouped, so what reaches the
driver is bounded by the bucket limit.  All counts are exact.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import QueryError
from ..functions import literals
from ..mapping import Index

MOST_BUCKETS = 65_000
PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
BUCKETS = ("terms", "histogram", "date_histogram", "range")
STATS, EXTENDED = ("count", "sum", "min", "max", "avg"), ("sum_of_squares", "variance", "std_deviation")
METRICS = ("avg", "sum", "min", "max", "value_count", "stats", "extended_stats", "percentiles", "cardinality")


def kind(spec: dict) -> str:
    names = [k for k in spec if k in BUCKETS or k in METRICS]
    if len(names) != 1:
        raise QueryError(f"an aggregation has exactly one kind: {spec!r}")
    if extra := set(spec) - {names[0], "aggs", "aggregations", "meta"}:
        raise QueryError(f"an aggregation does not know {sorted(extra)}")
    if names[0] in METRICS and children(spec):
        raise QueryError("a metric has no sub-aggregations")
    return names[0]


def children(spec: dict) -> dict:
    return spec.get("aggs") or spec.get("aggregations") or {}


def fields(aggs: dict) -> set[str]:
    """All fields that a tree of aggregations reads."""
    out: set[str] = set()
    for spec in aggs.values():
        out |= {spec[kind(spec)]["field"]} | fields(children(spec))
    return out


def _column(index: Index, name: str, numeric: bool = False) -> tuple[Column, bool]:
    r = index.resolve(name)
    if not r.field.fast and index.mapping.get(r.field.name) is not None:
        raise QueryError(f"an aggregation needs {name!r} to be a fast field")
    if r.field.kind == "json":
        v = index.variant(r)
        return (F.try_variant_get(v, r.path, "double") if numeric else F.try_variant_get(v, r.path, "string")), False
    c = r.column
    if r.field.kind == "text" and r.field.normalizer == "lowercase":
        c = F.transform(c, F.lower) if r.field.array else F.lower(c)
    if r.field.kind == "datetime" and numeric:
        c = F.transform(c, lambda x: F.unix_millis(x.cast("timestamp"))) if r.field.array else F.unix_millis(c.cast("timestamp"))
    return c, r.field.array


def bucket_start(value: Column, interval: float, offset: float = 0) -> Column:
    return F.floor((value - offset) / interval) * interval + offset


def _date_spec(p: dict) -> tuple[int, int]:
    if "calendar_interval" in p or "interval" in p:
        raise QueryError("only fixed_interval is supported")
    every = literals.fixed_interval_ms(p["fixed_interval"])
    if every <= 0:
        raise QueryError("an interval is positive")
    return every, literals.fixed_interval_ms(p["offset"]) if p.get("offset") else 0


def range_edges(ranges: list[dict]) -> list[tuple[str, float | None, float | None]]:
    """Named ranges with the gaps and ends between them filled in."""
    def name(a, b):
        return f"{'*' if a is None else _plain(a)}-{'*' if b is None else _plain(b)}"

    given = sorted(((r.get("from"), r.get("to"), r.get("key")) for r in ranges), key=lambda r: -math.inf if r[0] is None else r[0])
    out, at = [], None
    for k, (a, b, key) in enumerate(given):
        if k == 0 and a is not None:
            out.append((name(None, a), None, a))
        elif k and a is not None and at is not None and a > at:
            out.append((name(at, a), at, a))
        elif k and at is not None and a is not None and a < at:
            raise QueryError("ranges overlap")
        out.append((key or name(a, b), a, b))
        at = b
    if at is not None:
        out.append((name(at, None), at, None))
    return out


def _plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def _or_missing(c: Column, array: bool, value: Any) -> Column:
    """The values of a field, or ``value`` where a row has none."""
    if not array:
        return F.coalesce(c, F.lit(value))
    some = F.filter(c, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(value)))


def keyed(index: Index, df: DataFrame, spec: dict, as_name: str) -> DataFrame:
    """The rows with their bucket key; a row of several values has one row for each
    bucket, and a row without a value none."""
    k = kind(spec)
    p = spec[k]
    if k == "terms":
        c, array = _column(index, p["field"])
        if "missing" in p:
            c = _or_missing(c, array, p["missing"])
        df = df.withColumn(as_name, F.explode(F.array_distinct(c)) if array else c)
    elif k in ("histogram", "date_histogram"):
        c, array = _column(index, p["field"], numeric=True)
        if array:
            df = df.withColumn("_v", F.explode(c))
            c = F.col("_v")
        if k == "histogram":
            if p["interval"] <= 0:
                raise QueryError("an interval is positive")
            if "hard_bounds" in p:
                df = df.where((c >= p["hard_bounds"]["min"]) & (c <= p["hard_bounds"]["max"]))
            df = df.withColumn(as_name, bucket_start(c.cast("double"), float(p["interval"]), float(p.get("offset", 0))))
        else:
            every, offset = _date_spec(p)
            if "hard_bounds" in p:
                df = df.where((c >= p["hard_bounds"]["min"]) & (c <= p["hard_bounds"]["max"]))
            df = df.withColumn(as_name, (F.floor((c - offset) / every) * every + offset).cast("long"))
        df = df.drop("_v")
    else:
        c, array = _column(index, p["field"], numeric=True)
        if array:
            df = df.withColumn("_v", F.explode(c))
            c = F.col("_v")
        cases = None
        for name, a, b in range_edges(p["ranges"]):
            inside = c.isNotNull()
            if a is not None:
                inside &= c >= a
            if b is not None:
                inside &= c < b
            cases = F.when(inside, name) if cases is None else cases.when(inside, name)
        df = df.withColumn(as_name, cases).drop("_v")
    return df.where(F.col(as_name).isNotNull())


def metric_columns(index: Index, name: str, spec: dict) -> list[Column]:
    """The aggregate columns of a metric, named ``name`` or ``name.part``; a row of several
    values counts with each of them."""
    k = kind(spec)
    p = spec[k]
    c, array = _column(index, p["field"], numeric=k not in ("value_count", "cardinality"))
    if "missing" in p:
        c = _or_missing(c, array, p["missing"])
    if k == "value_count":
        return [F.coalesce(F.sum(F.size(F.filter(c, lambda x: x.isNotNull()))), F.lit(0)).cast("long").alias(name) if array else F.count(c).alias(name)]
    if k == "cardinality":
        return [F.approx_count_distinct(c, 0.01).alias(name)]
    if array:
        return _array_metric(name, k, F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: x.cast("double")))
    c = c.cast("double")
    one = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if k in one:
        out = one[k](c)
        return [(F.coalesce(out, F.lit(0.0)) if k == "sum" else out).alias(name)]
    parts = {"count": F.count(c), "sum": F.coalesce(F.sum(c), F.lit(0.0)), "min": F.min(c), "max": F.max(c), "avg": F.avg(c)}
    if k == "extended_stats":
        parts |= {"sum_of_squares": F.coalesce(F.sum(c * c), F.lit(0.0)), "variance": F.var_pop(c), "std_deviation": F.stddev_pop(c)}
    return [v.alias(f"{name}.{s}") for s, v in parts.items()]


def _array_metric(name: str, k: str, c: Column) -> list[Column]:
    """As :func:`metric_columns`, of an array column: each row is summed up first."""
    def added(f) -> Column:
        return F.coalesce(F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))), F.lit(0.0))

    n, total = F.coalesce(F.sum(F.when(c.isNotNull(), F.size(c))), F.lit(0)).cast("long"), added(lambda x: x)
    mean = F.when(n > 0, total / n)
    parts = {"count": n, "sum": total, "min": F.min(F.array_min(c)), "max": F.max(F.array_max(c)), "avg": mean}
    if k in parts:
        return [parts[k].alias(name)]
    if k == "extended_stats":
        squares = added(lambda x: x * x)
        variance = F.greatest(squares / n - mean * mean, F.lit(0.0))
        parts |= {"sum_of_squares": squares, "variance": F.when(n > 0, variance), "std_deviation": F.when(n > 0, F.sqrt(variance))}
    return [v.alias(f"{name}.{s}") for s, v in parts.items()]


def _one_by_one(index: Index, spec: dict) -> bool:
    """Whether a metric needs a row for each value."""
    k = kind(spec)
    return k == "percentiles" or (k == "cardinality" and _column(index, spec[k]["field"])[1])


def percentiles(df: DataFrame, keys: list[str], value: Column, percents=PERCENTS) -> DataFrame:
    """Exact percentiles by lower rank: the element floor(q * (n - 1)) of the sorted
    values.  Equal values are counted together before they are ranked."""
    counted = df.where(value.isNotNull()).groupBy(*keys, value.cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counted.withColumn("_to", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    rank = lambda q: F.floor(F.lit(q / 100) * (F.col("_n") - 1))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") > rank(q), F.col("_v"))).alias(f"p{q:g}".replace(".", "_")) for q in percents])


def grouped(index: Index, df: DataFrame, keys: list[str], specs: dict) -> DataFrame:
    """One row per bucket: the keys, ``doc_count`` and all metrics of ``specs``."""
    plain = {n: s for n, s in specs.items() if kind(s) in METRICS and not _one_by_one(index, s)}
    cols = [F.count("*").alias("doc_count")]
    for n, s in plain.items():
        cols += metric_columns(index, n, s)
    out = df.groupBy(*keys).agg(*cols)
    for n, s in specs.items():
        if kind(s) in METRICS and _one_by_one(index, s):
            p = s[kind(s)]
            c, array = _column(index, p["field"], numeric=kind(s) == "percentiles")
            if "missing" in p:
                c = _or_missing(c, array, p["missing"])
            values = df.select(*keys, (F.explode(c) if array else c).alias("_value"))
            if kind(s) == "percentiles":
                got = percentiles(values, keys, F.col("_value"), p.get("percents", PERCENTS))
                got = got.toDF(*keys, *[f"{n}.{q:g}" for q in p.get("percents", PERCENTS)])
            else:
                got = values.groupBy(*keys).agg(F.approx_count_distinct("_value", 0.01).alias(n))
            out = out.join(got, keys, "left") if keys else out.crossJoin(F.broadcast(got))  # one row each
    return out


def _ordered(spec: dict) -> list[Column]:
    """The order of the buckets of a terms aggregation."""
    out = []
    orders = spec["terms"].get("order", {"_count": "desc"})
    for o in orders if isinstance(orders, list) else [orders]:
        for by, way in o.items():
            c = F.col("doc_count") if by == "_count" else F.col("_key") if by == "_key" else F.col(f"`{by}`")
            out.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
    return [*out, F.col("_key").asc()]


def buckets(index: Index, df: DataFrame, spec: dict) -> DataFrame:
    """The buckets of one aggregation as rows: ``_key``, ``doc_count`` and the metrics
    below it, with empty histogram and range buckets, cut to the size of a terms
    aggregation in its order."""
    return _level(index, keyed(index, df, spec, "_key"), [], spec)


def _level(index: Index, rows: DataFrame, parents: list[str], spec: dict) -> DataFrame:
    k = kind(spec)
    p = spec[k]
    metrics = {n: s for n, s in children(spec).items() if kind(s) in METRICS}
    out = grouped(index, rows, [*parents, "_key"], metrics)
    if k == "terms":
        size = p.get("size", 10)
        out = out.where(F.col("doc_count") >= p.get("min_doc_count", 1))
        if parents:
            w = Window.partitionBy(*parents).orderBy(*_ordered(spec))
            return out.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= size).drop("_rank")
        return out.orderBy(*_ordered(spec)).limit(size)
    if k == "range":
        if not parents:
            names = df_of(rows, [(n,) for n, _, _ in range_edges(p["ranges"])], "_key string")
            out = F.broadcast(names).join(out, "_key", "left")
            out = out.fillna(0, ["doc_count"])
        return out
    least = p.get("min_doc_count", 0)
    if least > 0 or parents:
        return out.where(F.col("doc_count") >= least)
    return fill(out, p, k)


def df_of(like: DataFrame, rows: list[tuple], schema: str | StructType) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def fill(out: DataFrame, p: dict, k: str) -> DataFrame:
    """A histogram with its empty buckets between the first and last, and out to the
    extended bounds; an error where these are more than the limit."""
    every, offset = (float(p["interval"]), float(p.get("offset", 0))) if k == "histogram" else _date_spec(p)
    ends = out.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    if "extended_bounds" in p:
        at = [math.floor((p["extended_bounds"][e] - offset) / every) * every + offset for e in ("min", "max")]
        lo, hi = F.least(lo, F.lit(at[0])), F.greatest(hi, F.lit(at[1]))
    n = F.round((hi - lo) / every).cast("long")
    most = F.when(n < MOST_BUCKETS, n).otherwise(F.raise_error(F.lit(f"more than {MOST_BUCKETS} buckets")).cast("long"))
    number = F.explode(F.when(n.isNotNull(), F.sequence(F.lit(0).cast("long"), most)))
    grid = ends.select(lo.alias("_lo"), number.alias("_i")).select((F.col("_lo") + F.col("_i") * every).cast("double" if k == "histogram" else "long").alias("_key"))
    return grid.join(out, "_key", "left").fillna(0, ["doc_count"])


def _metric_result(row: dict, name: str, spec: dict) -> Any:
    k = kind(spec)
    if k in ("stats", "extended_stats"):
        parts = STATS if k == "stats" else STATS + EXTENDED
        return {s: {"count": 0, "sum": 0.0, "sum_of_squares": 0.0}.get(s) if row.get(f"{name}.{s}") is None else row[f"{name}.{s}"] for s in parts}
    if k == "percentiles":
        got = {f"{q:.1f}": row.get(f"{name}.{q:g}") for q in spec[k].get("percents", PERCENTS)}
        return {"values": got if spec[k].get("keyed", True) else [{"key": float(q), "value": v} for q, v in got.items()]}
    value = row.get(name)
    return {"value": {"value_count": 0, "cardinality": 0, "sum": 0.0}.get(k) if value is None else value}


def _rfc3339(ms: int) -> str:
    return literals.format_datetime(ms * 1000)


def run(index: Index, df: DataFrame, aggs: dict) -> dict:
    """The nested result of a tree of aggregations."""
    out: dict[str, Any] = {}
    metrics = {n: s for n, s in aggs.items() if kind(s) in METRICS}
    if metrics:
        row = grouped(index, df, [], metrics).first().asDict()
        out |= {n: _metric_result(row, n, s) for n, s in metrics.items()}
    used = [0]
    for n, s in aggs.items():
        if kind(s) in BUCKETS:
            out[n] = _nested(index, df, s, [], {}, used)[()]
    return out


def _nested(index: Index, df: DataFrame, spec: dict, parents: list[str], _above: dict, used: list[int]) -> dict[tuple, dict]:
    """For each tuple of parent keys the result of the aggregation below it."""
    k = kind(spec)
    p = spec[k]
    key = f"_k{len(parents)}"
    rows = keyed(index, df, spec, "_key")
    level = _level(index, rows, parents, spec)
    got = [r.asDict() for r in level.limit(MOST_BUCKETS + 1).collect()]
    used[0] += len(got)
    if used[0] > MOST_BUCKETS:
        raise QueryError(f"more than {MOST_BUCKETS} buckets")
    by_parent: dict[tuple, list[dict]] = {}
    for r in got:
        by_parent.setdefault(tuple(r[q] for q in parents), []).append(r)
    below = {}
    subs = {n: s for n, s in children(spec).items() if kind(s) in BUCKETS}
    if subs and got:
        kept = df_of(rows, [tuple(r[q] for q in (*parents, "_key")) for r in got], level.select(*parents, F.col("_key")).schema).withColumnRenamed("_key", key)  # at most the bucket limit
        inner = rows.withColumnRenamed("_key", key).join(F.broadcast(kept), [*parents, key], "left_semi")
        below = {n: _nested(index, inner, s, [*parents, key], {}, used) for n, s in subs.items()}
    others: dict[tuple, int] = {}
    if k == "terms":
        total = rows.groupBy(*parents).agg(F.count("*").alias("n")).limit(MOST_BUCKETS).collect()
        others = {tuple(r[q] for q in parents): r["n"] for r in total}
    metrics = {n: s for n, s in children(spec).items() if kind(s) in METRICS}
    results = {}
    for parent, rs in (by_parent or {(): []}).items():
        if k == "range":
            edges = {n: (a, b) for n, a, b in range_edges(p["ranges"])}
            have = {r["_key"]: r for r in rs}
            rs = [have.get(n, {"_key": n, "doc_count": 0}) for n in edges]
        elif k in ("histogram", "date_histogram"):
            rs = _filled(sorted(rs, key=lambda r: r["_key"]), p, k) if parents else sorted(rs, key=lambda r: r["_key"])
            used[0] += sum(r["doc_count"] == 0 for r in rs) if parents else 0
        else:
            rs = _in_order(rs, p)
        items = []
        for r in rs:
            b: dict[str, Any] = {"key": r["_key"], "doc_count": r["doc_count"]}
            if k == "date_histogram":
                b["key_as_string"] = _rfc3339(r["_key"])
            if k == "range":
                a, z = edges[r["_key"]]
                b |= {e: v for e, v in (("from", a), ("to", z)) if v is not None}
            b |= {n: _metric_result(r, n, s) for n, s in metrics.items()}
            for n, res in below.items():
                empty = {"buckets": []} | ({"sum_other_doc_count": 0, "doc_count_error_upper_bound": 0} if kind(subs[n]) == "terms" else {})
                b[n] = res.get((*parent, r["_key"]), empty)
            items.append(b)
        one: dict[str, Any] = {"buckets": items}
        if p.get("keyed"):
            one["buckets"] = {str(b.get("key_as_string", b["key"])): {q: v for q, v in b.items()} for b in items}
        if k == "terms":
            one |= {"sum_other_doc_count": others.get(parent, 0) - sum(b["doc_count"] for b in items), "doc_count_error_upper_bound": 0}
        results[parent] = one
    return results


def _filled(rs: list[dict], p: dict, k: str) -> list[dict]:
    """The buckets of one parent with the empty ones between them, as :func:`fill` adds them."""
    if p.get("min_doc_count", 0) > 0 or not rs:
        return rs
    every, offset = (float(p["interval"]), float(p.get("offset", 0))) if k == "histogram" else _date_spec(p)
    lo, hi = rs[0]["_key"], rs[-1]["_key"]
    if "extended_bounds" in p:
        at = [math.floor((p["extended_bounds"][e] - offset) / every) * every + offset for e in ("min", "max")]
        lo, hi = min(lo, at[0]), max(hi, at[1])
    n = round((hi - lo) / every) + 1
    if n > MOST_BUCKETS:
        raise QueryError(f"more than {MOST_BUCKETS} buckets")
    have = {round((r["_key"] - lo) / every): r for r in rs}
    return [have.get(i, {"_key": lo + i * every, "doc_count": 0}) for i in range(n)]


def _in_order(rs: list[dict], p: dict) -> list[dict]:
    orders = p.get("order", {"_count": "desc"})
    rs = sorted(rs, key=lambda r: (r["_key"] is None, r["_key"]))
    for o in reversed(orders if isinstance(orders, list) else [orders]):
        for by, way in o.items():
            name = {"_count": "doc_count", "_key": "_key"}.get(by, by)
            rs = sorted(rs, key=lambda r: (r.get(name) is None, 0) if r.get(name) is None else (False, r[name]), reverse=way == "desc" and all(r.get(name) is not None for r in rs))
    return rs


def trace_ids(df: DataFrame, trace_id: str, timestamp: str, k: int) -> DataFrame:
    """The k distinct trace ids with the latest spans, and their latest timestamps."""
    return df.groupBy(trace_id).agg(F.max(timestamp).alias("span_timestamp")).orderBy(F.col("span_timestamp").desc(), F.col(trace_id)).limit(k)

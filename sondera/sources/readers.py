"""Sources by type, input formats, and documents checked against a mapping."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import MappingError, QueryError
from ..functions import analysis, scalars
from ..mapping import Field, Mapping

FORMATS = ("json", "plain_text", "otlp_traces_json", "otlp_logs_json", "otlp_traces_proto", "otlp_logs_proto")


def file_source(spark: SparkSession, params: dict, streaming: bool = False) -> DataFrame:
    """Lines of text files, as a column ``value``; of binary formats, a file a message."""
    path = params.get("filepath") or params.get("path")
    if not path:
        raise MappingError("a file source needs a path")
    if streaming:
        r = spark.readStream
        for k in ("maxFilesPerTrigger", "latestFirst"):
            if k in params:
                r = r.option(k, params[k])
        if params.get("binary"):
            return r.format("binaryFile").load(path).select(F.col("content").alias("value"))
        return r.text(path)
    if params.get("binary"):
        return spark.read.format("binaryFile").load(path).select(F.col("content").alias("value"))
    return spark.read.text(path)


def vec_source(spark: SparkSession, params: dict, streaming: bool = False) -> DataFrame:
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in params.get("docs", [])], "value string")


def void_source(spark: SparkSession, params: dict, streaming: bool = False) -> DataFrame:
    return spark.createDataFrame([], "value string")


def ingest_api_source(spark: SparkSession, params: dict, streaming: bool = False) -> DataFrame:
    """The landing folder of the ingest API: files of lines, appended whole."""
    return file_source(spark, {"path": params["landing"], **{k: v for k, v in params.items() if k.startswith("max")}}, streaming)


def kafka_source(spark: SparkSession, params: dict, streaming: bool = False) -> DataFrame:
    """A topic; offsets are kept in the checkpoint of the stream.  Needs Spark's Kafka package."""
    conf = params.get("client_params", {})
    r = (spark.readStream if streaming and not params.get("enable_backfill_mode") else spark.read).format("kafka")
    r = r.option("subscribe", params["topic"]).option("kafka.bootstrap.servers", conf["bootstrap.servers"])
    for k, v in conf.items():
        r = r.option(f"kafka.{k}", v)
    r = r.option("startingOffsets", "earliest" if conf.get("auto.offset.reset", "earliest") == "earliest" else "latest")
    return r.load().select(F.col("value").cast("binary" if params.get("binary") else "string").alias("value"))


def connector(kind: str) -> Callable:
    """Sources that a Spark connector of the same name has to provide."""
    def read(spark: SparkSession, params: dict, streaming: bool = False) -> DataFrame:
        r = (spark.readStream if streaming else spark.read).format(params.get("format", kind))
        for k, v in params.items():
            if k not in ("format", "binary") and not isinstance(v, (dict, list)):
                r = r.option(k, v)
        df = r.load()
        name = "value" if "value" in df.columns else "data"
        return df.select(F.col(name).cast("binary" if params.get("binary") else "string").alias("value"))

    return read


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "file": file_source, "stdin": file_source, "vec": vec_source, "void": void_source, "ingest_api": ingest_api_source, "ingest": ingest_api_source, "kafka": kafka_source,
    "kinesis": connector("aws-kinesis"), "pulsar": connector("pulsar"), "pubsub": connector("pubsub"),
}


def read_source(spark: SparkSession, config: dict, streaming: bool = False) -> DataFrame:
    """Raw lines of a source configuration (``source_type`` and ``params``)."""
    kind = config["source_type"]
    if kind not in SOURCES:
        raise MappingError(f"there is no source type {kind!r}")
    params = config.get("params", {}) | ({"binary": True} if config.get("input_format", "").endswith("_proto") else {})
    return SOURCES[kind](spark, params, streaming)


def register_source(kind: str, reader: Callable[..., DataFrame]) -> None:
    SOURCES[kind] = reader


def decode(raw: DataFrame, input_format: str = "json", column: str = "value") -> DataFrame:
    """Documents as JSON text in a column ``doc``."""
    c = F.col(column)
    if input_format == "json":
        return raw.select(c.alias("doc"))
    if input_format == "plain_text":
        return raw.select(F.to_json(F.struct(c.alias("plain_text"))).alias("doc"))
    from . import otlp, protobuf

    kind, _, written = input_format.rpartition("_")
    if kind in ("otlp_traces", "otlp_logs") and written in ("json", "proto"):
        message, rows = ("Traces", otlp.spans) if kind == "otlp_traces" else ("Logs", otlp.logs)
        text = raw.select(c.alias("value")) if written == "json" else protobuf.to_json(raw, message, column)
        return rows(text).select(F.to_json(F.struct("*")).alias("doc"))
    raise MappingError(f"there is no input format {input_format!r}")


def _cast(v: Column, f: Field, path: str) -> Column:
    """The typed value of a field in a variant; null where it does not fit."""
    one = F.try_variant_get(v, path, "variant")
    kind = F.regexp_extract(F.schema_of_variant(one), r"^\w+", 0)
    text = F.try_variant_get(v, path, "string")
    if f.array:
        items = F.from_json(F.try_variant_get(v, path, "string"), S.ArrayType(S.StringType()))
        single = F.when(kind != "ARRAY", F.array(text))
        return F.transform(F.coalesce(single, items), lambda x: _scalar(x, f))
    if f.kind == "text":
        return F.when(kind == "STRING", text)
    if f.kind == "bool":
        return F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
    if f.kind in ("i64", "u64", "f64") and not f.coerce:
        return F.when(kind != "STRING", scalars.coerce_number(text, f.kind))
    if f.kind == "json":
        return F.when(kind == "OBJECT", F.to_json(one))
    return F.when(~kind.isin("OBJECT", "ARRAY", "BOOLEAN"), _scalar(text, f))


def _scalar(text: Column, f: Field) -> Column:
    if f.kind in ("i64", "u64", "f64"):
        return scalars.coerce_number(text, f.kind)
    if f.kind == "datetime":
        return scalars.truncate_datetime(scalars.parse_datetime(text, f.input_formats), f.precision)
    if f.kind == "ip":
        return scalars.ip_to_hex(text)
    if f.kind == "bytes":
        return scalars.decode_bytes(text, "hex" if "hex" in f.input_formats else "base64")
    if f.kind == "bool":
        return text.try_cast("boolean")
    return text


def parse(docs: DataFrame, mapping: Mapping, doc: str = "doc") -> DataFrame:
    """Typed documents with a column ``_error`` that says why a document is rejected.

    A field that does not fit its type, a missing timestamp, text that is no JSON
    object, and in strict mode an unknown field reject the document; in dynamic
    mode unknown fields are kept in ``_dynamic``.
    """
    df = docs.withColumn("_v", F.try_parse_json(F.col(doc)))
    v = F.col("_v")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    cols, errors = [], [F.when(~is_object, F.lit("not a JSON object"))]

    def walk(fields, prefix):
        out = []
        for f in fields:
            path = f"{prefix}['{f.name}']"
            if f.kind == "object":
                out.append(F.struct(*walk(f.fields, path)).alias(f.name))
                continue
            one = F.try_variant_get(v, path, "variant")
            present = one.isNotNull() & (F.schema_of_variant(one) != "VOID")
            c = _cast(v, f, path)
            kind = F.schema_of_variant(one)
            if not f.array:
                errors.append(F.when(is_object & present & kind.startswith("ARRAY"), F.lit(f"{f.name}: an array for a single value")))
            bad = c.isNull() if not f.array else F.exists(c, lambda x: x.isNull())
            errors.append(F.when(is_object & present & F.coalesce(bad, F.lit(True)), F.lit(f"{f.name}: no {f.kind}")))
            if f.name == mapping.timestamp and prefix == "$":
                errors.append(F.when(is_object & ~F.coalesce(present, F.lit(False)), F.lit("the timestamp is missing")))
            out.append(c.alias(f.name))
            if f.tokens:
                run = analysis.tokenizer(f.tokenizer)
                out.append((F.flatten(F.transform(c, run)) if f.array else run(c)).alias(f.tokens))
        return out

    cols = walk(mapping.fields, "$")
    known = [f.name for f in mapping.fields]
    entries = F.from_json(F.col(doc), S.MapType(S.StringType(), S.StringType()))
    unknown = F.map_filter(entries, lambda k, _: ~k.isin(*known)) if known else entries
    if mapping.mode == "strict":
        errors.append(F.when(is_object & (F.size(unknown) > 0), F.concat(F.lit("unknown fields: "), F.array_join(F.array_sort(F.map_keys(unknown)), ","))))
    if mapping.mode == "dynamic":
        # The remainder is cut from the parsed document so that its types stay.
        pairs = F.transform(F.map_entries(unknown), lambda e: F.concat(F.lit('"'), F.replace(F.replace(e["key"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'), F.coalesce(F.when(F.try_parse_json(e["value"]).isNotNull() & ~e["value"].rlike('^"'), e["value"]), F.to_json(e["value"].cast("variant")))))
        cols.append(F.when(F.size(unknown) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).alias("_dynamic"))
    if mapping.store_source:
        cols.append(F.col(doc).alias("_source"))
    return df.select(*cols, F.coalesce(*errors).alias("_error"))


def bulk(body: str, default_index: str | None = None) -> list[tuple[str, str]]:
    """(index, document) pairs of a bulk request: an action line, then a document line."""
    lines = [ln for ln in body.split("\n") if ln.strip()]
    out = []
    for i in range(0, len(lines), 2):
        action = json.loads(lines[i])
        ((name, meta),) = action.items()
        if name not in ("create", "index"):
            raise QueryError(f"bulk action {name!r} is not supported")
        index = meta.get("_index") or default_index
        if not index:
            raise QueryError("a bulk action names no index")
        if i + 1 >= len(lines):
            raise QueryError("a bulk action has no document")
        out.append((index, lines[i + 1]))
    return out


def bulk_bodies(df: DataFrame, body: str, default_index: str | None = None) -> DataFrame:
    """As :func:`bulk`, of a column of bodies: a row (name, doc) for each pair of lines.
    Other actions, and actions without an index or a document, are errors."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    pairs = F.transform(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(2)), lambda i: F.struct(F.get("_lines", i).alias("action"), F.get("_lines", i + 1).alias("doc")))
    out = df.select(lines.alias("_lines")).where(F.size("_lines") > 0).select(F.explode(pairs).alias("_p")).select("_p.action", "_p.doc")
    meta = [F.from_json("action", f"{name} map<string,string>")[name] for name in ("index", "create")]
    known = F.coalesce(*meta)
    wrong = lambda text: F.raise_error(F.concat(F.lit(text), "action")).cast("string")
    name = F.coalesce(F.element_at(known, "_index"), F.lit(default_index))
    name = F.when(known.isNull(), wrong("this bulk action is not supported: ")).when(F.col("doc").isNull(), wrong("a bulk action has no document: ")).when(name.isNull(), wrong("a bulk action names no index: ")).otherwise(name)
    return out.select(name.alias("name"), "doc")

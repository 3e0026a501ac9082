"""Index mappings: field types and options, schema modes, and field resolution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .errors import MappingError, QueryError
from .functions import analysis

KINDS = ("text", "i64", "u64", "f64", "bool", "datetime", "ip", "bytes", "json", "object")
RESERVED = ("_source", "_dynamic", "_field_presence")
_NAME = re.compile(r"[_\-a-zA-Z][_.\-a-zA-Z0-9]{0,254}")
_SPARK = {"text": S.StringType(), "i64": S.LongType(), "u64": S.DecimalType(20, 0), "f64": S.DoubleType(), "bool": S.BooleanType(), "datetime": S.TimestampType(), "ip": S.StringType(), "bytes": S.BinaryType(), "json": S.StringType()}


@dataclass(frozen=True)
class Field:
    """One mapped field.  ``tokens`` names a column of ready token arrays."""

    name: str
    kind: str
    array: bool = False
    tokenizer: str | dict = "default"
    record: str = "basic"
    fieldnorms: bool = False
    fast: bool = True
    normalizer: str = "raw"
    indexed: bool = True
    stored: bool = True
    input_formats: tuple[str, ...] = ("rfc3339", "unix_timestamp")
    output_format: str = "rfc3339"
    precision: str = "microseconds"
    coerce: bool = True
    expand_dots: bool = True
    tokens: str | None = None
    fields: tuple[Field, ...] = ()

    def __post_init__(self):
        check_name(self.name)
        if self.kind not in KINDS:
            raise MappingError(f"there is no type {self.kind!r}")
        if self.record not in ("basic", "freq", "position"):
            raise MappingError(f"there is no record option {self.record!r}")
        if self.array and self.kind == "object":
            raise MappingError("arrays of objects are not supported")

    @property
    def spark_type(self) -> S.DataType:
        base = S.StructType([S.StructField(f.name, f.spark_type) for f in self.fields]) if self.kind == "object" else _SPARK[self.kind]
        return S.ArrayType(base) if self.array else base


def check_name(name: str) -> None:
    if not _NAME.fullmatch(name) or name in RESERVED:
        raise MappingError(f"{name!r} is no field name")


def parse_field(config: dict) -> Field:
    """A field from its JSON form."""
    c = dict(config)
    kind = c.pop("type")
    array = kind.startswith("array<") and kind.endswith(">")
    if array:
        kind = kind[6:-1]
    fast = c.pop("fast", kind != "text")
    normalizer = fast.get("normalizer", "raw") if isinstance(fast, dict) else "raw"
    known = {"name", "tokenizer", "record", "fieldnorms", "indexed", "stored", "input_formats", "output_format", "coerce", "expand_dots", "tokens"}
    out = {k: c.pop(k) for k in list(c) if k in known}
    if "fast_precision" in c:
        out["precision"] = c.pop("fast_precision")
    subs = tuple(parse_field(f) for f in c.pop("field_mappings", []))
    c.pop("description", None)
    if c:
        raise MappingError(f"unknown options of field {config.get('name')!r}: {sorted(c)}")
    if "input_formats" in out:
        out["input_formats"] = tuple(out["input_formats"])
    return Field(kind=kind, array=array, fast=bool(fast), normalizer=normalizer, fields=subs, **out)


@dataclass(frozen=True)
class Mapping:
    """The fields of an index, its mode and its special fields."""

    fields: tuple[Field, ...] = ()
    mode: str = "dynamic"
    timestamp: str | None = None
    tags: tuple[str, ...] = ()
    default_fields: tuple[str, ...] = ()
    dynamic_tokenizer: str | dict = "raw"
    store_source: bool = False
    partition_key: str | None = None
    max_partitions: int = 200
    id_column: str | None = None
    tokenizers: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        if self.mode not in ("dynamic", "lenient", "strict"):
            raise MappingError(f"there is no mode {self.mode!r}")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise MappingError("a field is mapped twice")
        if self.timestamp:
            f = self.get(self.timestamp)
            if f is None or f.kind != "datetime" or f.array or not f.fast:
                raise MappingError("the timestamp field must be a single-valued fast datetime")
        for t in self.tags:
            f = self.get(t)
            if f is None or not f.indexed or not (f.kind in ("i64", "u64", "bool") or (f.kind == "text" and f.tokenizer == "raw")):
                raise MappingError(f"{t!r} cannot be a tag field")

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @classmethod
    def parse(cls, config: dict) -> Mapping:
        """From the ``doc_mapping`` and ``search_settings`` of an index configuration."""
        d = config.get("doc_mapping", config)
        named = {t["name"]: {k: v for k, v in t.items() if k != "name"} for t in d.get("tokenizers", [])}
        fields = []
        for c in d.get("field_mappings", []):
            if isinstance(c.get("tokenizer"), str) and c["tokenizer"] in named:
                c = c | {"tokenizer": named[c["tokenizer"]]}
            fields.append(parse_field(c))
        return cls(
            tuple(fields), d.get("mode", "dynamic"), d.get("timestamp_field"), tuple(d.get("tag_fields", [])), tuple(config.get("search_settings", {}).get("default_search_fields", [])),
            (d.get("dynamic_mapping") or {}).get("tokenizer", "raw"), d.get("store_source", False), d.get("partition_key"), d.get("max_num_partitions", 200), tokenizers=named,
        )

    def schema(self) -> S.StructType:
        return S.StructType([S.StructField(f.name, f.spark_type) for f in self.fields])


def kind_of(t: S.DataType) -> tuple[str, bool]:
    """The field kind that a Spark type stands for, and whether it is an array."""
    if isinstance(t, S.ArrayType):
        return kind_of(t.elementType)[0], True
    if isinstance(t, (S.LongType, S.IntegerType, S.ShortType, S.ByteType)):
        return "i64", False
    if isinstance(t, S.DecimalType):
        return ("u64" if t.scale == 0 else "f64"), False
    if isinstance(t, (S.DoubleType, S.FloatType)):
        return "f64", False
    if isinstance(t, S.BooleanType):
        return "bool", False
    if isinstance(t, (S.TimestampType, S.TimestampNTZType, S.DateType)):
        return "datetime", False
    if isinstance(t, S.BinaryType):
        return "bytes", False
    if isinstance(t, S.StructType):
        return "object", False
    if isinstance(t, S.VariantType):
        return "json", False
    return "text", False


@dataclass(frozen=True)
class Resolved:
    """A field of a query: its column, its mapping, and the JSON path in it."""

    field: Field
    column: Column
    path: str | None = None
    variant: bool = False


class Index:
    """A DataFrame with a mapping; what queries are run against.  ``stats`` are term
    statistics written for it, which scores then use."""

    def __init__(self, df: DataFrame, mapping: Mapping | None = None, name: str = "index", stats=None):
        self.df, self.mapping, self.name, self.stats = df, mapping or Mapping(), name, stats
        self._types = {f.name: f.dataType for f in df.schema.fields}

    def with_df(self, df: DataFrame) -> Index:
        return Index(df, self.mapping, self.name, self.stats)

    @property
    def id(self) -> str:
        """The column that orders documents and breaks ties."""
        if self.mapping.id_column:
            return self.mapping.id_column
        for f in self.df.schema.fields:
            if f.name in ("_id", "doc_id", "id") or f.name.endswith("_id"):
                return f.name
        return self.df.columns[0]

    def _field(self, name: str) -> Field | None:
        f = self.mapping.get(name)
        if f is not None:
            return f
        if name in self._types and self.mapping.mode == "dynamic":
            kind, array = kind_of(self._types[name])
            return Field(name, kind, array, self.mapping.dynamic_tokenizer if kind == "text" else "raw")
        return None

    @staticmethod
    def split_path(path: str) -> list[str]:
        """Parts of a dotted path; a backslash keeps a dot."""
        return [p.replace("\0", ".") for p in path.replace("\\.", "\0").split(".")]

    def resolve(self, path: str) -> Resolved:
        """The longest mapped field, then a path inside it, then the dynamic remainder."""
        parts = self.split_path(path)
        for n in range(len(parts), 0, -1):
            name = ".".join(parts[:n])
            f = self._field(name)
            if f is None:
                continue
            column, rest = F.col(f"`{name}`"), parts[n:]
            at = self._types.get(name)
            while rest and f.kind == "object":
                sub = next((s for s in f.fields if s.name == rest[0]), None)
                if sub is None and isinstance(at, S.StructType) and rest[0] in at.fieldNames():
                    kind, array = kind_of(at[rest[0]].dataType)
                    sub = Field(rest[0], kind, array, self.mapping.dynamic_tokenizer if kind == "text" else "raw")
                if sub is None:
                    raise QueryError(f"there is no field {path!r}")
                column, f, at = column.getField(rest[0]), sub, at[rest[0]].dataType if isinstance(at, S.StructType) else None
                rest = rest[1:]
            if rest and f.kind not in ("json", "text"):
                continue
            if rest or f.kind == "json":
                if not rest:
                    return Resolved(f, column, "$", isinstance(at, S.VariantType))
                keys = "".join(f"['{r}']" if not re.fullmatch(r"\w+", r) else f".{r}" for r in rest)
                return Resolved(Field(f.name, "json", tokenizer=f.tokenizer if f.kind == "json" else "raw"), column, "$" + keys, isinstance(at, S.VariantType))
            return Resolved(f, column)
        if "_dynamic" in self._types and self.mapping.mode == "dynamic":
            keys = "".join(f"['{r}']" if not re.fullmatch(r"\w+", r) else f".{r}" for r in parts)
            return Resolved(Field("dynamic", "json", tokenizer=self.mapping.dynamic_tokenizer), F.col("_dynamic"), "$" + keys, isinstance(self._types["_dynamic"], S.VariantType))
        raise QueryError(f"there is no field {path!r}")

    def column_of(self, path: str) -> str:
        """The column of the table that a field is in."""
        parts = self.split_path(path)
        for n in range(len(parts), 0, -1):
            if (name := ".".join(parts[:n])) in self._types:
                return name
        if "_dynamic" in self._types:
            return "_dynamic"
        raise QueryError(f"there is no field {path!r}")

    def variant(self, r: Resolved) -> Column:
        return r.column if r.variant else F.try_parse_json(r.column)

    def tokens(self, r: Resolved) -> Column:
        """The token array of a text field; ready-made where the index holds one."""
        f = r.field
        if f.tokens and f.tokens in self._types:
            return F.col(f.tokens)
        run = analysis.tokenizer(f.tokenizer)
        if r.path is not None:
            return run(F.try_variant_get(self.variant(r), r.path, "string"))
        if f.array:
            return F.flatten(F.transform(r.column, run))
        return run(r.column)

"""Tokenizers as column expressions; only stemming and source code take an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..errors import MappingError
from .porter import stem

LONGEST = 255
_TOKENS = ArrayType(StringType())
#: Han, kana, Hangul and full-width forms: a token each in ``chinese_compatible``.
_CJK = r"぀-ヿ㐀-䶿一-鿿가-힯豈-﫿ｦ-ﾟ"
_FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿĀāĂăĄąĆćČčĎďĐđĒēĖėĘęĚěĞğĪīĮįİıŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŲųŹźŻżŽž"
_FOLD_TO = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyyAaAaAaCcCcDdDdEeEeEeEeGgIiIiIiLlNnNnOoOoRrSsSsSsTtUuUuUuUuZzZzZz"


def remove_long(tokens: Column, longest: int = LONGEST) -> Column:
    return F.filter(tokens, lambda t: F.octet_length(t) <= longest)


def lower_caser(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def ascii_folding(tokens: Column) -> Column:
    def fold(t: Column) -> Column:
        t = F.translate(t, _FOLD_FROM, _FOLD_TO)
        for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("ð", "d")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    return F.transform(tokens, fold)


def raw(c: Column) -> Column:
    return F.when(F.octet_length(c) <= LONGEST, F.array(c)).otherwise(F.array().cast("array<string>"))


def lowercase(c: Column) -> Column:
    return raw(F.lower(c))


def _split(c: Column, pattern: str) -> Column:
    return F.filter(F.split(c, pattern), lambda t: t != "")


def simple(c: Column) -> Column:
    return _split(c, r"[^\p{L}\p{N}]+")


def default(c: Column) -> Column:
    return remove_long(_split(F.lower(c), r"[^\p{L}\p{N}]+"))


def whitespace(c: Column) -> Column:
    return remove_long(_split(c, r"\s+"))


def chinese_compatible(c: Column) -> Column:
    return remove_long(F.regexp_extract_all(F.lower(c), F.lit(rf"([{_CJK}]|[\p{{L}}\p{{N}}&&[^{_CJK}]]+)")))


def ngram(c: Column, least: int, most: int, prefix_only: bool = False) -> Column:
    """Character n-grams by start, then by length."""
    if not 0 < least <= most:
        raise MappingError("an n-gram tokenizer needs 0 < min_gram <= max_gram")
    size = F.char_length(c)
    last = F.lit(1) if prefix_only else size - least + 1
    starts = F.when(size >= least, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(least), F.least(F.lit(most), size - i + 1)), lambda n: F.substring(c, i, n))

    return F.flatten(F.transform(starts, at))


def regex(c: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), lambda t: t != "")


_CODE = re.compile(r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+|[^\W\d_a-zA-Z]+")


def split_code(text: str) -> list[str]:
    """Identifiers cut at case changes, digits and delimiters, lower-cased."""
    return [m.lower() for m in _CODE.findall(text) if len(m.encode()) <= LONGEST]


#: Python has the objects of about so many tokens at a time, however many a batch has.
_SLICE = 1 << 16


def _lists(like: pa.Array, lengths: pa.Array, tokens: list[pa.Array]) -> pa.Array:
    """Lists of the given lengths over the tokens, null where ``like`` is."""
    ends = pc.cumulative_sum(lengths.fill_null(0)).to_numpy().astype("int32")
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pa.array(ends)])
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays(tokens), mask=like.is_null())


def split_codes(texts: pa.Array) -> pa.Array:
    """:func:`split_code` of each text, without Python objects for more than a slice of them."""
    tokens, lengths, found = [], [], []
    for t in texts:
        of = split_code(t.as_py()) if t.is_valid else []
        lengths.append(len(of))
        found += of
        if len(found) >= _SLICE:
            tokens.append(pa.array(found, texts.type))
            found = []
    tokens.append(pa.array(found, texts.type))
    return _lists(texts, pa.array(lengths, pa.int32()), tokens)


def stems(lists: pa.Array) -> pa.Array:
    """The stems of the tokens in each list, without Python objects for other than the different tokens of a slice."""
    flat = lists.flatten()
    tokens = [pa.array([], flat.type)]
    for at in range(0, len(flat), _SLICE):
        coded = flat.slice(at, _SLICE).dictionary_encode()
        tokens.append(pa.array([None if t is None else stem(t) for t in coded.dictionary.to_pylist()], flat.type).take(coded.indices))
    return _lists(lists, pc.list_value_length(lists), tokens)


@F.arrow_udf(_TOKENS)
def _source_code(c: pa.Array) -> pa.Array:
    return split_codes(c)


@F.arrow_udf(_TOKENS)
def _stem(c: pa.Array) -> pa.Array:
    return stems(c)


def source_code_default(c: Column) -> Column:
    return _source_code(F.translate(c, _FOLD_FROM, _FOLD_TO))


def stemmed(tokens: Column) -> Column:
    return _stem(tokens)


def en_stem(c: Column) -> Column:
    return stemmed(default(c))


def multilang_default(c: Column) -> Column:
    """A language prefix is dropped; CJK characters stand alone, other words as in ``default``."""
    return chinese_compatible(F.regexp_replace(c, r"^(?:CMN|ENG|JPN|KOR):", ""))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "raw": raw, "lowercase": lowercase, "default": default, "en_stem": en_stem, "whitespace": whitespace, "chinese_compatible": chinese_compatible,
    "source_code_default": source_code_default, "source_code_with_hex": source_code_default, "multilang_default": multilang_default, "simple": simple,
}
FILTERS = {"remove_long": remove_long, "lower_caser": lower_caser, "ascii_folding": ascii_folding}
NORMALIZERS: dict[str, Callable[[Column], Column]] = {"raw": lambda c: c, "lowercase": F.lower}


def tokenizer(config: str | dict) -> Callable[[Column], Column]:
    """A tokenizer by its name, or from a definition with type, parameters and filters."""
    if isinstance(config, str):
        if config not in TOKENIZERS:
            raise MappingError(f"there is no tokenizer {config!r}")
        return TOKENIZERS[config]
    kind = config.get("type")
    if kind == "ngram":
        base = lambda c: ngram(c, config["min_gram"], config["max_gram"], config.get("prefix_only", False))
    elif kind == "regex":
        base = lambda c: regex(c, config["pattern"])
    elif kind in ("simple", "multilang", "source_code", "chinese_compatible"):
        base = {"simple": simple, "multilang": multilang_default, "source_code": source_code_default, "chinese_compatible": chinese_compatible}[kind]
    else:
        raise MappingError(f"there is no tokenizer type {kind!r}")
    for f in config.get("filters", []):
        if f not in FILTERS:
            raise MappingError(f"there is no token filter {f!r}")
    def run(c: Column) -> Column:
        out = base(c)
        for f in config.get("filters", []):
            out = FILTERS[f](out)
        return out

    return run


_PY = {
    "default": lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x and len(x.encode()) <= LONGEST], "raw": lambda t: [t], "lowercase": lambda t: [t.lower()], "whitespace": lambda t: t.split(),
    "source_code_default": split_code, "source_code_with_hex": split_code, "en_stem": lambda t: [stem(x) for x in re.split(r"[\W_]+", t.lower()) if x], "simple": lambda t: [x for x in re.split(r"[\W_]+", t) if x],
}


def query_tokens(text: str, name: str | dict) -> list[str]:
    """The tokens of a query's own text, made on the driver as the field's tokenizer would."""
    if isinstance(name, str) and name in _PY:
        return _PY[name](text)
    if name in ("chinese_compatible", "multilang_default"):
        return re.findall(rf"[{_CJK}]|[^\W_{_CJK}]+", text.lower())
    if isinstance(name, dict):
        kind = name["type"]
        if kind == "ngram":
            lo, hi = name["min_gram"], name["max_gram"]
            starts = range(1 if name.get("prefix_only") else max(len(text) - lo + 1, 0))
            out = [text[i : i + n] for i in starts for n in range(lo, min(hi, len(text) - i) + 1)]
        elif kind == "regex":
            out = [m.group(0) for m in re.finditer(name["pattern"], text) if m.group(0)]
        elif kind == "source_code":
            out = split_code(text)
        else:
            out = query_tokens(text, "simple")
        if "lower_caser" in name.get("filters", []):
            out = [t.lower() for t in out]
        if "ascii_folding" in name.get("filters", []):
            table = str.maketrans(_FOLD_FROM, _FOLD_TO)
            out = [t.translate(table) for t in out]
        return out
    raise MappingError(f"there is no tokenizer {name!r}")


def analyze(df: DataFrame, column: str, config: str | dict, *keep: str) -> DataFrame:
    """A row per token: the columns to keep, position and token."""
    return df.select(*keep, F.posexplode(tokenizer(config)(F.col(column))).alias("position", "token"))

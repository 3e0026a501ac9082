"""Value functions of ingestion and output, as column expressions."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

_PATTERNS = {
    "rfc3339": ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"],
    "iso8601": ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX][X]", "yyyy-MM-dd'T'HH:mm[XXX]", "yyyy-MM-dd"],
    "rfc2822": ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z"],
}
_STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%z": "Z", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%f": "SSSSSS", "%I": "hh", "%p": "a", "%%": "%"}


def floor_div(n: Column, by: int) -> Column:
    """Whole division of 64-bit integers, which a division of doubles is not."""
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


def spark_pattern(strptime: str) -> str:
    """A strptime pattern as Spark writes it."""
    out, i = [], 0
    while i < len(strptime):
        two = strptime[i : i + 2]
        if two in _STRPTIME:
            out.append(_STRPTIME[two])
            i += 2
        else:
            c = strptime[i]
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            i += 1
    return "".join(out)


def timestamp_of_number(n: Column) -> Column:
    """A unix timestamp whose unit is told by its magnitude."""
    a = F.abs(n)
    low, high = 72_057_595, 8_589_934_591
    return (
        F.when(a.between(low, high), F.timestamp_seconds(n))
        .when(a.between(low * 1000, high * 1000 + 999), F.timestamp_millis(n))
        .when(a.between(low * 1_000_000, high * 1_000_000 + 999_999), F.timestamp_micros(n))
        .when(a >= F.lit(low).cast("decimal(20,0)") * 1_000_000_000, F.timestamp_micros(floor_div(n.try_cast("long"), 1000)))
    )


def parse_datetime(c: Column, formats: Sequence[str] = ("rfc3339", "unix_timestamp")) -> Column:
    """The first format that fits; null where none does."""
    tried = []
    for f in formats:
        if f == "unix_timestamp":
            whole = F.when(c.rlike(r"^-?\d+$"), c.try_cast("long"))
            part = F.when(c.rlike(r"^-?\d+\.\d+$"), F.timestamp_micros((c.try_cast("decimal(30,9)") * 1_000_000).cast("long")))
            tried += [timestamp_of_number(whole), part]
        else:
            if "%a" in f or "%A" in f:
                raise QueryError(f"{f!r}: names of weekdays can be written but not read")
            # The weekday says nothing that the date does not.
            text = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "") if f == "rfc2822" else c
            for p in _PATTERNS.get(f) or [spark_pattern(f)]:
                tried.append(F.try_to_timestamp(text, F.lit(p)))
    return F.coalesce(*tried)


def format_datetime(ts: Column, fmt: str = "rfc3339") -> Column:
    units = {"unix_timestamp_secs": F.unix_seconds, "unix_timestamp_millis": F.unix_millis, "unix_timestamp_micros": F.unix_micros}
    if fmt in units:
        return units[fmt](ts)
    if fmt == "unix_timestamp_nanos":
        return F.unix_micros(ts) * 1000
    if fmt in ("rfc3339", "iso8601"):
        whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
        frac = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
        return F.concat(whole, F.when(frac == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(frac.cast("string"), 6, "0"), F.lit("0")))), F.lit("Z"))
    if fmt == "rfc2822":
        return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")
    return F.date_format(ts, spark_pattern(fmt))


def truncate_datetime(ts: Column, precision: str) -> Column:
    if precision in ("microseconds", "nanoseconds"):
        return ts
    unit = {"seconds": "second", "milliseconds": "millisecond", "minutes": "minute", "hours": "hour", "days": "day"}.get(precision)
    if unit is None:
        raise QueryError(f"there is no precision {precision!r}")
    return F.date_trunc(unit, ts)


def decode_bytes(c: Column, fmt: str = "base64") -> Column:
    """Bytes of hexadecimal or base64 text, padded or not; null where it is neither."""
    if fmt == "hex":
        return F.try_to_binary(c, F.lit("hex"))
    padded = F.rpad(F.rtrim(c, F.lit("=")), (F.ceil(F.length(F.rtrim(c, F.lit("="))) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64"))


def encode_bytes(c: Column, fmt: str = "base64") -> Column:
    return F.lower(F.hex(c)) if fmt == "hex" else F.base64(c)


def coerce_number(c: Column, kind: str, coerce: bool = True) -> Column:
    """A number of the kind from text or a number; null where it is none."""
    t = {"i64": "bigint", "u64": "decimal(20,0)", "f64": "double"}[kind]
    text = c.cast("string")
    if kind == "f64":
        out = text.try_cast("double")
        out = F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)
    else:
        out = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(t))
        if kind == "u64":
            out = F.when((out >= 0) & (out <= F.lit("18446744073709551615").cast("decimal(20,0)")), out)
    return out if coerce else F.when(~text.rlike("[\"']"), out)


def output_number(c: Column, fmt: str = "number") -> Column:
    return c.cast("string") if fmt == "string" else c


def ip_to_hex(c: Column) -> Column:
    """32 hexadecimal digits of an IPv4 address mapped into IPv6, or of a full IPv6 address."""
    parts = F.split(c, r"\.")
    v4 = F.when(
        c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255),
        F.concat(F.lit("0" * 20 + "ffff"), F.array_join(F.transform(parts, lambda p: F.lower(F.lpad(F.hex(p.try_cast("int")), 2, "0"))), "")),
    )
    # A double colon stands for as many zero groups as are missing.
    filled = F.when(
        c.contains("::"),
        F.concat_ws(":", F.split_part(c, F.lit("::"), F.lit(1)), F.array_join(F.array_repeat(F.lit("0"), 8 - F.size(F.filter(F.split(c, ":"), lambda p: p != ""))), ":"), F.split_part(c, F.lit("::"), F.lit(2))),
    ).otherwise(c)
    groups = F.filter(F.split(filled, ":"), lambda p: p != "")
    v6 = F.when(c.contains(":") & (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.array_join(F.transform(groups, lambda g: F.lower(F.lpad(g, 4, "0"))), ""))
    return F.coalesce(v4, v6)


def json_path(parts: Sequence[str]) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" if not p.isidentifier() else f".{p}" for p in parts)


def expand_dots(name: str) -> list[str]:
    """Keys with dots are nested keys, but for escaped dots."""
    return [p.replace("\0", ".") for p in name.replace("\\.", "\0").split(".")]


def hash_mod(n: int, *cols: Column) -> Column:
    if n < 1:
        raise QueryError("hash_mod needs at least one bucket")
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def glob_match(pattern: str, name: str, stars: int | None = None) -> bool:
    """Names against patterns of asterisks; ``stars`` bounds how many there may be."""
    if stars is not None and pattern.count("*") > stars:
        raise QueryError(f"{pattern!r} has more than {stars} asterisk")
    literal = pattern.replace("[", "[[]").replace("?", "[?]")
    return fnmatch.fnmatchcase(name, literal)


def span_fingerprint(service: Column, kind: Column, name: Column) -> Column:
    return F.concat(service, F.lit("\0"), kind.cast("string"), F.lit("\0"), name)

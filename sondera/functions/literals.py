"""Literals of queries, dates and durations, coerced on the driver."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import ipaddress
import math
import re
from decimal import Decimal
from email.utils import parsedate_to_datetime

from ..errors import QueryError

UTC = dt.UTC
EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)
#: Integer timestamps are read by magnitude between these seconds.
FIRST_S, LAST_S = 72_057_595, 8_589_934_591
PRECISIONS = {"seconds": 1_000_000, "milliseconds": 1_000, "microseconds": 1, "nanoseconds": 1}
_UNITS = {"ns": 1e-6, "us": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_LONG = {
    "millisecond": "ms", "msec": "ms", "millis": "ms", "second": "s", "sec": "s", "minute": "m", "min": "m", "hour": "h", "hr": "h", "day": "d",
    "week": 7, "w": 7, "month": 30.44, "M": 30.44, "year": 365.25, "y": 365.25,
}


def micros(t: dt.datetime) -> int:
    if t.tzinfo is None:
        t = t.replace(tzinfo=UTC)
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def from_micros(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


def unit_of(n: int) -> int:
    """Microseconds of one unit of an integer timestamp, told by its magnitude."""
    for unit in (1_000_000, 1_000, 1):
        if FIRST_S <= abs(n) * unit // 1_000_000 <= LAST_S:
            return unit
    if FIRST_S <= abs(n) // 1_000_000_000 <= LAST_S:
        return 0  # nanoseconds
    raise QueryError(f"the unit of timestamp {n} cannot be told")


def timestamp_micros(n: int | float) -> int:
    """A unix timestamp in any unit as microseconds; a float is in seconds."""
    if isinstance(n, float):
        return round(n * 1_000_000)
    unit = unit_of(n)
    return n * unit if unit else n // 1000


_ISO = re.compile(r"(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2})(?:[T ](\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?)?)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?")


def parse_datetime(value: str | int | float, formats: list[str] | None = None) -> int:
    """Microseconds of a date given as text or number; the first matching format wins."""
    if isinstance(value, bool):
        raise QueryError("a boolean is no date")
    if isinstance(value, (int, float)):
        return timestamp_micros(value)
    text = value.strip()
    for f in formats or ["rfc3339", "iso8601", "rfc2822", "unix_timestamp"]:
        try:
            if f in ("rfc3339", "iso8601"):
                m = _ISO.fullmatch(text)
                if not m:
                    continue
                y, mo, d, h, mi, s, frac, zone = m.groups()
                t = dt.datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0").ljust(6, "0")[:6]), tzinfo=UTC)
                if zone and zone not in "Zz":
                    off = dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
                    t -= off if zone[0] == "+" else -off
                return micros(t)
            if f == "rfc2822":
                return micros(parsedate_to_datetime(text))
            if f == "unix_timestamp":
                return timestamp_micros(float(text) if "." in text else int(text))
            return micros(dt.datetime.strptime(text, f))
        except (ValueError, TypeError, OverflowError):
            continue
    raise QueryError(f"{value!r} is no date in {formats or 'a known format'}")


def truncate(us: int, precision: str) -> int:
    return us - us % PRECISIONS[precision]


def format_datetime(us: int, fmt: str = "rfc3339") -> str | int:
    """A date in one of the output formats."""
    t = from_micros(us)
    if fmt in ("rfc3339", "iso8601"):
        return t.strftime("%Y-%m-%dT%H:%M:%S") + (f".{us % 1_000_000:06d}".rstrip("0") if us % 1_000_000 else "") + "Z"
    if fmt == "rfc2822":
        return t.strftime("%a, %d %b %Y %H:%M:%S +0000")
    units = {"unix_timestamp_secs": 1_000_000, "unix_timestamp_millis": 1_000, "unix_timestamp_micros": 1}
    if fmt in units:
        return us // units[fmt]
    if fmt == "unix_timestamp_nanos":
        return us * 1000
    return t.strftime(fmt)


def fixed_interval_ms(text: str) -> int:
    """``10ms``, ``5s``, ``1m``, ``2h``, ``30d``, with a sign; no calendar units."""
    m = re.fullmatch(r"([+-]?)(\d+)(ms|s|m|h|d)", text.strip())
    if not m:
        raise QueryError(f"{text!r} is no fixed interval")
    return int(m[2]) * int(_UNITS[m[3]]) * (-1 if m[1] == "-" else 1)


def human_duration_ms(text: str) -> int:
    """``90 days``, ``1h 30min``: durations of retention and scrolls."""
    total, rest = 0.0, text.strip()
    if rest in ("hourly", "daily", "weekly", "monthly", "yearly"):
        return {"hourly": 3_600_000, "daily": 86_400_000, "weekly": 604_800_000, "monthly": 2_630_016_000, "yearly": 31_557_600_000}[rest]
    if not re.fullmatch(r"(\s*\d+\s*[a-zA-Z]+)+", rest):
        raise QueryError(f"{text!r} is no duration")
    for n, unit in re.findall(r"(\d+)\s*([a-zA-Z]+)", rest):
        u = _LONG.get(unit, _LONG.get(unit.removesuffix("s"), unit))
        if isinstance(u, str):
            if u not in _UNITS:
                raise QueryError(f"{unit!r} is no unit of time")
            total += int(n) * _UNITS[u]
        else:
            total += int(n) * u * 86_400_000
    return round(total)


def ip_hex(value: str) -> str:
    """32 hexadecimal digits of an address as IPv6; IPv4 is mapped into it."""
    a = ipaddress.ip_address(value.strip())
    n = int(a) | (0xFFFF << 32) if a.version == 4 else int(a)
    return f"{n:032x}"


def parse_bytes(text: str) -> bytes:
    """Hexadecimal, or base64 behind a ``!``."""
    try:
        if text.startswith("!"):
            raw = text[1:]
            return base64.b64decode(raw + "=" * (-len(raw) % 4))
        return bytes.fromhex(text)
    except (ValueError, binascii.Error) as e:
        raise QueryError(f"{text!r} is neither hexadecimal nor base64") from e


def coerce(value, kind: str, formats: list[str] | None = None):
    """A literal for a field of the kind; QueryError where it cannot be one."""
    try:
        if kind == "text":
            if isinstance(value, bool):
                return "true" if value else "false"
            return str(value)
        if kind in ("i64", "u64"):
            if isinstance(value, bool):
                raise ValueError
            if isinstance(value, float):
                if not value.is_integer():
                    raise ValueError
                value = int(value)
            n = int(value)
            low, high = (0, 2**64 - 1) if kind == "u64" else (-(2**63), 2**63 - 1)
            if not low <= n <= high:
                raise ValueError
            return n if n <= 2**63 - 1 else Decimal(n)
        if kind == "f64":
            if isinstance(value, bool):
                raise ValueError
            x = float(value)
            if not math.isfinite(x):
                raise ValueError
            return x
        if kind == "bool":
            if isinstance(value, bool):
                return value
            return {"true": True, "false": False}[str(value)]
        if kind == "datetime":
            return from_micros(parse_datetime(value, formats))
        if kind == "ip":
            return ip_hex(str(value))
        if kind == "bytes":
            return parse_bytes(str(value))
    except (ValueError, KeyError, TypeError) as e:
        if isinstance(e, QueryError):
            raise
        raise QueryError(f"{value!r} is no {kind}") from e
    raise QueryError(f"no literal can be a {kind}")

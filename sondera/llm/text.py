"""Vectorised word and line splitting over the UTF-8 buffers of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20

_all = np.arange(256)
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_all == 0x20) | ((_all >= 9) & (_all <= 13)))
#: A-Z to a-z, other bytes as they are.
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80)
NOT_NEWLINE = _all != 10

_P = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, size: int = SLICE):
    """Ranges of rows of about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1, i + 1)
        yield i, j
        i = j


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of the words, and for each row the index of its first word."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = table[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def split_lines(data: np.ndarray, offsets: np.ndarray):
    r"""Starts and ends of the ``\n``-split lines, and each row's first line.  A row
    has one line more than newlines."""
    nl = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], nl + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], nl]), kind="stable")
    per_row = np.searchsorted(nl, offsets[1:]) - np.searchsorted(nl, offsets[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per_row)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n + 1:
        for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            t = np.full(max(n + 1, 1 << 16), base, U64)
            t[0] = 1
            _powers[key] = np.cumprod(t, dtype=U64)
    return _powers["p"], _powers["i"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, from prefix sums of a polynomial."""
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(int(np.searchsorted(ends, starts[i] + SLICE, "right")), i + 1)
            a, b = int(starts[i]), int(ends[j - 1])
            p, inv = _table(b - a)
            c = np.zeros(b - a + 1, U64)
            np.cumsum((data[a:b].astype(U64) + U64(1)) * p[: b - a], out=c[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (c[e] - c[s]) * inv[s]
            i = j
        return mix(out ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def totals(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often the mask holds between each two offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k-item windows inside each row, and each row's first window."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    wo = np.concatenate([[0], np.cumsum(n)])
    pos = np.arange(wo[-1]) + np.repeat(first[:-1] - wo[:-1], n)
    return pos, wo


def window_hashes(h: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` items of ``h`` that begin at ``pos``."""
    acc = np.full(len(pos), k, U64)
    with np.errstate(over="ignore"):
        for t in range(k):
            acc += h[pos + t] * U64(((2 * t + 1) * 0xA24BAED4963EE407) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(acc)

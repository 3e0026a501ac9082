r"""Ids of whole texts by the tokenizers library, each distinct unit encoded once.

A text is cut into units, at byte positions where the library's own pattern always
begins a new part, whatever stands around:

* before a single space between two characters that are not white space, and around a
  single newline between two such (byte-level vocabulary, whose words keep the space);
* at any ASCII white space (vocabulary with word ends, which drops white space);
* between an ASCII letter, an ASCII digit and one of the marks ``!-&(-/:-@|`` where two
  of different kinds meet.  The apostrophe is none of them, as it joins letters.

So the ids of a text are those of its units, joined.  All units of a slice are looked
up at once by numpy, in an open-addressing table that compares their bytes exactly; the
library encodes the distinct ones that are not there.  The table keeps the units that
are used most and has a fixed size, see :data:`SHORT` and :data:`LONG`.

Texts that contain ``<|``, and all texts for a tokenizer file whose normalizer, pattern
or special tokens are not those that the rules above were made for, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
from tokenizers import Tokenizer

from . import text as T

#: Units of at most 15 and at most 47 bytes that a worker remembers: (words of a key, units).
#: With their ids (:data:`POOL`) they take about 40 MB a vocabulary.
SHORT, LONG, POOL = (2, 1 << 19), (6, 1 << 15), 4_000_000

_all = np.arange(256)
_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _NEWLINE, _WHITE = range(7)


def _is(chars: str) -> np.ndarray:
    return np.isin(_all, np.frombuffer(chars.encode(), np.uint8))


_CLASS = np.zeros(256, np.uint8)
_CLASS[((_all | 32) >= 97) & ((_all | 32) <= 122)] = _LETTER
_CLASS[(_all >= 48) & (_all <= 57)] = _DIGIT
_CLASS[_is("".join(chr(c) for a, z in ("!&", "(/", ":@", "||") for c in range(ord(a), ord(z) + 1)))] = _MARK
_CLASS[(_all < 32) | (_all == 127)] = _WHITE
_CLASS[32], _CLASS[10] = _SPACE, _NEWLINE

#: Lead bytes behind which a character may be white space.
_MAY_WHITE = np.isin(_all, [0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
_ASCII_WHITE = (_all == 32) | ((_all >= 9) & (_all <= 13))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], T.U64)


def _classes(d: np.ndarray) -> np.ndarray:
    """The class of each byte; characters that may be white space beside the ASCII ones
    are marked whole, some more of them than the library's pattern has."""
    c = _CLASS[d]
    at = np.flatnonzero(_MAY_WHITE[d])
    if len(at):
        b = np.concatenate([d, np.zeros(2, np.uint8)])
        x, y, z = b[at].astype(int), b[at + 1].astype(int), b[at + 2].astype(int)
        two = (x == 0xC2) & (y <= 0xA0)
        three = ((x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))) | ((x == 0xE2) & (((y == 0x80) & ((z <= 0x8F) | ((z >= 0xA8) & (z <= 0xAF)))) | ((y == 0x81) & ((z == 0x9F) | (z == 0xA0)))))
        three |= ((x == 0xE3) & (y == 0x80) & (z == 0x80)) | ((x == 0xEF) & (y == 0xBB) & (z == 0xBF))
        for n, hit in ((2, two), (3, three)):
            for k in range(n):
                c[at[hit] + k] = _WHITE
    return c


class _Table:
    """Entries by the exact bytes of units of at most ``8 * words - 1`` bytes."""

    def __init__(self, words: int, most: int):
        self.words, self.most, self.longest = words, most, 8 * words - 1
        self.bits = (2 * most - 1).bit_length()
        self.key = np.zeros((words, most), T.U64)
        self.off, self.n, self.uses = (np.zeros(most, np.int32) for _ in range(3))
        self.clear()

    def clear(self) -> None:
        self.slots, self.count = np.full(1 << self.bits, -1, np.int32), 0

    def keys(self, d: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The units' bytes as words with their sizes in the last byte; ``d`` goes on behind them."""
        at = np.ndarray((len(d) - 7,), "<u8", d, strides=(1,))
        out = np.empty((self.words, len(start)), T.U64)
        for w in range(self.words):
            out[w] = at[start + 8 * w] & _MASK[np.clip(size - 8 * w, 0, 8)]
        out[-1] |= size.astype(T.U64) << T.U64(56)
        return out

    def _first_slot(self, key: np.ndarray) -> np.ndarray:
        h = key[0]
        for w in key[1:]:
            h = T.mix(h + T.U64(0x9E3779B97F4A7C15)) ^ w
        return (T.mix(h) >> T.U64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = self._first_slot(key)
        entry = self.slots[slot]
        other = entry >= 0
        for w in range(self.words):
            other &= self.key[w][entry] == key[w]
        todo = np.flatnonzero((entry >= 0) & ~other)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            e = entry[todo] = self.slots[slot[todo]]
            todo = todo[(e >= 0) & (self.key[:, e] != key[:, todo]).any(axis=0)]
        return entry

    def add(self, key: np.ndarray, off: np.ndarray, n: np.ndarray, uses: np.ndarray) -> None:
        """New entries of distinct keys; there must be room."""
        a, z = self.count, self.count + len(off)
        self.key[:, a:z], self.off[a:z], self.n[a:z], self.uses[a:z] = key, off, n, uses
        entry, slot, self.count = np.arange(a, z, dtype=np.int32), self._first_slot(key), z
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (len(self.slots) - 1)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct key (a column of words), and the number of that of each key."""
    h = key[0]
    for w in key[1:]:
        h = T.mix(h + T.U64(0x9E3779B97F4A7C15)) ^ w
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if (key[:, first[which]] != key).any():  # two keys of one hash
        _, first, which = np.unique(key, axis=1, return_index=True, return_inverse=True)
    return first, which.ravel()


def _plain(d: np.ndarray) -> np.ndarray:
    """Bytes of the letters A-Z, a-z and the Latin ones U+00C0 to U+00FF."""
    plain = _CLASS[d] == _LETTER
    at = np.flatnonzero(d[:-1] == 0xC3)
    at = at[(d[at + 1] != 0x97) & (d[at + 1] != 0xB7)]
    plain[at] = plain[at + 1] = True
    return plain


def _ragged(pool: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``pool[o : o + k]`` of each pair, one after another."""
    end = np.cumsum(n)
    return pool[np.repeat(off - end + n, n) + np.arange(end[-1] if len(end) else 0)]


class _Bpe:
    _made: dict[tuple, _Bpe] = {}
    layout: dict
    fold = np.arange(256, dtype=np.uint8)
    #: Bytes of a word's unit before its letters.
    led: int

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.mark, self.mark_id = max(((str(t.content), i) for i, t in self.tok.get_added_tokens_decoder().items()), key=lambda x: x[1], default=("", -1))
        with open(path, encoding="utf-8") as f:
            self.whole = not self._fits(json.load(f))
        self.tables = [_Table(*SHORT), _Table(*LONG)]
        vocab = self.tok.get_vocab(True)
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.edge[[i for t, i in vocab.items() if self.at_edge(t)]] = True
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    @classmethod
    def of(cls, path: str):
        """One instance per worker process."""
        if (cls, path) not in cls._made:
            cls._made[cls, path] = cls(path)
        return cls._made[cls, path]

    def _fits(self, file: dict) -> bool:
        """Whether the file is laid out as the rules for cuts suppose."""
        plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
        added = file["added_tokens"]
        special = bool(added) and all(t["content"].startswith("<|") and plain.items() <= t.items() for t in added)
        return special and file["model"]["type"] == "BPE" and not file["model"].get("dropout") and {k: file[k] for k in ("normalizer", "pre_tokenizer")} == self.layout

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, d: np.ndarray, start: np.ndarray, size: np.ndarray, between: bytes) -> np.ndarray:
        """Ids of the units as one text, with ``between`` behind each but the last."""
        w = len(between)
        text = np.empty((len(start), w), np.uint8)
        text[:] = np.frombuffer(between, np.uint8)
        out = np.empty(int(size.sum()) + text.size, np.uint8)
        place = np.cumsum(size + w) - size - w
        every = np.arange(len(out))
        out[_ragged(every, place, size)] = _ragged(d, start, size)
        out[((place + size)[:, None] + np.arange(w)).ravel()] = text.ravel()
        return self._library([out[: len(out) - w].tobytes().decode()])[0]

    def _encode_units(self, d: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units, and for each its place among them and its number of ids.
        Words of plain letters go to the library side by side, other units with a special
        token between them, which none of them contains."""
        bad = np.concatenate([[0], np.cumsum(~_plain(d))])
        words = (bad[start + size] == bad[start + self.led]) & (size > self.led)
        if self.led:
            words &= d[start] == 32
        off, n, out, used = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0
        for side, most in ((np.flatnonzero(words), 8192), (np.flatnonzero(~words), 2048)):
            for i in range(0, len(side), most):
                u = side[i : i + most]
                if most == 8192:
                    ids = self._joined(d, start[u], size[u], b"" if self.led else b" ")
                    edge = self.edge[ids]
                    k = np.diff(np.append(np.flatnonzero(edge), len(ids)) if self.led else np.append(-1, np.flatnonzero(edge)))
                    whole = len(k) == len(u) and k.sum() == len(ids)
                else:
                    ids = self._joined(d, start[u], size[u], self.mark.encode())
                    k = np.diff(np.concatenate([[-1], np.flatnonzero(ids == self.mark_id), [len(ids)]])) - 1
                    ids, whole = ids[ids != self.mark_id], len(k) == len(u)
                if not whole:
                    each = self._library([d[a : a + z].tobytes().decode() for a, z in zip(start[u].tolist(), size[u].tolist(), strict=True)])
                    ids, k = np.concatenate([*each, np.zeros(0, np.uint32)]), np.array([len(x) for x in each], np.int64)
                off[u], n[u] = used + np.cumsum(k) - k, k
                used += len(ids)
                out.append(ids)
        return np.concatenate([*out, np.zeros(0, np.uint32)]), off, n

    def _remember(self, t: _Table, key: np.ndarray, off: np.ndarray, n: np.ndarray, uses: np.ndarray, pool: np.ndarray) -> None:
        """Put new units into their table, the most used ones if they are more than half of it."""
        if len(off) > t.most // 2 or n.sum() > len(self.pool) // 4:
            take = np.argsort(-uses, kind="stable")[: t.most // 2]
            take = take[np.cumsum(n[take]) <= len(self.pool) // 4]
            key, off, n, uses = key[:, take], off[take], n[take], uses[take]
        if t.count + len(off) > t.most or self.used + n.sum() > len(self.pool):
            self._prune()
        ids = _ragged(pool, off, n)
        self.pool[self.used : self.used + len(ids)] = ids
        t.add(key, self.used + np.cumsum(n) - n, n, uses)
        self.used += len(ids)

    def _prune(self) -> None:
        """Keep the more used half of each table, and their ids."""
        pool, self.pool, self.used = self.pool, np.zeros(POOL, np.uint32), 0
        for t in self.tables:
            keep = np.argsort(-t.uses[: t.count], kind="stable")[: t.count // 2]
            keep = keep[np.cumsum(t.n[keep]) <= POOL // 4]
            key, off, n, uses = t.key[:, keep], t.off[keep].astype(np.int64), t.n[keep].astype(np.int64), t.uses[keep] // 2
            ids = _ragged(pool, off, n)
            self.pool[self.used : self.used + len(ids)] = ids
            t.clear()
            t.add(key, self.used + np.cumsum(n) - n, n, uses)
            self.used += len(ids)

    def _slice(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows that begin at ``rows`` (with the end), and each row's number of ids."""
        data = self.fold[data]
        start, end = self._cut(data, rows)
        d = np.concatenate([data, np.zeros(8 * self.tables[-1].words, np.uint8)])
        size = end - start
        off, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        kind = np.digitize(size, [t.longest + 1 for t in self.tables])
        new, which, fresh = [], [], []  # units that no table has: all, the distinct one that each is, the distinct ones
        found = 0
        for k, t in enumerate(self.tables):
            mine = np.flatnonzero(kind == k)
            if len(mine):
                key = t.keys(d, start[mine], size[mine])
                entry = t.find(key)
                hit = entry >= 0
                e = entry[hit]
                off[mine[hit]], n[mine[hit]] = t.off[e], t.n[e]
                t.uses[: t.count] += np.bincount(e, minlength=t.count).astype(np.int32)
                miss = np.flatnonzero(~hit)
                first, of = _distinct(key[:, miss])
                new.append(mine[miss])
                which.append(found + of)
                fresh.append((t, mine[miss[first]], key[:, miss[first]], np.bincount(of, minlength=len(first))))
                found += len(first)
        long = np.flatnonzero(kind == len(self.tables))
        new.append(long)
        which.append(found + np.arange(len(long)))
        units = np.concatenate([*(x[1] for x in fresh), long])
        pool = self.pool
        if len(units):
            more, at, k = self._encode_units(d, start[units], size[units])
            at += len(pool)
            new, which = np.concatenate(new), np.concatenate(which)
            off[new], n[new] = at[which], k[which]
            pool = np.concatenate([pool, more])
        ids = _ragged(pool, off, n)
        if len(units):
            found = 0
            for t, unit, key, uses in fresh:
                self._remember(t, key, at[found : found + len(unit)], k[found : found + len(unit)], uses, pool)
                found += len(unit)
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(total[np.searchsorted(start, rows)])

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, one text after another, and each text's number of ids;
        null is empty."""
        data, off = T.buffers(column)
        some = np.zeros(len(off) - 1, bool)  # rows that the library gets whole
        if self.whole:
            some[:] = np.diff(off) > 0
        elif len(data):
            at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
            some[np.searchsorted(off, at, "right") - 1] = True
        ids, sizes = [], []
        for i, j in T.slices(off):
            r = i
            while r < j:
                z = r + 1
                while z < j and some[z] == some[r]:
                    z += 1
                if some[r]:
                    found = self._library([data[off[q] : off[q + 1]].tobytes().decode() for q in range(r, z)])
                    ids += found
                    sizes.append(np.array([len(x) for x in found], np.int64))
                else:
                    x, n = self._slice(data[off[r] : off[z]], off[r : z + 1] - off[r])
                    ids.append(x)
                    sizes.append(n)
                r = z
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])


def ended(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each text, and where each text begins, with the end."""
    return np.insert(ids, np.cumsum(n), end_id), np.concatenate([[0], np.cumsum(n + 1)])


def _neighbours(c: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class before and behind each byte, odd white space at the ends of rows; and the
    first bytes of the rows that are not empty."""
    before, behind = np.empty_like(c), np.empty_like(c)
    before[1:], behind[:-1] = c[:-1], c[1:]
    first = rows[:-1][np.diff(rows) > 0]
    before[first] = _WHITE
    behind[rows[1:][np.diff(rows) > 0] - 1] = _WHITE
    return before, behind, first


_PAIR = np.zeros(64, bool)  # a cut between classes a and b: a * 8 + b
for _a in (_LETTER, _DIGIT, _MARK):
    for _b in (_LETTER, _DIGIT, _MARK):
        _PAIR[8 * _a + _b] = _a != _b


class ByteBpe(_Bpe):
    """For the byte-level vocabulary.  Its pattern takes one space with the word that follows,
    and a newline between two characters that are not white space stands alone."""

    led = 1
    layout = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}

    @staticmethod
    def at_edge(token: str) -> bool:
        return token.startswith("Ġ")  # only the first token of a word begins with a space

    def _cut(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = _classes(data)
        before, behind, first = _neighbours(c, rows)
        single = (before < _SPACE) & (behind < _SPACE)
        cut = _PAIR[8 * before + c] | (single & (c >= _SPACE) & (c <= _NEWLINE))
        cut[1:] |= (single & (c == _NEWLINE))[:-1]
        cut[first] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(data))


class WordBpe(_Bpe):
    """For the vocabulary with word ends, which drops white space and case."""

    layout = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    }
    fold, led = T.LOWER, 0

    @staticmethod
    def at_edge(token: str) -> bool:
        return token.endswith("</w>")  # only the last token of a word is a word end

    def _cut(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        white = _ASCII_WHITE[data]
        c = _CLASS[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = _PAIR[8 * c[:-1] + c[1:]] | (white[1:] != white[:-1]) | ((c[1:] == _DIGIT) & (c[:-1] == _DIGIT))
        cut[rows[:-1][np.diff(rows) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        word = ~white[start]
        return start[word], end[word]

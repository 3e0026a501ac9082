"""Greedy word-piece counts with a linear longest-match automaton.

The vocabulary is a trie.  Every node has a failure link: the node reached
after the longest pieces have been popped off its string, and the number of
pieces popped on the way, worked out beforehand.  Reading a word takes one step
per byte, forward in the trie where it goes on and along a failure link where
it does not; at the end the remaining string is popped.  The sum of the popped
numbers is the length of the greedy longest-match tokenisation, and no piece is
ever built.

The vocabulary is a byte-level one that holds every single byte, so each word
can be matched: a word is read as its bytes behind one space, the form in which
the vocabulary keeps word beginnings.  Distinct words of a batch go through the
automaton side by side as numpy arrays.

Defined results: null and empty text has no words and no tokens; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

#: Words that a worker remembers before it forgets all.
MOST = 600_000


def load_ranks(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """``step`` has a row (node * 256 + byte, next node) for each trie edge, sorted;
    ``fail`` and ``popped`` are each node's failure link and its number of pieces."""

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for p in pieces:
            at = 0
            for c in p:
                nxt = child[at].get(c)
                if nxt is None:
                    nxt = child[at][c] = len(child)
                    child.append({})
                    final.append(False)
                at = nxt
            final[at] = at != 0
        missing = [c for c in range(256) if c not in child[0] or not final[child[0][c]]]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        fail, popped = [0] * len(child), [0] * len(child)
        layer = [0]
        while layer:  # by depth, as a link leads to a shorter string
            below = []
            for u in layer:
                for c, v in child[u].items():
                    below.append(v)
                    if final[v]:
                        fail[v], popped[v] = 0, 1
                    else:
                        z, n = fail[u], popped[u]
                        while c not in child[z]:
                            n += popped[z]
                            z = fail[z]
                        fail[v], popped[v] = child[z][c], n
            layer = below
        edges = sorted((u * 256 + c, v) for u, d in enumerate(child) for c, v in d.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.next = np.array([v for _, v in edges], np.int32)
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)

    def count(self, words: list[bytes]) -> np.ndarray:
        """How many pieces each word has."""
        out = np.zeros(len(words), np.int64)
        order = np.argsort([-len(w) for w in words], kind="stable")
        size = np.array([len(words[i]) for i in order])
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        at = np.cumsum(size) - size
        node = np.zeros(len(words), np.int64)
        n = np.zeros(len(words), np.int64)
        for depth in range(int(size[0]) if len(size) else 0):
            go = np.arange(np.searchsorted(-size, -depth, "left"))  # the words longer than depth
            byte = data[at[go] + depth].astype(np.int64)
            while len(go):
                key = node[go] * 256 + byte
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                node[go[hit]] = self.next[k[hit]]
                go, byte = go[~hit], byte[~hit]
                n[go] += self.popped[node[go]]
                node[go] = self.fail[node[go]]
        go = np.flatnonzero(node)
        while len(go):
            n[go] += self.popped[node[go]]
            node[go] = self.fail[node[go]]
            go = go[node[go] != 0]
        out[order] = n
        return out


_made: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def _counter(path: str) -> tuple[Automaton, dict[bytes, int]]:
    if path not in _made:
        _made[path] = Automaton(load_ranks(path)), {}
    return _made[path]


def count_texts(texts: list[str | None], path: str) -> list[tuple[int, int, int]]:
    """Words, tokens, and tokens of the longest word of each text."""
    automaton, cache = _counter(path)
    split = [t.encode().split() if t else [] for t in texts]
    new = list({w for ws in split for w in ws if w not in cache})
    if len(cache) + len(new) > MOST:
        cache.clear()
        new = list({w for ws in split for w in ws})
    if new:
        cache.update(zip(new, automaton.count([b" " + w for w in new]).tolist(), strict=True))
    out = []
    for ws in split:
        n = [cache[w] for w in ws]
        out.append((len(n), sum(n), max(n, default=0)))
    return out


def count_tokens(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens, longest_word_tokens."""

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                c = list(zip(*count_texts(b.column(1).slice(lo, 256).to_pylist(), vocabulary_path), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), *(pa.array(x, pa.int64()) for x in c)], names=["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    return shared.id_and_text(documents).mapInArrow(shared.tidy(work), "doc_id long, n_words long, n_tokens long, longest_word_tokens long")

"""Word-piece token counts by a linear longest-match automaton.

The alphabet is the bytes, once as inner and once as last byte of a word, so a vocabulary's end-of-word mark is part of the
last symbol. The trie of the vocabulary has failure links with precomputed counts of the tokens popped on the way: from
node v, if no child fits the next symbol, the longest token that prefixes v's string is popped, then greedily the longest
of what is left, until what remains is a trie node again. Every single symbol is in the vocabulary, so matching never
fails. Counts are summed along the links; no piece is built. All distinct words of a slice advance one symbol per step.

Defined cases: a null or empty text has no words and no tokens; rows are counted one by one, so repeated rows and ids do
not matter; words and texts of any length are matched whole; an empty table gives an empty result. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textkit import slices

SCHEMA = "doc_id long, n_words long, n_tokens long"
WIDTH = 512


def printable_bytes() -> dict[str, int]:
    """The public byte-level alphabet of vocabulary files: printable bytes stand for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def read_pieces(path: str, mark: str = "</w>") -> list[list[int]]:
    """Vocabulary entries as symbols (last byte of a word: 256 + byte); entries outside the byte alphabet are special tokens."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table, out = printable_bytes(), []
    for piece in vocabulary:
        text = piece.removesuffix(mark)
        if text and all(c in table for c in text):
            symbols = [table[c] for c in text]
            if piece.endswith(mark):
                symbols[-1] += 256
            out.append(symbols)
    return out


class Automaton:
    """Trie edges as one sorted key array, failure links and popped counts as arrays."""

    def __init__(self, pieces: list[list[int]]):
        edges: dict[int, int] = {}
        token, parent, via, depth = [False], [0], [0], [0]
        for piece in [*pieces, *([s] for s in range(WIDTH))]:
            node = 0
            for s in piece:
                nxt = edges.get(node * WIDTH + s)
                if nxt is None:
                    nxt = edges[node * WIDTH + s] = len(token)
                    token.append(False)
                    parent.append(node)
                    via.append(s)
                    depth.append(depth[node] + 1)
                node = nxt
            token[node] = True
        n = len(token)
        fail, popped = [-1] * n, [0] * n
        for v in np.argsort(depth, kind="stable").tolist()[1:]:
            if token[v]:
                fail[v], popped[v] = 0, 1
                continue
            z, count = fail[parent[v]], popped[parent[v]]
            while z >= 0 and z * WIDTH + via[v] not in edges:
                count += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = edges[z * WIDTH + via[v]], count
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.fail, self.popped, self.token = np.array(fail), np.array(popped), np.array(token)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Child of each node, or -1."""
        key = node * WIDTH + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def lengths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Greedy longest-match token counts of data[start:end], each one word."""
        node, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        length = end - start
        order = np.argsort(-length, kind="stable")
        neg = -length[order]
        for t in range(int(length.max(initial=0))):
            active = order[: np.searchsorted(neg, -t, "left")]
            symbol = data[start[active] + t].astype(np.int64) + 256 * (length[active] == t + 1)
            left = np.arange(len(active))
            while len(left):
                words = active[left]
                to = self.step(node[words], symbol[left])
                hit = to >= 0
                node[words[hit]] = to[hit]
                left = left[~hit]
                words = words[~hit]
                count[words] += self.popped[node[words]]
                node[words] = self.fail[node[words]]
        while len(left := np.flatnonzero(node > 0)):
            count[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
        return count


@lru_cache(maxsize=4)
def automaton_of(path: str) -> Automaton:
    """One per worker process."""
    return Automaton(read_pieces(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and greedy word-piece tokens of every row's whole text, A-Z in lower case."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(path)
        for batch in batches:
            for s in slices(batch.column(1), lower=True):
                start, end, doc = s.words()
                _, first, inverse = np.unique(s.hashes(start, end), return_index=True, return_inverse=True)
                tokens = automaton.lengths(s.data, start[first], end[first])[inverse]
                sums = np.bincount(doc, tokens, minlength=s.n).astype(np.int64), np.bincount(doc, minlength=s.n)
                yield pa.record_batch([batch.column(0).slice(s.first, s.n), pa.array(sums[1]), pa.array(sums[0])], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, SCHEMA)

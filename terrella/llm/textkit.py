"""Vectorised text primitives: NumPy over the UTF-8 bytes of an Arrow string column.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which are single bytes in UTF-8, so no decoding is needed.
A word's hash is a polynomial over its bytes modulo 2**64, read off a running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift, multiply)."""
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


with np.errstate(over="ignore"):
    BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    BASE = U(0x5851F42D4C957F2D)
    INVERSE = U(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, for i in 0..n."""
    if len(_pow[0]) <= n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(max(n + 1, SLICE + 1), b, U)
            x[0] = 1
            _pow[k] = np.cumprod(x)
    p = _pow[0][: n + 1], _pow[1][: n + 1]
    if n > 4 * SLICE:  # do not keep the tables of an exceptionally long text
        _pow[:] = [np.ones(1, U), np.ones(1, U)]
    return p


class Slice:
    """Some consecutive rows' bytes: ``data``, and ``offs`` of each row in it."""

    def __init__(self, first: int, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.first, self.offs, self.n = first, offs, len(offs) - 1
        self.data = LOWER[data] if lower else data
        self._sum: np.ndarray | None = None

    def running(self) -> np.ndarray:
        if self._sum is None:
            up, _ = powers(len(self.data))
            self._sum = np.zeros(len(self.data) + 1, U)
            np.cumsum(BYTE[self.data] * up[: len(self.data)], out=self._sum[1:])
        return self._sum

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
        total, down = self.running(), powers(len(self.data))[1]
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every word."""
        d = self.data
        if not len(d):
            z = np.zeros(0, np.int64)
            return z, z, z
        gap = SPACE[d]
        edge = np.zeros(len(d) + 1, bool)
        edge[self.offs] = True
        before = np.empty(len(d), bool)
        before[0] = True
        before[1:] = gap[:-1]
        start = np.flatnonzero(~gap & (before | edge[:-1]))
        after = np.empty(len(d), bool)
        after[-1] = True
        after[:-1] = gap[1:]
        end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        return start, end, np.searchsorted(self.offs, start, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every line between newlines, and each row's first line number (with the total at the end)."""
        nl = np.flatnonzero(self.data == 10)
        counts = np.bincount(np.searchsorted(self.offs, nl, "right") - 1, minlength=self.n)[: self.n] + 1 if len(nl) else np.ones(self.n, np.int64)
        base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        start, end = np.empty(base[-1], np.int64), np.empty(base[-1], np.int64)
        first, last = np.zeros(base[-1], bool), np.zeros(base[-1], bool)
        first[base[:-1]], last[base[1:] - 1] = True, True
        start[first], end[last] = self.offs[:-1], self.offs[1:]
        start[~first], end[~last] = nl + 1, nl
        return start, end, np.repeat(np.arange(self.n), counts), base


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes; nulls are empty."""
    column = as_strings(column)
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Slice(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower)
        i = j


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within a document, and where each run starts."""
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    g = np.zeros(len(at), U)
    for i in range(k):
        g = g * U(0xD1342543DE82EF95) + h[at + i]
    return mix(g), at


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, whether its key occurs elsewhere too, and whether it occurred earlier."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def salted(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Keys that are only equal within a group."""
    return mix(key ^ mix(group.astype(U) + U(0x632BE59BD9B4E019)))


def per(group: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of weights, by group."""
    return np.bincount(group, weights, minlength=n)[:n]

"""Packed exchange: many small facts travel between tasks as few compressed column blobs.

Facts about a chunk of documents (some consecutive documents of one task) are sorted, cut into buckets by hash and each
bucket's share becomes one blob. Columns are stored byte plane by byte plane, so the high bytes of differences vanish.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_PACK, _UNPACK = zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()


def pack(*columns: np.ndarray) -> bytes:
    out = []
    for c in columns:
        c = np.ascontiguousarray(c)
        data = _PACK.compress(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()) if len(c) else b""
        out.append(struct.pack("<IIB", len(data), len(c), ord(c.dtype.char)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, n, char = struct.unpack_from("<IIB", data, at)
        at += 9
        kind = np.dtype(chr(char))
        raw = _UNPACK.decompress(data[at : at + size]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted column; ``np.cumsum`` undoes them."""
    return np.diff(x, prepend=x.dtype.type(0))


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted column starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)

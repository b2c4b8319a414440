"""PNG bytes of RGBA tiles, with the standard library's deflate."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np


def png(a: np.ndarray) -> bytes:
    """Of a (rows, columns), (rows, columns, 3) or (rows, columns, 4) array of bytes."""
    if a.ndim not in (2, 3):
        raise ValueError("two or three dimensions are needed")
    a = a[..., None] if a.ndim == 2 else a
    kind = {1: 0, 3: 2, 4: 6}[a.shape[2]]
    rows = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.astype(np.uint8).reshape(a.shape[0], -1)], 1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def data_url(data: bytes, mime: str = "image/png") -> str:
    return f"data:{mime};base64,{base64.b64encode(data).decode()}"


def compress(a: np.ndarray, fmt: str = "png", as_data_url: bool = False, transparent: tuple[int, int, int] | None = None) -> bytes | str:
    if fmt.lower() != "png":
        raise NotImplementedError(f"no codec for {fmt}")
    if transparent is not None and a.ndim == 3 and a.shape[2] == 4:
        a = np.where(a[..., 3:] == 0, np.array(transparent, np.uint8), a[..., :3])
    data = png(a)
    return data_url(data) if as_data_url else data

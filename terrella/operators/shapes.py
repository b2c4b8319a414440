"""Geometries between Arrow and NumPy: a column's vertices are read as one flat array, a geometry is a view of some of it.

In kernels a geometry is a dict of ``type``, ``crs`` and ``parts``: parts of rings, a ring being an array of x, y rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import TYPE
from ..values import CRSMismatch

VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PARTS = pa.list_(pa.list_(pa.list_(VERTEX)))
KIND = pa.struct([("type", pa.string()), ("crs", pa.string()), ("parts", PARTS)])


def _offsets(a: pa.ListArray) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]


def decode(column: pa.StructArray) -> list[dict | None]:
    """Geometries of a column, null for null ones."""
    if not len(column):
        return []
    kinds, systems, parts = (column.field(n) for n in ("type", "crs", "parts"))
    o1 = _offsets(parts)
    rings = parts.values
    o2 = _offsets(rings)
    points = rings.values
    o3 = _offsets(points)
    at = points.values
    xy = np.stack([at.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y")], 1) if len(at) else np.zeros((0, 2))
    there = column.is_valid().to_numpy(zero_copy_only=False) & kinds.is_valid().to_numpy(zero_copy_only=False)
    out: list[dict | None] = []
    for i, (kind, crs) in enumerate(zip(kinds.to_pylist(), systems.to_pylist())):
        out.append({"type": kind, "crs": crs, "parts": [[xy[o3[k] : o3[k + 1]] for k in range(o2[j], o2[j + 1])] for j in range(o1[i], o1[i + 1])]} if there[i] else None)
    return out


def encode(found: list[dict | None]) -> pa.StructArray:
    """A column of geometries, by flat arrays and offsets."""
    each = [g["parts"] if g else [] for g in found]
    parts = [p for ps in each for p in ps]
    rings = [np.asarray(r, float).reshape(-1, 2) for p in parts for r in p]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    a = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], fields=list(VERTEX))
    a = pa.ListArray.from_arrays(ends([len(r) for r in rings]), a)
    a = pa.ListArray.from_arrays(ends([len(p) for p in parts]), a)
    a = pa.ListArray.from_arrays(ends([len(ps) for ps in each]), a)
    named = [pa.array([g[n] if g else None for g in found], pa.string()) for n in ("type", "crs")]
    return pa.StructArray.from_arrays([*named, a], fields=list(KIND), mask=pa.array([g is None for g in found], pa.bool_()))


def same_system(a: dict, b: dict) -> None:
    if a["crs"] != b["crs"]:
        raise CRSMismatch("the geometries' coordinate systems differ")


def pairs(a: pa.StructArray, b: pa.StructArray) -> Iterator[tuple[dict, dict] | None]:
    """Pairs of which both are there; an error where their coordinate systems differ."""
    for x, y in zip(decode(a), decode(b)):
        if x is None or y is None:
            yield None
        else:
            same_system(x, y)
            yield x, y


def whole(g: Column) -> Column:
    """A geometry column with its fields in the order that ``decode`` reads."""
    return F.struct(g["type"].alias("type"), g["crs"].alias("crs"), g["parts"].alias("parts"))


def later(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """An Arrow function made when first used, as its type can only be parsed with a session."""

    def wrap(f):
        made: list = []

        def call(*columns: Column) -> Column:
            if not made:
                made.append(F.arrow_udf(f, ddl))
            return made[0](*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


__all__ = ["KIND", "TYPE", "decode", "encode", "later", "pairs", "same_system", "whole"]

"""Outlines of buffers that need no arrangement: the same places as the union of stadiums."""

import time

import numpy as np
import pytest

from terrella.operators import overlay
from terrella.operators.kernels import signed_area


def shape(kind, *points):
    return {"type": kind, "crs": None, "parts": [[np.array(points, float)]]}


def turned(points, degrees):
    t = np.radians(degrees)
    return (np.array(points, float) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])).tolist()


def ring(*points):
    return [*points, points[0]]


BOX, HEXAGON = ring((0, 0), (3, 0), (3, 2), (0, 2)), ring(*((np.cos(t), np.sin(t)) for t in np.arange(6) * np.pi / 3))
SHAPES = [
    shape("Polygon", *BOX), shape("Polygon", *BOX[::-1]), shape("Polygon", *turned(BOX, 33)), shape("Polygon", *HEXAGON), shape("Polygon", *ring((0, 0), (4, 0), (0, 4))),
    shape("LineString", (0, 0), (2, 1)), shape("LineString", (0, 0), (2, 0), (2, 2)), shape("LineString", (0, 0), (2, 0), (2, -2)), shape("LineString", *turned([(0, 0), (2, 0), (3, 1)], 12)), shape("LineString", (0, 0), (1, 0), (3, 0)), shape("Point", (1, 2)),
]


def area(g) -> float:
    return sum(signed_area(r) for part in g["parts"] for r in part)


@pytest.mark.parametrize("d", [0.25, 0.9, -0.25, -0.75, -1.0, -2.0])
def test_outlines_are_the_union(d, monkeypatch):
    shapes = [g for g in SHAPES if d > 0 or g["type"] == "Polygon"]
    got = overlay.rounded(shapes, [d] * len(shapes), 8 * 3)
    assert sum(g is not None for g in got) >= (len(shapes) if d > 0 else 3)
    monkeypatch.setattr(overlay, "rounded", lambda shapes, *_: [None] * len(shapes))
    for g, quick, whole in zip(shapes, got, overlay.buffered(shapes, [d] * len(shapes), 8 * 3)):
        if quick is not None:
            assert area(quick) == pytest.approx(area(whole), abs=1e-9)
            if area(whole) > 1e-6:
                assert area(overlay.combine(quick, whole, overlay.SYMMETRIC)) == pytest.approx(0, abs=1e-7)


def test_others_are_left_to_the_arrangement():
    """Corners between steps, notches, short sides, sharp bends, holes and many parts."""
    others = [
        shape("Polygon", *ring((0, 0), (4, 0), (1, 3))), shape("Polygon", *ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))), shape("Polygon", *ring((0, 0), (2, 2), (2, 0), (0, 2))), shape("LineString", (0, 0), (2, 0), (2, 0.2)),
        shape("LineString", (0, 0), (2, 0), (1, 1)), shape("LineString", (0, 0), (0, 0)), shape("LineString", (0, 0), (2, 0), (2, 2), (4, 4)),
    ]
    others += [{"type": "MultiPolygon", "crs": None, "parts": SHAPES[0]["parts"] * 2}, {"type": "Polygon", "crs": None, "parts": [[*SHAPES[0]["parts"][0], np.array(BOX) / 3 + 1]]}, None]
    assert overlay.rounded(others, [0.25] * len(others), 30) == [None] * len(others)
    assert overlay.rounded(SHAPES[:2], [0.0, None], 30) == [None, None]


def test_many_buffers():
    began = time.perf_counter()
    boxes = [shape("Polygon", *(np.array(BOX) + k)) for k in range(4000)]
    found = overlay.buffered(boxes, [0.5 if k % 2 else -0.5 for k in range(4000)], 30)
    assert area(found[0]) == pytest.approx(2) and area(found[1]) == pytest.approx(6 + 5 + 0.25 * 60 * np.sin(np.pi / 60)) and time.perf_counter() - began < 10


def test_lines_that_shrink_need_no_strokes(monkeypatch):
    monkeypatch.setattr(overlay, "_strokes", None)
    assert overlay.buffered([SHAPES[6], SHAPES[10]], [-0.5, -0.5], 30) == [{"type": "Polygon", "crs": None, "parts": []}] * 2

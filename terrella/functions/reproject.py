"""Plans of reading one pixel grid for another: which pixels of a source a destination needs, at what shrink, and whether they can be pasted.

All are Column expressions over two geoboxes, so a table of grid pairs is planned row by row without a shuffle or Python.
Regions are struct(y0, y1, x0, x1: long), half open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import affine as A
from . import bbox as B
from . import geobox as G
from . import geometry as Geo
from .crs import crs, transform
from .scalar import align_down, align_up, finite, let

Map = Callable[[Column, Column], tuple[Column, Column]]
EDGE_POINTS = 5


def region(y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    return F.struct(*(v.cast("long").alias(n) for v, n in zip((y0, y1, x0, x1), ("y0", "y1", "x0", "x1"))))


def is_empty(r: Column) -> Column:
    return (r["y1"] <= r["y0"]) | (r["x1"] <= r["x0"])


def pixel_map(source: Column, target: Column, source_crs=None, target_crs=None, back: Column | None = None) -> Map:
    """From the pixels of one grid to those of another; systems are constants, equal or absent ones are linear.

    ``back``: the inverse of the target's matrix, where that is at hand. ``place`` of the map gives a struct, computed once.

    Longitudes and latitudes that a grid's edge overshoots are taken back to the globe before they are projected.
    """
    def place(x: Column, y: Column) -> Column:
        p = G.pix2wld(source, x, y)
        if source_crs is None or target_crs is None or crs(source_crs) == crs(target_crs):
            q = p
        else:
            globe = crs(source_crs).geographic
            lim = lambda v, n: F.least(F.greatest(v, F.lit(-n)), F.lit(n)) if globe else v
            q = let(p, lambda v: F.struct(*(c.alias(n) for c, n in zip(transform(lim(v["x"], 180.0), lim(v["y"], 90.0), source_crs, target_crs), "xy"))))
        if back is not None:
            return let(q, lambda v: F.struct(*(c.alias(n) for c, n in zip(A.apply(back, v["x"], v["y"]), "xy"))))
        return let(q, lambda v: G.wld2pix(target, v["x"], v["y"]))

    def there(x: Column, y: Column) -> tuple[Column, Column]:
        r = place(x, y)
        return r["x"], r["y"]

    there.place = place
    return there


def through(ring: Column, f: Map) -> Column:
    if hasattr(f, "place"):
        return F.transform(ring, lambda p: f.place(p["x"], p["y"]))
    return F.transform(ring, lambda p: let(p, lambda v: F.struct(*(c.alias(n) for c, n in zip(f(v["x"], v["y"]), "xy")))))


def around(points: Column, ny: Column, nx: Column, padding: int = 0, align: int | None = None) -> Column:
    """Region of whole pixels around an array's finite points, padded, aligned and clipped to the plane; empty without any."""
    def plan(ok: Column) -> Column:
        def axis(k: str, n: Column) -> tuple[Column, Column]:
            v = F.transform(ok, lambda p: p[k])
            lo, hi = F.floor(F.array_min(v)) - padding, F.ceil(F.array_max(v)) + padding
            if align:
                lo, hi = align_down(lo, align), align_up(hi, align)
            clip = lambda c: F.coalesce(F.least(F.greatest(c, F.lit(0)), n), F.lit(0))
            return clip(lo), clip(hi)

        return region(*axis("y", ny), *axis("x", nx))

    return let(F.filter(points, lambda p: finite(p["x"]) & finite(p["y"])), plan)


def relative_regions(src: Column, dst: Column, fwd: Map, back: Map, per_side: int, padding: int, align: int | None) -> Column:
    """struct(src, dst): the source around the destination's edge, then the destination around that."""
    ring = lambda x0, y0, x1, y1: B.boundary(B.bbox(x0, y0, x1, y1), per_side)
    zero = F.lit(0)
    read = around(through(ring(zero, zero, dst["nx"], dst["ny"]), back), src["ny"], src["nx"], padding, align)

    def both(r: Column) -> Column:
        write = around(through(ring(r["x0"], r["y0"], r["x1"], r["y1"]), fwd), dst["ny"], dst["nx"])
        return F.struct(r.alias("src"), F.when(is_empty(r), region(zero, zero, zero, zero)).otherwise(write).alias("dst"))

    return let(read, both)


def box_overlap(src_ny: Column, src_nx: Column, dst_ny: Column, dst_nx: Column, m: Column) -> Column:
    """struct(src, dst): regions two planes share under a scale and shift, X_src = m X_dst."""
    def both(v: Column) -> Column:
        y, x = v["y"], v["x"]
        return F.struct(region(y["s0"], y["s1"], x["s0"], x["s1"]).alias("src"), region(y["d0"], y["d1"], x["d0"], x["d1"]).alias("dst"))

    return let(F.struct(A.axis_overlap(src_ny, dst_ny, m["e"], m["f"]).alias("y"), A.axis_overlap(src_nx, dst_nx, m["a"], m["c"]).alias("x")), both)


def scale_at(f: Map, x: Column, y: Column, radius: float = 1.0) -> Column:
    """struct(x, y): local scale of a map, from the slopes over a step to each side."""
    at = lambda dx, dy: F.struct(*(c.alias(n) for c, n in zip(f(x + dx, y + dy), "xy")))
    four = F.struct(at(radius, 0).alias("e"), at(-radius, 0).alias("w"), at(0, radius).alias("s"), at(0, -radius).alias("n"))
    slope = lambda p, q, k: (p[k] - q[k]) / (2 * radius)
    return let(four, lambda v: A.scale_change(A.affine(slope(v["e"], v["w"], "x"), slope(v["s"], v["n"], "x"), 0.0, slope(v["e"], v["w"], "y"), slope(v["s"], v["n"], "y"), 0.0)))


def reproject_plan(src: Column, dst: Column, source_crs=None, target_crs=None, ttol: float = 0.05, stol: float = 1e-3, padding: int | None = None, align: int | None = None) -> Column:
    """struct(roi_src, roi_dst, paste_ok, read_shrink, scale, scale2, linear) of reading ``src`` for ``dst``.

    ``scale`` above 1 means that the source shrinks. Grids of one system that differ by a whole shrink and shift, with
    neither padding nor alignment asked for, are pasted: their regions fit exactly. Others read one more pixel on each
    side by default. ``linear`` maps source to destination pixels, null where the systems differ.
    """
    grids = F.struct(src.alias("src"), dst.alias("dst"))
    same = source_crs is None or target_crs is None or crs(source_crs) == crs(target_crs)
    pad = 1 if padding is None else padding

    def plan(regions: Column, paste: Column, scale2: Column, linear: Column) -> Column:
        def out(v: Column) -> Column:
            least = F.least(v["scale2"]["x"], v["scale2"]["y"])
            return F.struct(
                v["r"]["src"].alias("roi_src"), v["r"]["dst"].alias("roi_dst"), v["paste"].alias("paste_ok"), let(least, A.read_shrink).alias("read_shrink"),
                least.alias("scale"), v["scale2"].alias("scale2"), v["linear"].alias("linear"),
            )

        return let(F.struct(regions.alias("r"), paste.alias("paste"), scale2.alias("scale2"), linear.alias("linear")), out)

    def curved(g: Column) -> Column:
        s, d = g["src"], g["dst"]
        fwd, back = pixel_map(s, d, source_crs, target_crs), pixel_map(d, s, target_crs, source_crs)
        none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def scaled(r: Column) -> Column:
            w = r["dst"]
            local = scale_at(back, (w["x0"] + w["x1"]) * 0.5, (w["y0"] + w["y1"]) * 0.5)
            return plan(r, F.lit(False), F.when(is_empty(w), none).otherwise(local), F.lit(None).cast("struct<a:double,b:double,c:double,d:double,e:double,f:double>"))

        return let(relative_regions(s, d, fwd, back, EDGE_POINTS, pad, align), scaled)

    def straight(g: Column) -> Column:
        maps = F.struct(g["src"].alias("src"), g["dst"].alias("dst"), A.multiply(A.inverse(g["src"]["m"]), g["dst"]["m"]).alias("back"), A.multiply(A.inverse(g["dst"]["m"]), g["src"]["m"]).alias("fwd"))

        def decide(v: Column) -> Column:
            s, d, m = v["src"], v["dst"], v["back"]
            away = relative_regions(s, d, pixel_map(s, d), pixel_map(d, s), 2, pad, align)
            if align or padding:
                return plan(away, F.lit(False), A.scale_change(m), v["fwd"])

            def pasted(k: Column) -> Column:
                small = A.multiply(A.affine(1.0 / k, 0.0, 0.0, 0.0, 1.0 / k, 0.0), m)
                fit = let(A.snap(small, ttol, stol), lambda q: box_overlap(F.ceil(s["ny"] / k), F.ceil(s["nx"] / k), d["ny"], d["nx"], q))
                grown = lambda r: region(r["y0"] * k, r["y1"] * k, r["x0"] * k, r["x1"] * k)
                return let(fit, lambda r: F.struct(grown(r["src"]).alias("src"), r["dst"].alias("dst")))

            shrink = let(A.scale_change(m), lambda z: let(F.least(z["x"], z["y"]), A.read_shrink))
            ok = A.paste_problem(m, stol, ttol).isNull()
            return let(F.struct(ok.alias("ok"), shrink.alias("k")), lambda w: plan(F.when(w["ok"], let(w["k"], pasted)).otherwise(away), w["ok"], A.scale_change(m), v["fwd"]))

        return let(maps, decide)

    return let(grids, straight if same else curved)


def tile_footprint(dst: Column, src: Column, target_crs=None, source_crs=None, per_side: int = EDGE_POINTS) -> Column:
    """A destination grid's edge as a polygon in the pixels of a source, for finding the source tiles it needs."""
    def ring(v: Column) -> Column:
        f = pixel_map(v["dst"], v["src"], target_crs, source_crs, v["back"])
        return F.filter(through(G.boundary(v["dst"], per_side), f), lambda p: finite(p["x"]) & finite(p["y"]))

    return Geo.polygon(let(F.struct(dst.alias("dst"), src.alias("src"), A.inverse(src["m"]).alias("back")), ring))

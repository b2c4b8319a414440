"""Planar geometries: struct(type: string, crs: string, parts: array<array<array<struct<x, y>>>>) as part, ring, vertex.

Points and lines have one ring per part. Measures and maps are higher-order array functions, so they stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import affine as A
from . import bbox as B

TYPE = "struct<type:string,crs:string,parts:array<array<array<struct<x:double,y:double>>>>>"


def vertex(x, y) -> Column:
    at = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(at(x).alias("x"), at(y).alias("y"))


def geometry(kind: str | Column, parts: Column, crs: str | Column | None = None) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), (crs if isinstance(crs, Column) else F.lit(crs).cast("string")).alias("crs"), parts.alias("parts"))


def coords(points) -> Column:
    """Vertices from a Column or a list of pairs."""
    return points if isinstance(points, Column) else F.array(*(vertex(x, y) for x, y in points))


def point(x, y, crs=None) -> Column:
    return geometry("Point", F.array(F.array(F.array(vertex(x, y)))), crs)


def multipoint(points, crs=None) -> Column:
    return geometry("MultiPoint", F.transform(coords(points), lambda p: F.array(F.array(p))), crs)


def line(points, crs=None) -> Column:
    return geometry("LineString", F.array(F.array(coords(points))), crs)


def multiline(lines, crs=None) -> Column:
    return geometry("MultiLineString", F.array(*(F.array(coords(p)) for p in lines)), crs)


def polygon(outer, crs=None, *inners) -> Column:
    return geometry("Polygon", F.array(F.array(coords(outer), *(coords(r) for r in inners))), crs)


def multipolygon(polygons, crs=None) -> Column:
    return geometry("MultiPolygon", F.array(*(F.array(*(coords(r) for r in rings)) for rings in polygons)), crs)


def box(left, bottom, right, top, crs=None) -> Column:
    return polygon(F.array(vertex(left, bottom), vertex(left, top), vertex(right, top), vertex(right, bottom), vertex(left, bottom)), crs)


def from_bbox(b: Column) -> Column:
    return box(b["left"], b["bottom"], b["right"], b["top"], b["crs"])


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def is_empty(g: Column) -> Column:
    return F.size(vertices(g)) <= 0


def is_multi(g: Column) -> Column:
    return g["type"].startswith("Multi") | (g["type"] == "GeometryCollection")


def exterior(g: Column) -> Column:
    return g["parts"][0][0]


def interiors(g: Column) -> Column:
    return F.slice(g["parts"][0], 2, F.greatest(F.size(g["parts"][0]) - 1, F.lit(0)))


def is_ring(g: Column) -> Column:
    r = exterior(g)
    return (F.size(r) > 3) & (F.element_at(r, 1) == F.element_at(r, -1))


def boundingbox(g: Column) -> Column:
    v = vertices(g)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return B.bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), g["crs"])


def envelope(g: Column) -> Column:
    return from_bbox(boundingbox(g))


def _edges(ring: Column) -> Column:
    """Array of struct(p, q)."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def ring_area(ring: Column) -> Column:
    """Signed; about the first vertex, so far-off coordinates cost no digits."""
    o = F.element_at(ring, 1)
    return _sum(_edges(ring), lambda e: (e["p"]["x"] - o["x"]) * (e["q"]["y"] - o["y"]) - (e["q"]["x"] - o["x"]) * (e["p"]["y"] - o["y"])) / 2


def area(g: Column) -> Column:
    """Outer rings less holes; 0 of points and lines."""
    part = lambda rings: F.abs(ring_area(rings[0])) - _sum(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.abs(ring_area(r)))
    return F.when(g["type"].endswith("Polygon"), _sum(g["parts"], part)).otherwise(F.lit(0.0))


def length(g: Column) -> Column:
    step = lambda e: F.sqrt((e["q"]["x"] - e["p"]["x"]) * (e["q"]["x"] - e["p"]["x"]) + (e["q"]["y"] - e["p"]["y"]) * (e["q"]["y"] - e["p"]["y"]))
    return _sum(F.flatten(g["parts"]), lambda r: _sum(_edges(r), step))


def centroid(g: Column) -> Column:
    """struct(x, y): by area of polygons, by length of lines, by count of points."""
    from .scalar import let

    return let(F.element_at(vertices(g), 1), lambda o: _centroid(g, o))


def _centroid(g: Column, o: Column) -> Column:
    from .scalar import let

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def fold(items: Column, weigh: Callable) -> Column:
        return F.aggregate(items, zero, lambda a, v: (lambda w, x, y: F.struct((a["w"] + w).alias("w"), (a["x"] + w * x).alias("x"), (a["y"] + w * y).alias("y")))(*weigh(v)))

    def tri(e: Column):
        px, py, qx, qy = e["p"]["x"] - o["x"], e["p"]["y"] - o["y"], e["q"]["x"] - o["x"], e["q"]["y"] - o["y"]
        return px * qy - qx * py, (px + qx) / 3, (py + qy) / 3

    def seg(e: Column):
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        return F.sqrt(dx * dx + dy * dy), (e["p"]["x"] + e["q"]["x"]) / 2 - o["x"], (e["p"]["y"] + e["q"]["y"]) / 2 - o["y"]

    def oriented(rings: Column) -> Column:
        """Edges of a part, outer ring counter-clockwise, holes clockwise."""
        return F.flatten(F.transform(rings, lambda r, i: F.when((ring_area(r) >= 0) == (i == 0), _edges(r)).otherwise(F.transform(_edges(r), lambda e: F.struct(e["q"].alias("p"), e["p"].alias("q"))))))

    s = (
        F.when(g["type"].endswith("Polygon"), fold(F.flatten(F.transform(g["parts"], oriented)), tri))
        .when(g["type"].endswith("LineString"), fold(F.flatten(F.transform(F.flatten(g["parts"]), _edges)), seg))
        .otherwise(fold(vertices(g), lambda p: (F.lit(1.0), p["x"] - o["x"], p["y"] - o["y"])))
    )
    return let(s, lambda v: F.struct((o["x"] + F.try_divide(v["x"], v["w"])).alias("x"), (o["y"] + F.try_divide(v["y"], v["w"])).alias("y")))


def map_vertices(g: Column, f: Callable[[Column, Column], tuple[Column, Column]], crs: Column | str | None = None) -> Column:
    parts = F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: vertex(*f(p["x"], p["y"])))))
    return geometry(g["type"], parts, g["crs"] if crs is None else crs)


def transform(g: Column, m: Column) -> Column:
    return map_vertices(g, lambda x, y: A.apply(m, x, y))


def to_crs(g: Column, source, target, resolution: float | None = None) -> Column:
    """Reprojected vertex by vertex, after segmenting if a resolution is given."""
    from .crs import crs
    from .crs import transform as project

    s, t = crs(source), crs(target)
    if s == t:
        return g
    return map_vertices(segmented(g, resolution) if resolution else g, lambda x, y: project(x, y, s, t), str(t))


def assign_crs(g: Column, crs: str | None) -> Column:
    return geometry(g["type"], g["parts"], crs)


def filter_vertices(g: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """Vertices that satisfy a predicate; rings left with too few go, and parts left without rings."""
    least = F.when(g["type"].endswith("Polygon"), F.lit(4)).when(g["type"].endswith("LineString"), F.lit(2)).otherwise(F.lit(1))
    ring = lambda r: F.filter(r, lambda p: keep(p["x"], p["y"]))
    parts = F.transform(g["parts"], lambda part: F.filter(F.transform(part, ring), lambda r: F.size(r) >= least))
    return geometry(g["type"], F.filter(parts, lambda part: F.size(part) > 0), g["crs"])


def dropna(g: Column) -> Column:
    from .scalar import finite

    return filter_vertices(g, lambda x, y: finite(x) & finite(y))


def densify(ring: Column, resolution: float, compat: bool = True) -> Column:
    """Vertices at most ``resolution`` apart along each edge.

    ``compat`` leaves an edge whole when the squares of its two x coordinates add up to less than the resolution's square,
    as existing results have it; else when the edge is that short.
    """
    res = F.lit(float(resolution))

    def points(e: Column) -> Column:
        p, q = e["p"], e["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = F.sqrt(dx * dx + dy * dy)
        whole = (p["x"] * p["x"] + q["x"] * q["x"] < res * res) if compat else (size <= res)
        n = F.when(whole | (size <= 0), F.lit(1).cast("long")).otherwise(F.ceil(size / res))
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: vertex(p["x"] + dx * F.least(F.lit(1.0), i * res / F.greatest(size, F.lit(1e-300))), p["y"] + dy * F.least(F.lit(1.0), i * res / F.greatest(size, F.lit(1e-300)))))

    return F.concat(F.flatten(F.transform(_edges(ring), points)), F.array(F.element_at(ring, -1)))


def segmented(g: Column, resolution: float, compat: bool = True) -> Column:
    parts = F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.when(F.size(ring) > 1, densify(ring, resolution, compat)).otherwise(ring)))
    return geometry(g["type"], parts, g["crs"])


def interpolate(g: Column, distance) -> Column:
    """struct(x, y) at a distance along a line; ends beyond it."""
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    ring = exterior(g)
    start = F.struct(F.lit(0.0).alias("done"), F.element_at(ring, 1)["x"].alias("x"), F.element_at(ring, 1)["y"].alias("y"))

    def step(a: Column, e: Column) -> Column:
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        n = F.sqrt(dx * dx + dy * dy)
        t = F.least(F.lit(1.0), F.coalesce(F.try_divide(d - a["done"], n), F.lit(1.0)))
        on = a["done"] < d
        return F.struct((a["done"] + n).alias("done"), F.when(on, e["p"]["x"] + dx * t).otherwise(a["x"]).alias("x"), F.when(on, e["p"]["y"] + dy * t).otherwise(a["y"]).alias("y"))

    out = F.aggregate(_edges(ring), start, step)
    return F.struct(out["x"].alias("x"), out["y"].alias("y"))


def edges(g: Column) -> Column:
    """Array of struct(p, q): the edges of all rings."""
    return F.flatten(F.transform(F.flatten(g["parts"]), _edges))


def contains_point(g: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings: holes are outside, and so are points on an edge."""
    from .scalar import let

    return let(edges(g), lambda e: inside(e, x, y))


def inside(all_edges: Column, x: Column, y: Column) -> Column:
    """``contains_point`` on edges computed before: a ray to the right crosses an odd number of them."""
    def crossed(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"])

    def on(e: Column) -> Column:
        p, q = e["p"], e["q"]
        near = x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        return near & ((x - p["x"]) * (q["y"] - p["y"]) == (y - p["y"]) * (q["x"] - p["x"]))

    return (F.size(F.filter(all_edges, crossed)) % 2 == 1) & ~F.exists(all_edges, on)


def ray_edge(e: Column) -> Column:
    """An edge with what tests of many points need of it: ``ray_near`` and ``ray_crossed``. ``tol`` is 1e-11 of its coordinates' size, some 50,000 times what a double rounds off."""
    p, q = e["p"], e["q"]
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    tol = 1e-11 * F.greatest(F.lit(1.0), *(F.abs(v[k]) for v in (p, q) for k in "xy"))
    fields = {"x": p["x"], "y": p["y"], "top": q["y"], "dx": dx, "dy": dy, "slope": F.coalesce(F.try_divide(dx, dy), F.lit(0.0)), "off": tol * (F.abs(dx) + F.abs(dy)), "tol": tol}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def ray_near(e: Column, x: Column, y: Column) -> Column:
    """Whether a point is within rounding of an edge."""
    from_end = lambda v, a, d: v.between(a + F.least(d, F.lit(0.0)) - e["tol"], a + F.greatest(d, F.lit(0.0)) + e["tol"])
    return (F.abs((x - e["x"]) * e["dy"] - (y - e["y"]) * e["dx"]) <= e["off"]) & from_end(x, e["x"], e["dx"]) & from_end(y, e["y"], e["dy"])


def ray_crossed(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses an edge; of a point within rounding of it, either may come out."""
    return ((e["y"] > y) != (e["top"] > y)) & (x < (y - e["y"]) * e["slope"] + e["x"])


def sides(g: Column) -> Column:
    """Array of two-vertex lines, one per outer edge."""
    return F.transform(_edges(exterior(g)), lambda e: line(F.array(e["p"], e["q"]), g["crs"]))


def wkt(g: Column) -> Column:
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))
    wrap = lambda a: F.concat(F.lit("("), F.array_join(a, ", "), F.lit(")"))
    rings = F.transform(g["parts"], lambda part: wrap(F.transform(part, ring)))
    lines = F.transform(g["parts"], lambda part: ring(part[0]))
    body = (
        F.when(F.size(g["parts"]) <= 0, F.lit("EMPTY")).when(g["type"] == "Polygon", rings[0]).when(g["type"] == "MultiPolygon", wrap(rings))
        .when(g["type"].isin("Point", "LineString"), lines[0]).otherwise(wrap(lines))
    )
    return F.concat(F.upper(g["type"]), F.lit(" "), body)


def svg_path(g: Column, decimals: int = 6) -> Column:
    at = lambda p: F.concat(F.round(p["x"], decimals).cast("string"), F.lit(","), F.round(p["y"], decimals).cast("string"))
    ring = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, at), "L"))
    return F.array_join(F.transform(F.flatten(g["parts"]), ring), "")


def clip_lon180(g: Column, tol: float = 1e-6) -> Column:
    """Longitudes within tol of the antimeridian go to the side most others are on; to +180 on a tie."""
    v = vertices(g)
    sign = _sum(v, lambda p: F.when(F.abs(p["x"]) >= 180 - tol, F.lit(0.0)).otherwise(F.signum(p["x"])))
    edge = F.when(sign >= 0, F.lit(180.0)).otherwise(F.lit(-180.0))
    return map_vertices(g, lambda x, y: (F.when(F.abs(x) >= 180 - tol, edge).otherwise(x), y))


def lonlat_bounds(g: Column, source, safe: bool = True) -> Column:
    """Bounds in longitude and latitude; spans over half the globe are tried with western longitudes moved east."""
    p = to_crs(g, source, 4326)
    b = boundingbox(p)
    if not safe:
        return b
    moved = boundingbox(map_vertices(p, lambda x, y: (F.when(x < 0, x + 360).otherwise(x), y)))
    return F.when((B.span_x(b) > 180) & (B.span_x(moved) < B.span_x(b)), moved).otherwise(b)


def auto_resolution(g: Column) -> Column:
    return F.sqrt(area(g)) * 4 / 100


def common_crs_agg(g: Column) -> Column:
    """Aggregate: the one CRS of all rows, null without rows, an error for several."""
    c = F.coalesce(g["crs"], F.lit(""))
    return F.when(F.count(c) == 0, F.lit(None).cast("string")).when(F.min(c) == F.max(c), F.min(g["crs"])).otherwise(F.raise_error(F.lit("geometries are in different reference systems")).cast("string"))


def multigeom_agg(g: Column) -> Column:
    """Aggregate: the rows' parts as one Multi geometry, or a collection when kinds differ."""
    kind = F.regexp_replace(g["type"], "^Multi", "")
    one = F.min(kind) == F.max(kind)
    return geometry(F.when(one, F.concat(F.lit("Multi"), F.min(kind))).otherwise(F.lit("GeometryCollection")), F.flatten(F.collect_list(g["parts"])), F.first(g["crs"]))


def geojson(g: Column) -> Column:
    """Geometry as GeoJSON text (type and coordinates)."""
    pos = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, pos)
    rings = lambda part: F.transform(part, ring)
    text = (
        F.when(g["type"] == "Point", F.to_json(pos(g["parts"][0][0][0]))).when(g["type"] == "MultiPoint", F.to_json(F.transform(g["parts"], lambda p: pos(p[0][0]))))
        .when(g["type"] == "LineString", F.to_json(ring(g["parts"][0][0]))).when(g["type"] == "MultiLineString", F.to_json(F.transform(g["parts"], lambda p: ring(p[0]))))
        .when(g["type"] == "Polygon", F.to_json(rings(g["parts"][0]))).otherwise(F.to_json(F.transform(g["parts"], rings)))
    )
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), text, F.lit("}"))


def geoms(g: Column) -> Column:
    """Array of a geometry's parts, each as a geometry of its own."""
    kind = F.regexp_replace(g["type"], "^Multi", "")
    return F.transform(g["parts"], lambda part: geometry(kind, F.array(part), g["crs"]))


def boundary(g: Column) -> Column:
    """Rings of polygons as lines; ends of open lines as points; of points, empty."""
    rings = F.transform(F.flatten(g["parts"]), lambda r: F.array(r))
    open_ = F.filter(F.flatten(g["parts"]), lambda r: F.element_at(r, 1) != F.element_at(r, -1))
    ends = F.flatten(F.transform(open_, lambda r: F.array(F.array(F.array(F.element_at(r, 1))), F.array(F.array(F.element_at(r, -1))))))
    many = F.when(F.size(rings) > 1, F.lit("MultiLineString")).otherwise(F.lit("LineString"))
    area_, line_ = g["type"].endswith("Polygon"), g["type"].endswith("LineString")
    return geometry(F.when(area_, many).otherwise(F.lit("MultiPoint")), F.when(area_, rings).when(line_, ends).otherwise(F.slice(rings, 1, 0)), g["crs"])


def mid_longitude(g: Column, source) -> Column:
    """Longitude of the centroid."""
    from .crs import transform as project
    from .scalar import let

    return let(centroid(g), lambda c: project(c["x"], c["y"], source, 4326)[0])


def edge_meets_box(e: Column, b: Column) -> Column:
    """Whether an edge meets a box, its boundary included: their bounding boxes meet and the edge's line does not pass the box on one side."""
    p, q = e["p"], e["q"]
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    hx, hy, cx, cy = (b["right"] - b["left"]) / 2, (b["top"] - b["bottom"]) / 2, (b["right"] + b["left"]) / 2, (b["top"] + b["bottom"]) / 2
    near = (F.least(p["x"], q["x"]) <= b["right"]) & (F.greatest(p["x"], q["x"]) >= b["left"]) & (F.least(p["y"], q["y"]) <= b["top"]) & (F.greatest(p["y"], q["y"]) >= b["bottom"])
    return near & (F.abs(dx * (cy - p["y"]) - dy * (cx - p["x"])) <= F.abs(dx) * hy + F.abs(dy) * hx)


def meets_box(g: Column, b: Column) -> Column:
    """Whether a polygon and a box share a point: an edge meets the box, or the box lies inside."""
    from .scalar import let

    return let(edges(g), lambda e: edges_meet_box(e, b))


def edges_meet_box(all_edges: Column, b: Column) -> Column:
    """``meets_box`` on edges computed before."""
    from .scalar import let

    def test(c: Column) -> Column:
        return F.exists(all_edges, lambda e: edge_meets_box(e, c)) | inside(all_edges, (c["right"] + c["left"]) / 2, (c["top"] + c["bottom"]) / 2)

    return let(b, test)

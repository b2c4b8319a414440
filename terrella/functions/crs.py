"""Coordinate reference systems: a registry of closed-form projections as Column expressions.

Geographic coordinates are degrees, x = longitude. Every projected system here is reached from and to WGS 84 / GRS 80
longitude and latitude by exact formulas or convergent series; there are no datum grids. A null or NaN in one coordinate
makes both NaN. An unknown system raises ``UnsupportedCRS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]
RAD, DEG = math.pi / 180.0, 180.0 / math.pi


class UnsupportedCRS(ValueError):
    pass


@dataclass(frozen=True)
class CRS:
    """A registered system; equal when authority codes are, or, without one, the canonical texts."""

    name: str
    epsg: int | None
    kind: str
    a: float
    rf: float
    units: tuple[str, str]
    area: tuple[float, float, float, float] | None
    params: tuple = ()

    @property
    def geographic(self) -> bool:
        return self.kind == "geographic"

    @property
    def projected(self) -> bool:
        return not self.geographic

    @property
    def dimensions(self) -> tuple[str, str]:
        return ("latitude", "longitude") if self.geographic else ("y", "x")

    @property
    def semi_major_axis(self) -> float:
        return self.a

    @property
    def semi_minor_axis(self) -> float:
        return self.a * (1 - 1 / self.rf) if self.rf else self.a

    @property
    def inverse_flattening(self) -> float:
        return self.rf

    @property
    def authority(self) -> tuple[str, str]:
        return ("EPSG", str(self.epsg)) if self.epsg else ("", "")

    @property
    def valid_region(self) -> tuple[float, float, float, float] | None:
        return self.area

    def to_epsg(self) -> int | None:
        return self.epsg

    def to_wkt(self, pretty: bool = False) -> str:
        """A WKT2 outline: name, ellipsoid, identifier."""
        ellipsoid = f'ELLIPSOID["a={self.a:.10g}",{self.a:.10g},{self.rf:.10g}]'
        kind = "GEOGCRS" if self.geographic else "PROJCRS"
        parts = [f'"{self.name}"', ellipsoid, *([f'ID["EPSG",{self.epsg}]'] if self.epsg else [])]
        return f"{kind}[{(',' + chr(10) + '    ').join(parts) if pretty else ','.join(parts)}]"

    def __str__(self) -> str:
        return f"EPSG:{self.epsg}" if self.epsg else self.name

    def __eq__(self, other: object) -> bool:
        try:
            o = crs(other)  # type: ignore[arg-type]
        except (ValueError, TypeError):
            return False
        return self.epsg == o.epsg if self.epsg and o.epsg else self.name == o.name

    def __hash__(self) -> int:
        return hash(self.epsg or self.name)


WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)
#: Closed-form systems and their areas of use (fixed values of the public registry).
FIXED = {
    4326: ("WGS 84", "geographic", *WGS84, (-180.0, -90.0, 180.0, 90.0), ()),
    4283: ("GDA94", "geographic", *GRS80, (93.41, -60.55, 173.34, -8.47), ()),
    3857: ("WGS 84 / Pseudo-Mercator", "mercator", *WGS84, (-180.0, -85.06, 180.0, 85.06), ()),
    6933: ("WGS 84 / NSIDC EASE-Grid 2.0 Global", "cea", *WGS84, (-180.0, -86.0, 180.0, 86.0), (0.0, 30.0)),
    3577: ("GDA94 / Australian Albers", "albers", *GRS80, (112.85, -43.7, 153.69, -9.86), (132.0, 0.0, -18.0, -36.0, 0.0, 0.0)),
    5070: ("NAD83 / Conus Albers", "albers", *GRS80, (-124.79, 24.41, -66.91, 49.38), (-96.0, 23.0, 29.5, 45.5, 0.0, 0.0)),
}


@lru_cache(maxsize=512)
def _lookup(key: str) -> CRS:
    text = key.strip()
    low = text.lower()
    if low.startswith("epsg"):
        low = low[4:].lstrip(":")
    if low.isdigit():
        code = int(low)
        if code in FIXED:
            name, kind, a, rf, area, params = FIXED[code]
            units = ("degrees_north", "degrees_east") if kind == "geographic" else ("metre", "metre")
            return CRS(name, code, kind, a, rf, units, area, params)
        zone, south = code % 100, code // 100 == 327
        if code // 100 in (326, 327) and 1 <= zone <= 60:
            west = 6.0 * zone - 186.0
            area = (west, -80.0, west + 6, 0.0) if south else (west, 0.0, west + 6, 84.0)
            return CRS(f"WGS 84 / UTM zone {zone}{'S' if south else 'N'}", code, "utm", *WGS84, ("metre", "metre"), area, (zone, south))
    if low in ("sinusoidal", "esri:54008", "modis"):
        return CRS("sinusoidal", None, "sinusoidal", 6371007.181, 0.0, ("metre", "metre"), (-180.0, -90.0, 180.0, 90.0), (0.0,))
    if low in ("ogc:crs84", "crs84", "wgs84"):
        return _lookup("4326")
    raise UnsupportedCRS(f"not a registered reference system: {text}")


def crs(spec: int | str | CRS) -> CRS:
    """Resolve an EPSG number, 'EPSG:n', 'sinusoidal' or a CRS."""
    return spec if isinstance(spec, CRS) else _lookup(str(spec))


def norm_crs(spec, lonlat: tuple[float, float] | None = None) -> CRS | None:
    """As ``crs``; None passes; 'utm', 'utm-n' and 'utm-s' need a place."""
    if spec is None:
        return None
    if isinstance(spec, str) and spec.lower() in ("utm", "utm-n", "utm-s"):
        if lonlat is None:
            raise ValueError("utm needs a longitude and latitude")
        code = utm_epsg(*lonlat)
        north = spec.lower() == "utm-n" or (spec.lower() == "utm" and code < 32700)
        return crs(code % 100 + (32600 if north else 32700))
    return crs(spec)


def norm_crs_or_error(spec, lonlat: tuple[float, float] | None = None) -> CRS:
    if spec is None:
        raise ValueError("a reference system is required")
    return norm_crs(spec, lonlat)  # type: ignore[return-value]


def utm_epsg(lon: float, lat: float) -> int:
    return (32600 if lat >= 0 else 32700) + min(60, math.floor((lon + 180) / 6) + 1)


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of each point's UTM zone."""
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + F.least(F.lit(60).cast("long"), F.floor((lon + 180) / 6) + 1)).cast("int")


def utm_for_box(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """EPSG code of the zone that shares most of a lon/lat box: candidate zones of both hemispheres, the smallest code first among equals."""
    first = F.greatest(F.lit(1).cast("long"), F.floor((left + 180) / 6) + 1)
    last = F.least(F.lit(60).cast("long"), F.floor((right + 180) / 6) + 1)

    def shared(z: Column) -> Column:
        west = z * 6.0 - 186.0
        w = F.greatest(F.lit(0.0), F.least(right, west + 6) - F.greatest(left, west))
        n = F.greatest(F.lit(0.0), F.least(top, F.lit(84.0)) - F.greatest(bottom, F.lit(0.0)))
        s = F.greatest(F.lit(0.0), F.least(top, F.lit(0.0)) - F.greatest(bottom, F.lit(-80.0)))
        return F.array(F.struct((w * n).alias("share"), (-(z + 32600)).alias("code")), F.struct((w * s).alias("share"), (-(z + 32700)).alias("code")))

    best = F.array_max(F.flatten(F.transform(F.sequence(first, last), shared)))
    return (-best["code"]).cast("int")


def _e2(rf: float) -> float:
    f = 1 / rf if rf else 0.0
    return f * (2 - f)


def _q(s: Column, e: float) -> Column:
    """Authalic function of sin(latitude)."""
    if not e:
        return s * 2
    es = s * e
    return (1 - e * e) * (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * e))


def _q_number(s: float, e: float) -> float:
    es = s * e
    return (1 - e * e) * (s / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * e)) if e else 2 * s


def _latitude_of_q(q: Column, e: float, qp: float) -> Column:
    """Latitude (radians) by the series in the authalic latitude."""
    beta = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), q / qp)))
    e2, e4, e6 = e**2, e**4, e**6
    return beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(beta * 2) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(beta * 4) + 761 * e6 / 45360 * F.sin(beta * 6)


def _mercator(c: CRS) -> tuple[Callable, Callable]:
    r = c.a
    # degrees to radians first: at a tile's edge, the product in another order may fall short of it
    fwd = lambda x, y: (x * RAD * r, F.log(F.tan(y * (RAD / 2) + math.pi / 4)) * r)
    inv = lambda x, y: (x / r * DEG, (F.atan(F.exp(y / r)) * 2 - math.pi / 2) * DEG)
    return fwd, inv


def _cea(c: CRS) -> tuple[Callable, Callable]:
    lon0, lat1 = c.params
    e = math.sqrt(_e2(c.rf))
    s1 = math.sin(lat1 * RAD)
    k = math.cos(lat1 * RAD) / math.sqrt(1 - e * e * s1 * s1)
    qp = _q_number(1.0, e)
    fwd = lambda x, y: ((x - lon0) * (RAD * c.a * k), _q(F.sin(y * RAD), e) * (c.a / (2 * k)))
    inv = lambda x, y: (x / (c.a * k) * DEG + lon0, _latitude_of_q(y * (2 * k / c.a), e, qp) * DEG)
    return fwd, inv


def _albers(c: CRS) -> tuple[Callable, Callable]:
    lon0, lat0, lat1, lat2, fe, fn = c.params
    e = math.sqrt(_e2(c.rf))
    m = lambda d: math.cos(d * RAD) / math.sqrt(1 - (e * math.sin(d * RAD)) ** 2)
    q = lambda d: _q_number(math.sin(d * RAD), e)
    n = (m(lat1) ** 2 - m(lat2) ** 2) / (q(lat2) - q(lat1))
    big = m(lat1) ** 2 + n * q(lat1)
    rho0 = c.a * math.sqrt(big - n * q(lat0)) / n
    qp = _q_number(1.0, e)
    sign = 1.0 if n > 0 else -1.0

    def fwd(x: Column, y: Column) -> Pair:
        rho = F.sqrt(big - n * _q(F.sin(y * RAD), e)) * (c.a / n)
        t = (x - lon0) * (RAD * n)
        return rho * F.sin(t) + fe, rho0 - rho * F.cos(t) + fn

    def inv(x: Column, y: Column) -> Pair:
        dx, dy = (x - fe) * sign, (rho0 - (y - fn)) * sign
        rho2 = dx * dx + dy * dy
        lat = _latitude_of_q((big - rho2 * (n * n / (c.a * c.a))) / n, e, qp)
        return F.atan2(dx, dy) / n * DEG + lon0, lat * DEG

    return fwd, inv


def _sinusoidal(c: CRS) -> tuple[Callable, Callable]:
    (lon0,) = c.params
    r = c.a
    fwd = lambda x, y: ((x - lon0) * (RAD * r) * F.cos(y * RAD), y * (RAD * r))
    inv = lambda x, y: (F.try_divide(x, F.cos(y / r) * r) * DEG + lon0, y / r * DEG)
    return fwd, inv


def _krueger(c: CRS) -> tuple[Callable[[Column, Column], Column], Callable[[Column, Column], Column]]:
    """Transverse Mercator by Krueger's series to the third order in the third flattening: struct(x, y) each way.

    Every intermediate that the series use more than once is bound, so it is computed once a row.
    """
    from .scalar import let

    zone, south = c.params
    lon0, k0, fe, fn = zone * 6.0 - 183.0, 0.9996, 500000.0, 10000000.0 if south else 0.0
    f = 1 / c.rf
    n = f / (2 - f)
    radius = c.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    e = 2 * math.sqrt(n) / (1 + n)

    def series(p: Column, sign: float, terms: tuple) -> tuple[Column, Column]:
        xi, eta = p["xi"], p["eta"]
        for j, a in enumerate(terms, 1):
            xi = xi + F.sin(p["xi"] * (2 * j)) * F.cosh(p["eta"] * (2 * j)) * (sign * a)
            eta = eta + F.cos(p["xi"] * (2 * j)) * F.sinh(p["eta"] * (2 * j)) * (sign * a)
        return xi, eta

    def fwd(x: Column, y: Column) -> Column:
        def place(p: Column) -> Column:
            xi, eta = series(p, 1.0, alpha)
            return F.struct((eta * (k0 * radius) + fe).alias("x"), (xi * (k0 * radius) + fn).alias("y"))

        sphere = lambda p: F.struct(F.atan2(p["t"], F.cos(p["lam"])).alias("xi"), F.atanh(F.sin(p["lam"]) / F.sqrt(p["t"] * p["t"] + 1)).alias("eta"))
        t = let(F.sin(y * RAD), lambda s: F.sinh(F.atanh(s) - F.atanh(s * e) * e))
        return let(let(F.struct(((x - lon0) * RAD).alias("lam"), t.alias("t")), sphere), place)

    def inv(x: Column, y: Column) -> Column:
        def place(p: Column) -> Column:
            def last(chi: Column) -> Column:
                lat = chi
                for j, d in enumerate(delta, 1):
                    lat = lat + F.sin(chi * (2 * j)) * d
                return F.struct((F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])) * DEG + lon0).alias("x"), (lat * DEG).alias("y"))

            return let(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])), last)

        plain = F.struct(((y - fn) / (k0 * radius)).alias("xi"), ((x - fe) / (k0 * radius)).alias("eta"))
        return let(let(plain, lambda p: F.struct(*(v.alias(k) for k, v in zip(("xi", "eta"), series(p, -1.0, beta))))), place)

    return fwd, inv


def _utm(c: CRS) -> tuple[Callable, Callable]:
    def pair(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Pair]:
        def run(x: Column, y: Column) -> Pair:
            p = f(x, y)
            return p["x"], p["y"]

        return run

    fwd, inv = _krueger(c)
    return pair(fwd), pair(inv)


_MAKE = {"mercator": _mercator, "cea": _cea, "albers": _albers, "sinusoidal": _sinusoidal, "utm": _utm}


def transform(x: Column, y: Column, source, target) -> Pair:
    """Project columns; the same system is the identity, else through longitude and latitude."""
    s, t = crs(source), crs(target)
    if s == t or (s.geographic and t.geographic):
        return x, y
    bad = x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y)
    px, py = x, y
    if not s.geographic:
        px, py = _MAKE[s.kind](s)[1](px, py)
    if not t.geographic:
        px, py = _MAKE[t.kind](t)[0](px, py)
    nan = F.lit(float("nan"))
    return F.when(bad, nan).otherwise(px), F.when(bad, nan).otherwise(py)


def _lost(x: Column, y: Column) -> Column:
    return x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y)


def to_own_utm(lon: Column, lat: Column) -> Column:
    """struct(epsg, x, y): each place in its own UTM zone. Zones differ by their meridian alone, so one zone's formula serves all."""
    from .scalar import let

    fwd, nan = _krueger(crs(32631))[0], F.lit(float("nan"))

    def place(z: Column) -> Column:
        bad = _lost(lon, lat)
        found = let(fwd(lon - ((z % 100) * 6 - 183) + 3, lat), lambda p: F.struct(z.alias("epsg"), p["x"].alias("x"), F.when(z >= 32700, p["y"] + 10000000.0).otherwise(p["y"]).alias("y")))
        return F.when(bad, F.struct(z.alias("epsg"), nan.alias("x"), nan.alias("y"))).otherwise(found)

    return let(utm_zone(lon, lat), place)


def from_own_utm(epsg: Column, x: Column, y: Column) -> Column:
    """struct(lon, lat) of a place in the UTM zone of its row."""
    from .scalar import let

    inv, nan = _krueger(crs(32631))[1], F.lit(float("nan"))
    found = let(inv(x, F.when(epsg >= 32700, y - 10000000.0).otherwise(y)), lambda p: F.struct((p["x"] - 3 + ((epsg % 100) * 6 - 183)).alias("lon"), p["y"].alias("lat")))
    return F.when(_lost(x, y), F.struct(nan.alias("lon"), nan.alias("lat"))).otherwise(found)


def units_per_degree(target, lon: Column, lat: Column, step: float = 0.1) -> Column:
    """Units of a system per degree of longitude at a place, over a step that turns west at the antimeridian."""
    other = F.when(lon + step <= 180, lon + step).otherwise(lon - step)
    x0, y0 = transform(lon, lat, 4326, target)
    x1, y1 = transform(other, lat, 4326, target)
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / step


def projected_lon(target, lon: float, lat: tuple[float, float] = (-90.0, 90.0), step: float = 1.0) -> Column:
    """Array of struct(x, y): a meridian in a system, its finite points."""
    n = max(int(math.ceil((lat[1] - lat[0]) / step)), 1)
    path = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.least((F.lit(lat[0]) + i * step).cast("float").cast("double"), F.lit(lat[1])))

    def point(v: Column) -> Column:
        x, y = transform(F.lit(lon), v, 4326, target)
        return F.struct(x.alias("x"), y.alias("y"))

    big = F.lit(float("inf"))
    return F.filter(F.transform(path, point), lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < big) & (F.abs(p["y"]) < big))

"""Driver-side values: pairs, shapes, resolutions, anchors. They become literals in plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from enum import Enum
from typing import Any


class CRSMismatch(ValueError):
    """Operands are in different coordinate reference systems."""


class _Unset:
    """Not supplied, as opposed to None."""

    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "UNSET"


UNSET = _Unset()


class Anchor(Enum):
    """Where pixel edges or centres are aligned to the axes."""

    EDGE = 0.0
    CENTER = 0.5
    FLOATING = None


@dataclass(frozen=True)
class XY:
    """An immutable pair; the accessors name the order."""

    x: Any
    y: Any

    @property
    def xy(self) -> tuple:
        return self.x, self.y

    @property
    def yx(self) -> tuple:
        return self.y, self.x

    lonlat = xy
    latlon = yx

    def map(self, op: Callable) -> XY:
        return XY(op(self.x), op(self.y))

    @property
    def aspect(self) -> float:
        return self.x / self.y


@dataclass(frozen=True)
class Resolution(XY):
    """Pixel size; one number means square pixels with Y upside down."""

    x: float
    y: float = UNSET  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.y is UNSET:
            object.__setattr__(self, "y", -self.x)


@dataclass(frozen=True)
class Index2d(XY):
    pass


@dataclass(frozen=True)
class Shape2d(XY):
    """Rows and columns; iterates and compares as (y, x)."""

    @property
    def shape(self) -> tuple[int, int]:
        return self.y, self.x

    @property
    def wh(self) -> tuple[int, int]:
        return self.x, self.y

    def shrink2(self) -> Shape2d:
        return Shape2d(self.x // 2, self.y // 2)

    def __iter__(self) -> Iterator[int]:
        return iter(self.shape)

    def __len__(self) -> int:
        return 2

    def __getitem__(self, i: int) -> int:
        return self.shape[i]

    def __eq__(self, other: object) -> bool:
        return self.shape == tuple(other) if isinstance(other, (tuple, list, Shape2d)) else NotImplemented

    def __hash__(self) -> int:
        return hash(self.shape)


def _pair(a: Any, b: Any, kind: type, swap: bool) -> Any:
    if b is None:
        if isinstance(a, XY):
            return a if isinstance(a, kind) else kind(a.x, a.y)
        if not isinstance(a, Iterable):
            raise ValueError("one number is not a pair")
        a, b = a
    return kind(b, a) if swap else kind(a, b)


def xy_(x: Any, y: Any = None) -> XY:
    return _pair(x, y, XY, False)


def yx_(y: Any, x: Any = None) -> XY:
    return _pair(y, x, XY, True)


def ixy_(x: Any, y: Any = None) -> Index2d:
    return _pair(x, y, Index2d, False)


def iyx_(y: Any, x: Any = None) -> Index2d:
    return _pair(y, x, Index2d, True)


def res_(x: Any) -> Resolution:
    if isinstance(x, Resolution):
        return x
    if isinstance(x, (int, float)):
        return Resolution(float(x))
    raise ValueError("a resolution is a number or made by resxy_/resyx_")


def resxy_(x: float, y: float) -> Resolution:
    return Resolution(x, y)


def resyx_(y: float, x: float) -> Resolution:
    return Resolution(x, y)


def wh_(w: int, h: int) -> Shape2d:
    return Shape2d(w, h)


def shape_(x: Any) -> Shape2d:
    if isinstance(x, Shape2d):
        return x
    if isinstance(x, XY):
        return Shape2d(x.x, x.y)
    ny, nx = x
    return Shape2d(int(nx), int(ny))


class func2map:
    """A function as a mapping, over known keys if given."""

    def __init__(self, f: Callable, keys: Iterable | None = None):
        self._f, self._keys = f, None if keys is None else list(keys)

    def __getitem__(self, k: Any) -> Any:
        return self._f(k)

    def __iter__(self) -> Iterator:
        if self._keys is None:
            raise TypeError("keys are not known")
        return iter(self._keys)

    def __len__(self) -> int:
        return len(self._keys or ())


@dataclass(frozen=True)
class Affine:
    """world = A * pixel: x' = a x + b y + c, y' = d x + e y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @classmethod
    def translation(cls, x: float, y: float) -> Affine:
        return cls(c=x, f=y)

    @classmethod
    def scale(cls, x: float, y: float | None = None) -> Affine:
        return cls(a=x, e=x if y is None else y)

    @classmethod
    def rotation(cls, degrees: float) -> Affine:
        from math import cos, radians, sin

        s, k = sin(radians(degrees)), cos(radians(degrees))
        return cls(k, -s, 0.0, s, k, 0.0)

    def __mul__(self, o: Any) -> Any:
        if isinstance(o, Affine):
            return Affine(
                self.a * o.a + self.b * o.d, self.a * o.b + self.b * o.e, self.a * o.c + self.b * o.f + self.c,
                self.d * o.a + self.e * o.d, self.d * o.b + self.e * o.e, self.d * o.c + self.e * o.f + self.f,
            )
        x, y = o
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def __invert__(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    def tuple(self) -> tuple[float, ...]:
        return self.a, self.b, self.c, self.d, self.e, self.f

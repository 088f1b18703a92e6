"""Points, boxes and affine maps: as Columns of structs, and as plain values for workers and tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import f32, finite


@dataclass(frozen=True)
class Point:
    x: float
    y: float


@dataclass(frozen=True)
class BBox:
    x0: float
    top: float
    x1: float
    bottom: float

    def width(self) -> float:
        return self.x1 - self.x0

    def height(self) -> float:
        return self.bottom - self.top

    def merge(self, other: BBox) -> BBox:
        """Union; a NaN edge gives way to the other box's."""

        def pick(f, a, b):
            return b if math.isnan(a) else a if math.isnan(b) else f(a, b)

        return BBox(pick(min, self.x0, other.x0), pick(min, self.top, other.top), pick(max, self.x1, other.x1), pick(max, self.bottom, other.bottom))


@dataclass(frozen=True)
class Matrix:
    """x' = a x + c y + e, y' = b x + d y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    @classmethod
    def translation(cls, x: float, y: float) -> Matrix:
        return cls(e=x, f=y)

    @classmethod
    def scale(cls, x: float, y: float) -> Matrix:
        return cls(a=x, d=y)

    def then(self, n: Matrix) -> Matrix:
        """First this map, then ``n``."""
        return Matrix(
            self.a * n.a + self.b * n.c,
            self.a * n.b + self.b * n.d,
            self.c * n.a + self.d * n.c,
            self.c * n.b + self.d * n.d,
            self.e * n.a + self.f * n.c + n.e,
            self.e * n.b + self.f * n.d + n.f,
        )

    def pre_translate(self, x: float, y: float) -> Matrix:
        return Matrix.translation(x, y).then(self)

    def transform(self, p: Point) -> Point:
        return Point(self.a * p.x + self.c * p.y + self.e, self.b * p.x + self.d * p.y + self.f)

    def x_scale(self) -> float:
        return math.hypot(self.a, self.b)

    def y_scale(self) -> float:
        return math.hypot(self.c, self.d)

    def is_upright(self) -> bool:
        s = max(self.x_scale(), self.y_scale())
        if not math.isfinite(s) or s <= 1e-6 or self.d == 0 or any(map(math.isnan, (self.a, self.b, self.c, self.d))):
            return False
        return abs(self.b) / s < 0.01 and abs(self.c) / s < 0.01 and self.a > 0


IDENTITY = Matrix()


def matrix(*six) -> Column:
    return F.struct(*(f32(v).alias(n) for n, v in zip("abcdef", six, strict=True)))


def then(m: Column, n: Column) -> Column:
    """Struct of the map ``m`` followed by ``n``."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def transform_x(m: Column, x: Column, y: Column) -> Column:
    return m["a"] * x + m["c"] * y + m["e"]


def transform_y(m: Column, x: Column, y: Column) -> Column:
    return m["b"] * x + m["d"] * y + m["f"]


def x_scale(m: Column) -> Column:
    return f32(F.sqrt(m["a"] * m["a"] + m["b"] * m["b"]))


def y_scale(m: Column) -> Column:
    return f32(F.sqrt(m["c"] * m["c"] + m["d"] * m["d"]))


def is_upright(m: Column) -> Column:
    s = F.greatest(x_scale(m), y_scale(m))
    known = finite(s) & (s > f32(1e-6)) & (m["d"] != 0)
    safe = F.when(known, s).otherwise(f32(1.0))
    return known & (f32(F.abs(m["b"]) / safe) < f32(0.01)) & (f32(F.abs(m["c"]) / safe) < f32(0.01)) & (m["a"] > 0)


def merge_boxes(x0: Column, top: Column, x1: Column, bottom: Column) -> list[Column]:
    """Aggregates for the union of boxes; NaN edges are left out."""

    def known(c: Column) -> Column:
        return F.when(~F.isnan(c), c)

    return [F.min(known(x0)).alias("x0"), F.min(known(top)).alias("top"), F.max(known(x1)).alias("x1"), F.max(known(bottom)).alias("bottom")]


def page_transform(width: float, height: float, origin_x: float, origin_y: float, rotation: int) -> Matrix:
    """Map of default user space to the displayed page, by the media size and the page's rotation."""
    turn = {90: (0, -1, 1, 0, 0, width), 180: (-1, 0, 0, -1, width, height), 270: (0, 1, -1, 0, height, 0)}
    moved = Matrix.translation(-origin_x, -origin_y)
    return moved.then(Matrix(*turn[rotation])) if rotation in turn else moved

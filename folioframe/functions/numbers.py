"""Number expressions whose NaN behaviour is that of IEEE comparisons, which Spark's own are not."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def ordered(*values: Column) -> Column:
    """True if no value is NaN; null values give null."""
    out = ~F.isnan(values[0])
    for v in values[1:]:
        out = out & ~F.isnan(v)
    return out


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def greater(a: Column, b: Column) -> Column:
    """a > b, false if either is NaN."""
    return ordered(a, b) & (a > b)


def min_finite(value: Column) -> Column:
    """Aggregate: least finite value, null if none."""
    return F.min(F.when(finite(value), value))


def max_finite(value: Column) -> Column:
    return F.max(F.when(finite(value), value))


GRID_LIMIT = 20_000


def grid_position(distance: Column, density: float) -> Column:
    """Cell of a distance: rounded half away from zero, 0 to GRID_LIMIT, NaN as 0. Clamped before the cast."""
    cells = f32(distance / f32(density))
    cells = F.when(F.isnan(cells), f32(0.0)).otherwise(F.greatest(F.least(cells, f32(float(GRID_LIMIT) + 1)), f32(-1.0)))
    return F.greatest(F.least(F.round(cells), F.lit(float(GRID_LIMIT))), F.lit(0.0)).cast("int")


def same_line(a: Column, b: Column, tolerance: float) -> Column:
    """|a - b| <= tolerance, false if anything is NaN."""
    if math.isnan(tolerance):
        return F.lit(False)
    return ordered(a, b) & ~F.isnan(a - b) & (F.abs(a - b) <= f32(tolerance))

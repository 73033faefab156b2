"""Box arithmetic on (x1, y1, x2, y2) columns, addressed by a column prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2"))


def width(b) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0])


def height(b) -> Column:
    return F.greatest(F.lit(0.0), b[3] - b[1])


def area(b) -> Column:
    return width(b) * height(b)


def center(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def intersection(a, b) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(
        F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a, b) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def containment(inner, outer) -> Column:
    inter = intersection(inner, outer)
    return F.when((inter > 0) & (area(inner) > 0), inter / area(inner)).otherwise(0.0)


def x_overlap(a, b) -> Column:
    """Overlap of the x-intervals relative to the narrower box."""
    over = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    narrow = F.least(width(a), width(b))
    return F.when((over > 0) & (narrow > 0), over / narrow).otherwise(0.0)


def y_overlap(a, b) -> Column:
    over = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    low = F.least(height(a), height(b))
    return F.when((over > 0) & (low > 0), over / low).otherwise(0.0)


def same_row(a, b) -> Column:
    flat = (a[3] <= a[1]) | (b[3] <= b[1])
    tol = F.greatest(a[3] - a[1], b[3] - b[1]) * 0.55
    return flat | (F.abs(center(a)[1] - center(b)[1]) <= tol)


def same_column_band(a, b) -> Column:
    gap = F.abs(center(a)[0] - center(b)[0])
    return (x_overlap(a, b) >= 0.28) | (gap <= F.least(width(a), width(b)) * 0.38)


def same_column(a, b) -> Column:
    return same_row(a, b) & same_column_band(a, b)


def cap_fragment(inner, outer) -> Column:
    """A cap or tag band on the upper part of a pack body."""
    band = outer[1] + height(outer) * 0.48
    return (height(outer) > 0) & (center(inner)[1] <= band) & (x_overlap(inner, outer) >= 0.30) & (
        area(inner) / F.nullif(area(outer), F.lit(0.0)) <= 0.55)


def union_box(a, b) -> tuple[Column, Column, Column, Column]:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def to_pixels(values: Column, w: Column, h: Column) -> Column:
    """Pixel box from four numbers that are either all in 0..1 or already pixels."""
    bad = F.size(values) != 4
    unit = F.forall(values, lambda v: (v >= 0) & (v <= 1))
    scaled = F.array(*[(values[i] * (w if i % 2 == 0 else h)).cast("int") for i in range(4)])
    plain = F.transform(values, lambda v: v.cast("int"))
    return F.when(bad, F.array(*[F.lit(0)] * 4)).when(unit, scaled).otherwise(plain)

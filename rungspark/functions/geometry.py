"""Column functions on boxes (centre and size), points and segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """Centres into [0, 1], sizes into [1e-4, 1]."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    size = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1.0))
    return [unit(cx), unit(cy), size(w), size(h)]


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (cx, cy, w, h); 0 if both are empty."""
    side = lambda c1, s1, c2, s2: F.greatest(F.least(c1 + s1 / 2, c2 + s2 / 2) - F.greatest(c1 - s1 / 2, c2 - s2 / 2), F.lit(0.0))
    both = side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def inside(px: Column, py: Column, box: tuple[Column, ...], margin: float = 0.0) -> Column:
    return (F.abs(px - box[0]) <= box[2] / 2 + margin) & (F.abs(py - box[1]) <= box[3] / 2 + margin)


def to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment. On an axis-parallel one the foot is cut to its ends, without a division, so that equal distances are equal."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    cut = lambda p, a, b: F.greatest(F.least(p, F.greatest(a, b)), F.least(a, b))
    fx, fy = (F.when((dx == 0) | (dy == 0), cut(p, a, b)).otherwise(a + t * d) for p, a, b, d in ((px, x0, x1, dx), (py, y0, y1, dy)))
    return F.sqrt((px - fx) ** 2 + (py - fy) ** 2)


def clips(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[Column, ...]) -> Column:
    """Whether a segment meets a box: the ranges of its parameter on both axes and [0, 1] overlap."""
    def span(p: Column, d: Column, c: Column, s: Column) -> tuple[Column, Column]:
        a, b = (c - s / 2 - p) / d, (c + s / 2 - p) / d
        hit = F.abs(p - c) <= s / 2
        return (
            F.when(d != 0, F.least(a, b)).when(hit, F.lit(0.0)).otherwise(F.lit(2.0)),
            F.when(d != 0, F.greatest(a, b)).when(hit, F.lit(1.0)).otherwise(F.lit(-1.0)),
        )

    ax, bx = span(x0, x1 - x0, box[0], box[2])
    ay, by = span(y0, y1 - y0, box[1], box[3])
    return F.greatest(ax, ay, F.lit(0.0)) <= F.least(bx, by, F.lit(1.0))


def rotated(cx: Column, cy: Column, w: Column, h: Column, degrees: int) -> list[Column]:
    """A box on a unit page turned clockwise by 0, 90, 180 or 270 degrees."""
    return {0: [cx, cy, w, h], 90: [1 - cy, cx, h, w], 180: [1 - cx, 1 - cy, w, h], 270: [cy, 1 - cx, h, w]}[degrees % 360]

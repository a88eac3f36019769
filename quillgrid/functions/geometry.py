"""Boxes, points, intervals and quads as column expressions.

A box is four columns (x1, y1, x2, y2); a quad is an array of eight numbers.  Rounding follows the
half-even rule where the inventory says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str) -> Box:
    """The four columns of a box by their common prefix."""
    return tuple(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def d(v: float) -> Column:
    return F.lit(float(v))


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def half_down(c: Column) -> Column:
    """Round, a half goes down."""
    return F.when(c - F.floor(c) > 0.5, F.floor(c) + 1).otherwise(F.floor(c)).cast("double")


def scale_to_image(b: Box, sx: float, sy: float, height: float) -> Box:
    """Page to image: x is scaled, y is mirrored at the page height and scaled, both are rounded half-even."""
    x1, y1, x2, y2 = b
    fx, fy = (lambda v: half_even(v * d(sx))), (lambda v: half_even(F.abs(v - d(height)) * d(sy)))
    return fx(x1), fy(y1), fx(x2), fy(y2)


def scale_unrounded(b: Box, sx: float, sy: float, height: float) -> Box:
    x1, y1, x2, y2 = b
    fx, fy = (lambda v: v * d(sx)), (lambda v: F.abs(v - d(height)) * d(sy))
    return fx(x1), fy(y1), fx(x2), fy(y2)


def quad(b: Box) -> Column:
    """The eight numbers of a box, clockwise from its first corner."""
    x1, y1, x2, y2 = b
    return F.array(x1, y1, x2, y1, x2, y2, x1, y2)


def area(b: Box) -> Column:
    x1, y1, x2, y2 = b
    return (x2 - x1) * (y2 - y1)


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection, 0 if the boxes are apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(d(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 if the boxes touch or are apart."""
    o = overlap(a, b)
    return F.when(o > 0, o / (area(a) + area(b) - o)).otherwise(d(0))


def iou_eps(a: Box, b: Box, eps: float = 1e-6) -> Column:
    o = overlap(a, b)
    return o / (F.abs(area(a)) + F.abs(area(b)) - o + d(eps))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return overlap(a, b) / F.least(area(a), area(b))


def hull_iou(a: Box, b: Box) -> Column:
    """Intersection over the area of the convex hull of two upright boxes.

    The hull is the frame of both less the corner triangles that neither box reaches.
    """
    fx1, fy1, fx2, fy2 = F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])
    frame = (fx2 - fx1) * (fy2 - fy1)
    cut = d(0)
    for ix, iy, edge_x, edge_y in ((0, 1, fx1, fy1), (2, 1, fx2, fy1), (2, 3, fx2, fy2), (0, 3, fx1, fy2)):
        # in this corner one box gives the x extreme and the other the y extreme, or one gives both
        cut = cut + F.when((a[ix] == edge_x) & (a[iy] == edge_y) | (b[ix] == edge_x) & (b[iy] == edge_y), d(0)).otherwise(
            F.abs(a[ix] - b[ix]) * F.abs(a[iy] - b[iy]) / 2
        )
    return overlap(a, b) / (frame - cut)


def corner_distance(a: Box, b: Box) -> Column:
    """L1 distance of both corners and the smaller of the two once more."""
    first, last = F.abs(b[0] - a[0]) + F.abs(b[1] - a[1]), F.abs(b[2] - a[2]) + F.abs(b[3] - a[3])
    return F.abs(b[0] - a[0]) + F.abs(b[1] - a[1]) + F.abs(b[2] - a[2]) + F.abs(b[3] - a[3]) + F.least(first, last)


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def point_line_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.abs(px * dy - py * dx + x2 * y1 - y2 * x1) / (F.sqrt(dx * dx + dy * dy) + d(1e-6))


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def near(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) < tol


def close(a: Column, b: Column, tol: float) -> Column:
    """Absolute tolerance and a relative one of 1e-5 of the second value."""
    return F.abs(a - b) <= d(tol) + d(1e-5) * F.abs(b)


def point_inside(px: Column, py: Column, b: Box, tol: float = 2) -> Column:
    return px.between(b[0] - tol, b[2] + tol) & py.between(F.least(b[1], b[3]) - tol, F.greatest(b[1], b[3]) + tol)


def box_inside(outer: Box, inner: Box, tol: float = 2) -> Column:
    lo, hi = F.least(outer[1], outer[3]), F.greatest(outer[1], outer[3])
    ilo, ihi = F.least(inner[1], inner[3]), F.greatest(inner[1], inner[3])
    return (inner[0] >= outer[0] - tol) & (inner[2] <= outer[2] + tol) & (ilo >= lo - tol) & (ihi <= hi + tol)


def intervals_match(a0, a1, b0, b1, tol: float = 2, ratio: float = 0.8) -> Column:
    """The first interval lies in the second, or covers ``ratio`` of the second."""
    o = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when((a0 >= b0 - tol) & (a1 <= b1 + tol), F.lit(True)).when(o <= 0, F.lit(False)).otherwise(o / (b1 - b0) >= ratio)


def relation_of_intervals(a0, a1, b0, b1) -> Column:
    """Six ways in which two intervals lie."""
    return (
        F.when(a1 <= b0, 1).when(b1 <= a0, 2).when((a0 >= b0) & (a1 <= b1), 3).when((b0 >= a0) & (b1 <= a1), 4).when(a0 < b0, 5).otherwise(6)
    )


def clip(v: Column, lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else d(x) for x in (lo, hi))
    return F.least(F.greatest(v, lo), hi)


def rotated_corners(cx, cy, w, h, theta) -> list[Column]:
    """Corners of a box of centre, size and angle, clockwise from the first."""
    c, s = F.cos(theta), F.sin(theta)
    out = []
    for sx, sy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
        out += [cx + c * (w * sx) - s * (h * sy), cy + s * (w * sx) + c * (h * sy)]
    return out

"""Column functions on boxes [x, y, w, h] and polygons (flat lists x1, y1, x2, y2, ...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _overlap(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return w * h


def _sides(a: Column, b: Column):
    return [a[i] for i in range(4)] + [b[i] for i in range(4)]


def pixel_iou(a: Column, b: Column) -> Column:
    """Intersection over union of pixel boxes, the union at least one pixel [G2]."""
    inter = _overlap(*_sides(a, b))
    return inter / F.greatest(F.lit(1), a[2] * a[3] + b[2] * b[3] - inter)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union with 1e-9 added to the union [G1]."""
    inter = _overlap(*_sides(a, b))
    return inter / (a[2] * a[3] + b[2] * b[3] - inter + F.lit(1e-9))


def xyxy_to_xywh(b: Column) -> Column:
    return F.array(b[0], b[1], b[2] - b[0], b[3] - b[1])


def polygon_of_box(b: Column) -> Column:
    """The four corners of a box [G10]."""
    return F.array(b[0], b[1], b[0] + b[2], b[1], b[0] + b[2], b[1] + b[3], b[0], b[1] + b[3])


def _at(p: Column, parity: int) -> Column:
    return F.filter(p, lambda v, i: i % 2 == parity)


def polygon_bounds(p: Column) -> Column:
    """[x0, y0, x1, y1], cut to integers; zeros for an empty polygon [G3]."""
    x, y = _at(p, 0), _at(p, 1)
    corners = F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))
    return F.when(F.size(p) > 0, F.transform(corners, lambda v: v.cast("int"))).otherwise(F.array(*[F.lit(0)] * 4))


def aspect_ratio(p: Column) -> Column:
    """Width by height of a polygon's bounds; 1 without a height [G4]."""
    b = polygon_bounds(p)
    return F.when(b[3] - b[1] > 0, (b[2] - b[0]) / (b[3] - b[1])).otherwise(1.0)


def shoelace_area(p: Column) -> Column:
    """Area of one polygon part, halved without remainder [G6]."""
    x, y = _at(p, 0), _at(p, 1)
    rotate = lambda c: F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))
    cross = F.zip_with(F.zip_with(x, rotate(y), lambda a, b: a * b), F.zip_with(y, rotate(x), lambda a, b: a * b), lambda a, b: (a - b).cast("double"))
    return F.floor(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def polygon_centroid(p: Column) -> Column:
    """Mean of the corners [G8]."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    return F.array(mean(_at(p, 0)), mean(_at(p, 1)))


def translate(p: Column, dx, dy) -> Column:
    """A polygon moved by (dx, dy) [G12]."""
    return F.transform(p, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy))


def valid_polygon(p: Column, crowd: Column) -> Column:
    """Not a crowd, and three corners or more [G11]."""
    return (crowd == 0) & (F.size(p) >= 6)

"""Column functions on axis-parallel boxes and points.

A box is four flat columns; predicates are closed, so boxes that touch intersect. An empty
box is one with null coordinates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    min_x: Column
    min_y: Column
    max_x: Column
    max_y: Column

    @property
    def width(self) -> Column:
        return self.max_x - self.min_x

    @property
    def height(self) -> Column:
        return self.max_y - self.min_y

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.min_x + self.max_x) * 0.5

    @property
    def center_y(self) -> Column:
        return (self.min_y + self.max_y) * 0.5

    @property
    def diagonal(self) -> Column:
        return F.sqrt(self.width * self.width + self.height * self.height)


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in ("min_x", "min_y", "max_x", "max_y")])


def normalized(b: Box) -> Box:
    return Box(F.least(b.min_x, b.max_x), F.least(b.min_y, b.max_y), F.greatest(b.min_x, b.max_x), F.greatest(b.min_y, b.max_y))


def inflated(b: Box, d: Column | float) -> Box:
    return Box(b.min_x - d, b.min_y - d, b.max_x + d, b.max_y + d)


def deflated(b: Box, d: float) -> Box:
    """Shrunk by d; an axis that would turn inside out becomes its centre."""
    over_x, over_y = b.min_x + d > b.max_x - d, b.min_y + d > b.max_y - d
    pick = lambda over, center, value: F.when(over, center).otherwise(value)
    return Box(
        pick(over_x, b.center_x, b.min_x + d), pick(over_y, b.center_y, b.min_y + d),
        pick(over_x, b.center_x, b.max_x - d), pick(over_y, b.center_y, b.max_y - d),
    )


def intersects(a: Box, b: Box, tolerance: float = 0.0) -> Column:
    """The tolerance widens both boxes, so gaps up to twice of it count."""
    t = 2 * tolerance
    return (a.max_x + t >= b.min_x) & (b.max_x + t >= a.min_x) & (a.max_y + t >= b.min_y) & (b.max_y + t >= a.min_y)


def contains_point(b: Box, x: Column, y: Column, tolerance: float = 0.0) -> Column:
    o = inflated(b, tolerance) if tolerance else b
    return (x >= o.min_x) & (x <= o.max_x) & (y >= o.min_y) & (y <= o.max_y)


def contains_box(outer: Box, inner: Box, tolerance: float = 0.0) -> Column:
    o = inflated(outer, tolerance) if tolerance else outer
    return (inner.min_x >= o.min_x) & (inner.min_y >= o.min_y) & (inner.max_x <= o.max_x) & (inner.max_y <= o.max_y)


def axis_overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_max, b_max) - F.greatest(a_min, b_min))


def intersection_area(a: Box, b: Box) -> Column:
    return axis_overlap(a.min_x, a.max_x, b.min_x, b.max_x) * axis_overlap(a.min_y, a.max_y, b.min_y, b.max_y)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.min_x, b.min_x), F.least(a.min_y, b.min_y), F.greatest(a.max_x, b.max_x), F.greatest(a.max_y, b.max_y))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area, 0 where either box has no area."""
    common, small = intersection_area(a, b), F.least(a.area, b.area)
    return F.when((common > 0) & (small > 0), common / small).otherwise(F.lit(0.0))


def intersection_over_union(a: Box, b: Box) -> Column:
    common = intersection_area(a, b)
    joint = a.area + b.area - common
    return F.when(joint > 0, common / joint).otherwise(F.lit(0.0))


def axis_gap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return F.greatest(F.lit(0.0), b_min - a_max, a_min - b_max)


def gap_x(a: Box, b: Box) -> Column:
    return axis_gap(a.min_x, a.max_x, b.min_x, b.max_x)


def gap_y(a: Box, b: Box) -> Column:
    return axis_gap(a.min_y, a.max_y, b.min_y, b.max_y)


def box_distance(a: Box, b: Box) -> Column:
    dx, dy = gap_x(a, b), gap_y(a, b)
    return F.sqrt(dx * dx + dy * dy)


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def axis_overlap_ratio(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Overlap of two spans over the smaller one, 0 for a span without length."""
    small = F.least(F.greatest(F.lit(0.0), a_max - a_min), F.greatest(F.lit(0.0), b_max - b_min))
    return F.when(small > 1e-9, axis_overlap(a_min, a_max, b_min, b_max) / small).otherwise(F.lit(0.0))


def x_overlap_ratio(a: Box, b: Box) -> Column:
    return axis_overlap_ratio(a.min_x, a.max_x, b.min_x, b.max_x)


def y_overlap_ratio(a: Box, b: Box) -> Column:
    return axis_overlap_ratio(a.min_y, a.max_y, b.min_y, b.max_y)


def normalized_gap(a: Box, b: Box) -> Column:
    """The larger axis gap over the smaller diagonal (not a Euclidean distance)."""
    return F.greatest(gap_x(a, b), gap_y(a, b)) / F.greatest(F.lit(1e-9), F.least(a.diagonal, b.diagonal))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def ratio_similarity(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top > 0, F.least(a, b) / top).otherwise(F.lit(0.0))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of struct(x, y); null for fewer than three points."""
    n = F.size(points)
    terms = F.transform(
        points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"]
    )
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) * 0.5)


def point_in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Ray casting with the small guard against division by zero."""
    n = F.size(points)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(points, (i + n - 1) % n)
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"] + F.lit(1e-12)) + p["x"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    hits = F.size(F.filter(F.transform(points, crosses), lambda h: h))
    return F.when(n >= 3, hits % 2 == 1).otherwise(F.lit(False))


def normalized_sweep(start: Column, end: Column) -> Column:
    """Sweep in degrees in [0, 360)."""
    return F.pmod(end - start, F.lit(360.0))


def arc_point(cx: Column, cy: Column, r: Column, degrees: Column) -> Column:
    return F.struct((cx + r * F.cos(F.radians(degrees))).alias("x"), (cy + r * F.sin(F.radians(degrees))).alias("y"))


def arc_length(r: Column, sweep: Column) -> Column:
    return r * F.radians(sweep)


def ellipse_perimeter(a: Column, b: Column) -> Column:
    """Ramanujan's approximation."""
    h3 = F.lit(3.0)
    return F.pi() * (h3 * (a + b) - F.sqrt((h3 * a + b) * (a + h3 * b)))

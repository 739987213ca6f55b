"""Plane geometry as column expressions; every argument is a column or a number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: metres in a degree of latitude.
METRES_IN_DEGREE = 111321.377778


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def to_plane(x, y, ref_x, ref_y) -> tuple[Column, Column]:
    """Degrees (x: longitude, y: latitude) to metres around a reference point."""
    x, y, rx, ry = map(_c, (x, y, ref_x, ref_y))
    return F.lit(METRES_IN_DEGREE) * F.cos(F.radians(ry)) * (x - rx), F.lit(METRES_IN_DEGREE) * (y - ry)


def to_degrees(x, y, ref_x, ref_y) -> tuple[Column, Column]:
    x, y, rx, ry = map(_c, (x, y, ref_x, ref_y))
    return x / METRES_IN_DEGREE / F.cos(F.radians(ry)) + rx, y / METRES_IN_DEGREE + ry


def distance(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def cross(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of the triangle a, b, c: positive where c lies left of a to b."""
    ax, ay, bx, by, cx, cy = map(_c, (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def left_turn(ax, ay, bx, by, cx, cy) -> Column:
    return cross(ax, ay, bx, by, cx, cy) > 0


def in_rectangle(x, y, x1, y1, x2, y2) -> Column:
    """Closed rectangle given by two opposite corners."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    return x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))


def on_segment(x, y, x1, y1, x2, y2) -> Column:
    return (cross(x1, y1, x2, y2, x, y) == 0) & in_rectangle(x, y, x1, y1, x2, y2)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy, strict_bbox: bool = False) -> Column:
    """Whether the closed segments ab and cd have a point in common.

    strict_bbox: require their bounding intervals to overlap in more than a point on both axes; then a vertical or
    horizontal segment meets nothing.
    """
    ax, ay, bx, by, cx, cy, dx, dy = map(_c, (ax, ay, bx, by, cx, cy, dx, dy))
    low_x, high_x = F.greatest(F.least(ax, bx), F.least(cx, dx)), F.least(F.greatest(ax, bx), F.greatest(cx, dx))
    low_y, high_y = F.greatest(F.least(ay, by), F.least(cy, dy)), F.least(F.greatest(ay, by), F.greatest(cy, dy))
    near = (low_x < high_x) & (low_y < high_y) if strict_bbox else (low_x <= high_x) & (low_y <= high_y)
    return near & (F.signum(cross(ax, ay, bx, by, cx, cy)) * F.signum(cross(ax, ay, bx, by, dx, dy)) <= 0) & (F.signum(cross(cx, cy, dx, dy, ax, ay)) * F.signum(cross(cx, cy, dx, dy, bx, by)) <= 0)


def meeting_point(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column, Column]:
    """x, y of the lines' common point and its parameter on ab (0 at a, 1 at b); null where they are parallel."""
    ax, ay, bx, by, cx, cy, dx, dy = map(_c, (ax, ay, bx, by, cx, cy, dx, dy))
    down = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.when(down != 0, down)
    return ax + t * (bx - ax), ay + t * (by - ay), t


def slope(x1, y1, x2, y2) -> Column:
    """Null for a vertical line."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return (y2 - y1) / F.when(x2 != x1, x2 - x1)


def intercept(x1, y1, x2, y2) -> Column:
    return _c(y1) - slope(x1, y1, x2, y2) * _c(x1)


def y_at(x, x1, y1, x2, y2) -> Column:
    return slope(x1, y1, x2, y2) * (_c(x) - _c(x1)) + _c(y1)


def angle(x1, y1, x2, y2) -> Column:
    """Direction of the edge in [0, 2 pi)."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    a = F.atan2(y2 - y1, x2 - x1)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def angle_from_west(x1, y1, x2, y2) -> Column:
    """Direction in [0, 2 pi], counted from the negative x axis."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return F.atan2(y2 - y1, x2 - x1) + math.pi


def is_vertical(x1, x2) -> Column:
    return _c(x1) == _c(x2)


def is_horizontal(y1, y2) -> Column:
    return _c(y1) == _c(y2)


def strictly_between(v, a, b) -> Column:
    v, a, b = map(_c, (v, a, b))
    return (v > F.least(a, b)) & (v < F.greatest(a, b))


def projection(x, y, k, vertical) -> Column:
    """Place of a point's foot on the line y = k x (its x; y on the vertical axis)."""
    x, y, k = map(_c, (x, y, k))
    return F.when(_c(vertical), y).otherwise((x + k * y) / (1 + k * k))


def reduced(weight, most) -> Column:
    """Weight of a face that no division could bring under ``most``: what is left after whole multiples of it."""
    w, m = _c(weight), _c(most)
    return w - F.floor(w / m) * m


def piece_length(length, dist) -> Column:
    """Length of a piece of a split edge: lengths under 1 mark what is cheap to cut along and stay as they are."""
    return F.when(_c(length) < 1, _c(length)).otherwise(_c(dist))


# Rings: arrays of struct(x, y), in order, not closed.

def ring_area(ring) -> Column:
    """Signed area, positive counter-clockwise; 0 for up to two vertices."""
    r = _c(ring)
    pairs = F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    return F.when(F.size(r) <= 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2)


def ring_centre(ring) -> tuple[Column, Column]:
    """Mean of the vertices, each weighed by the lengths of its two edges; the middle of two; one itself."""
    r = _c(ring)
    n = F.size(r)
    after = F.concat(F.slice(r, 2, F.greatest(n - 1, F.lit(0))), F.slice(r, 1, 1))
    length = F.zip_with(r, after, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
    weight = F.zip_with(length, F.concat(F.slice(length, -1, 1), F.slice(length, 1, F.greatest(n - 1, F.lit(0)))), lambda a, b: a + b)
    total = F.aggregate(weight, F.lit(0.0), lambda s, v: s + v)

    def mean(axis: str) -> Column:
        by = F.aggregate(F.zip_with(r, weight, lambda p, w: p[axis] * w), F.lit(0.0), lambda s, v: s + v)
        return F.when(total > 0, by / total).otherwise(r[0][axis].cast("double"))

    return mean("x"), mean("y")


def in_ring(x, y, ring) -> Column:
    """Whether the point lies inside the ring or on it (ray casting over half-open edges)."""
    px, py, r = _c(x), _c(y), _c(ring)
    edges = F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    on = F.exists(edges, lambda e: on_segment(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))

    def hit(e):
        up = e["y2"] > e["y1"]
        side = cross(e["x1"], e["y1"], e["x2"], e["y2"], px, py)
        return ((e["y1"] > py) != (e["y2"] > py)) & F.when(up, side > 0).otherwise(side < 0)

    return on | (F.size(F.filter(edges, hit)) % 2 == 1)

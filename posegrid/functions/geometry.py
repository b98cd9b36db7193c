"""Vector functions on 3D points, as column expressions. A point or vector is a tuple of three columns.

Missing coordinates (null) give null. Where a formula divides by nothing (an angle at a point of no
length) the result is null, as ANSI mode would otherwise raise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(name: str) -> Point:
    """The columns ``name_x``, ``name_y``, ``name_z``."""
    return tuple(F.col(f"`{name}_{axis}`") for axis in "xyz")


def minus(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b))


def middle(a: Point, b: Point) -> Point:
    return tuple((p + q) / 2 for p, q in zip(a, b))


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def dist(a: Point, b: Point) -> Column:
    return norm(minus(a, b))


def project_vector(a: Point, b: Point) -> Point:
    """Part of ``a`` along ``b``; the zero vector where ``b`` has no length."""
    share = F.when(dot(b, b) > 0, F.try_divide(dot(a, b), dot(b, b))).otherwise(0.0)
    return tuple(share * x for x in b)


def normal(a: Point, b: Point, c: Point) -> Point:
    return cross(minus(a, c), minus(b, c))


def angle(a: Point, b: Point) -> Column:
    """Degrees between two vectors. A cosine that rounding brings beyond one counts as one."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def angle_at(corner: Point, a: Point, b: Point) -> Column:
    return angle(minus(a, corner), minus(b, corner))


def triangle_area(a: Point, b: Point, c: Point) -> Column:
    return norm(normal(a, b, c)) / 2


def tetra_volume(a: Point, b: Point, c: Point, d: Point) -> Column:
    return F.abs(dot(minus(a, d), cross(minus(b, d), minus(c, d)))) / 6


def hull_volume(*points: Point) -> Column:
    """Volume of the convex hull of four or five points.

    Five points have two triangulations of equal volume, whose simplices together are the five
    tetrahedra that leave one point out; so half their sum is the hull.
    """
    if len(points) == 4:
        return tetra_volume(*points)
    if len(points) != 5:
        raise ValueError("as an expression for four or five points; use hull.hull_volumes for more")
    parts = [tetra_volume(*(p for j, p in enumerate(points) if j != i)) for i in range(5)]
    return sum(parts[1:], parts[0]) / 2


def ellipse_area(major: tuple[Point, Point], minor: tuple[Point, Point]) -> Column:
    """Full major axis; minor axis as the sum of its ends' distances from the middle of the major one."""
    centre = middle(*major)
    return math.pi / 4 * dist(major[1], major[0]) * (dist(minor[1], centre) + dist(minor[0], centre))


def proptosis(front: Point, back: Point, top: Point, bottom: Point, reference=("bottom", "top", "back"), target="back") -> Column:
    """Squared length of the target point along the normal of a plane through three eye points."""
    named = {"front": front, "back": back, "top": top, "bottom": bottom}
    along = project_vector(named[target], normal(*(named[r] for r in reference)))
    return dot(along, along)


def nose_bulge_volume(eye_left: Point, eye_right: Point, nose_top: Point, pad_left: Point, pad_right: Point) -> Column:
    """Tetrahedron of the bridge between the eyes, the nose and the tops of the pads."""
    return tetra_volume(middle(eye_left, eye_right), nose_top, pad_left, pad_right)

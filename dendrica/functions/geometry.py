"""Geometry as Column expressions; points are structs or triples of Columns named x, y, z."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(prefix: str = "") -> Point:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def minus(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Point, b: Point) -> Column:
    return reduce(lambda s, t: s + t, (p * q for p, q in zip(a, b, strict=True)))


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    return norm(tuple(d * v for d, v in zip(minus(a, b), voxel, strict=True)))


def distance_2d(a: Point, b: Point) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def foot_point(p: Point, a: Point, b: Point, eps: float = 1e-7) -> Point:
    """Projection of p on the line through a and b; a if they all but coincide."""
    ab = minus(b, a)
    t = F.when(dot(ab, ab) < eps, F.lit(0.0)).otherwise(dot(minus(p, a), ab) / dot(ab, ab))
    return tuple(s + t * d for s, d in zip(a, ab, strict=True))


def on_line(p: Point, a: Point, b: Point) -> Column:
    """Whether p lies in the box of a and b."""
    return reduce(lambda s, t: s & t, (q.between(F.least(s, e), F.greatest(s, e)) for q, s, e in zip(p, a, b, strict=True)))


def closest_point(p: Point, a: Point, b: Point) -> Point:
    """Nearest point of the segment to p: its foot if inside, else the nearer end, b in ties."""
    foot = foot_point(p, a, b)
    inside, first = on_line(foot, a, b), distance(p, a) < distance(p, b)
    return tuple(F.when(inside, f).when(first, s).otherwise(e) for f, s, e in zip(foot, a, b, strict=True))


def distance_to_segment(p: Point, a: Point, b: Point) -> Column:
    return distance(p, closest_point(p, a, b))


def distance_to_line(p: Point, a: Point, b: Point) -> Column:
    return distance(p, foot_point(p, a, b))


def turn_angle(a: Point, b: Point, c: Point) -> Column:
    """Degrees by which the way a, b, c turns at b; NaN if a step has no length."""
    u, v = minus(b, a), minus(c, b)
    size = norm(u) * norm(v)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.nullif(size, F.lit(0.0))))
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.degrees(F.acos(cos)))


def angle_between(u: Point, v: Point) -> Column:
    """Degrees between two vectors; 90 if either is zero."""
    size = norm(u) * norm(v)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(dot(u, v) / F.nullif(size, F.lit(0.0)), F.lit(0.0))))
    return F.degrees(F.acos(cos))


def rotate_z(p: Point, center: tuple[float, float], angle: float, degrees: bool = True) -> Point:
    """p turned counter-clockwise about the upright line through center."""
    t = F.radians(F.lit(float(angle))) if degrees else F.lit(float(angle))
    dx, dy = p[0] - center[0], p[1] - center[1]
    return center[0] + dx * F.cos(t) - dy * F.sin(t), center[1] + dx * F.sin(t) + dy * F.cos(t), p[2]


def intervals_meet(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether closed intervals overlap; one without length meets nothing."""
    return (a0 < a1) & (b0 < b1) & (F.greatest(a0, b0) <= F.least(a1, b1))


def midpoint(a: Point, b: Point) -> Point:
    return tuple((p + q) / 2 for p, q in zip(a, b, strict=True))


def sample_pair(a: Point, b: Point, step: float = 1.0) -> Column:
    """Points every step from a towards b, as an array of structs; a alone if they coincide."""
    size = distance(a, b)
    n = F.when(size < 1e-12, 0).otherwise(F.floor(size / step)).cast("int")
    along = lambda k, s, e: F.when(size < 1e-12, s).otherwise(s + (e - s) / F.nullif(size, F.lit(0.0)) * (k * step))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(*(along(k, s, e).alias(c) for c, s, e in zip("xyz", a, b, strict=True))))

"""Vector arithmetic on triples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def clamp(c: Column) -> Column:
    """Between -1 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def angle(a: Vector, b: Vector, c: Vector) -> Column:
    """At b; null where an arm has no length."""
    u, v = minus(a, b), minus(c, b)
    return F.acos(clamp(dot(u, v) / F.nullif(norm(u) * norm(v), F.lit(0.0))))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """In (-pi, pi], IUPAC sign; null where the middle bond has no length."""
    axis = minus(c, b)
    n1, n2 = cross(minus(b, a), axis), cross(axis, minus(d, c))
    size = F.nullif(norm(axis), F.lit(0.0))
    return F.atan2(dot(cross(axis, n1), n2) / size, dot(n1, n2))

"""Three-dimensional vector arithmetic on triples of Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Triple = tuple[Column, Column, Column]


def triple(*names: str | float) -> Triple:
    return tuple(F.col(n) if isinstance(n, str) else F.lit(float(n)) for n in names)  # type: ignore[return-value]


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Triple, b: Triple) -> Triple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Triple) -> Triple:
    """a over its length; a zero vector stays zero."""
    n = norm(a)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return (a[0] / n, a[1] / n, a[2] / n)


def angle_deg(a: Triple, b: Triple) -> Column:
    """Degrees between unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def basis(ref: Triple) -> tuple[Triple, Triple]:
    """Two unit vectors across ref: from the axis of its smallest component (the first on ties)."""
    x, y, z = (F.abs(c) for c in ref)
    first, second = (x <= y) & (x <= z), (y < x) & (y <= z)
    axis = (F.when(first, 1.0).otherwise(0.0), F.when(second, 1.0).otherwise(0.0), F.when(first | second, 0.0).otherwise(1.0))
    u = unit(cross(ref, axis))
    return u, cross(ref, u)


def tilt(vector: Triple, ref: Triple) -> tuple[Column, Column]:
    """Degrees by which a vector leans from ref along each basis direction."""
    u, v = basis(ref)
    down = dot(vector, ref)
    return F.degrees(F.atan2(dot(vector, u), down)), F.degrees(F.atan2(dot(vector, v), down))


def rotate(vector: Triple, axis: Triple, degrees: Column) -> Triple:
    """Rodrigues' rotation about a unit axis."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    across, along = cross(axis, vector), dot(axis, vector)
    return tuple(vector[i] * c + across[i] * s + axis[i] * along * (1 - c) for i in range(3))  # type: ignore[return-value]


def lean(ref: Triple, du: Column, dv: Column) -> Triple:
    """The unit vector that leans from ref by du and dv degrees."""
    u, v = basis(ref)
    a, b = F.tan(F.radians(du)), F.tan(F.radians(dv))
    return unit(tuple(ref[i] + a * u[i] + b * v[i] for i in range(3)))  # type: ignore[arg-type]

"""Boxes, planes, rays, transforms and volumes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """Components that are not finite are read as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def cross(a: Sequence, b: Sequence) -> list[Column]:
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: Sequence, b: Sequence) -> Column:
    p = [_c(u) * _c(v) for u, v in zip(a, b, strict=True)]
    return p[0] + p[1] + p[2]


def matrix(position: Sequence, x: Sequence, y: Sequence) -> Column:
    """The column-major 4 x 4 matrix of a placement; z is x cross y."""
    z = cross(x, y)
    columns = [*(finite(_c(v)) for v in x), F.lit(0.0), *(finite(_c(v)) for v in y), F.lit(0.0), *(finite(v) for v in z), F.lit(0.0), *(finite(_c(v)) for v in position), F.lit(1.0)]
    return F.array(*columns)


def multiply(a: Column, b: Column) -> Column:
    """The product of two column-major 4 x 4 matrices."""
    return F.array(*[sum((a[4 * k + r] * b[4 * c + k] for k in range(1, 4)), a[r] * b[4 * c]) for c in range(4) for r in range(4)])


def transform_box(m: Column, low: Sequence, high: Sequence) -> tuple[list[Column], list[Column]]:
    """The axis-parallel box around a transformed box, by centre and extent."""
    centre = [(_c(a) + _c(b)) / 2 for a, b in zip(low, high, strict=True)]
    extent = [(_c(b) - _c(a)) / 2 for a, b in zip(low, high, strict=True)]
    mid = [m[r] * centre[0] + m[4 + r] * centre[1] + m[8 + r] * centre[2] + m[12 + r] for r in range(3)]
    half = [F.abs(m[r]) * extent[0] + F.abs(m[4 + r]) * extent[1] + F.abs(m[8 + r]) * extent[2] for r in range(3)]
    return [a - b for a, b in zip(mid, half, strict=True)], [a + b for a, b in zip(mid, half, strict=True)]


def box_meets(low: Sequence, high: Sequence, planes: Sequence[tuple[float, float, float, float]], included: bool = False) -> Column:
    """Whether a box reaches into all half-spaces n p + c >= 0, or lies in all of them."""
    good = F.lit(True)
    for *normal, constant in planes:
        far = [(h if (n >= 0) != included else l) for n, l, h in zip(normal, low, high, strict=True)]
        good = good & ((far[0] * float(normal[0]) + far[1] * float(normal[1]) + far[2] * float(normal[2]) + float(constant)) >= 0)
    return good


def ray_enters(low: Sequence, high: Sequence, origin: Sequence[float], direction: Sequence[float]) -> Column:
    """The distance along a ray at which it enters a box (0 from inside); null if it misses."""
    near, far, inside = F.lit(float("-inf")), F.lit(float("inf")), F.lit(True)
    for l, h, o, d in zip(low, high, origin, direction, strict=True):
        if d == 0:
            inside = inside & (_c(o) >= l) & (_c(o) <= h)
            continue
        a, b = (l - float(o)) / float(d), (h - float(o)) / float(d)
        near, far = F.greatest(near, F.least(a, b)), F.least(far, F.greatest(a, b))
    return F.when(inside & (near <= far) & (far >= 0), F.greatest(near, F.lit(0.0)))


def signed_volume(a: Sequence, b: Sequence, c: Sequence) -> Column:
    """The volume between a triangle and the origin, with its sign."""
    return dot(a, cross(b, c)) / 6


def lod(low: Sequence, high: Sequence, camera: Sequence[float], half_fov_tan: float, view_size: float, quality: float) -> Column:
    """INVISIBLE, WIRES or GEOMETRY by a box's size on the screen (before planes and visibility)."""
    side = [h - l for l, h in zip(low, high, strict=True)]
    d = F.sqrt(side[0] * side[0] + side[1] * side[1] + side[2] * side[2])
    gap = [F.greatest(l - float(c), F.lit(0.0), F.lit(float(c)) - h) for l, h, c in zip(low, high, camera, strict=True)]
    view = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) * half_fov_tan
    q = 2 - 1.5 * quality
    s = d / view * view_size
    small = d < 2
    median = side[0] + side[1] + side[2] - F.greatest(*side) - F.least(*side)
    return (
        F.when(view == 0, "GEOMETRY")
        .when((small & (s < 4 * q)) | (~small & (s < 2 * q)), "INVISIBLE")
        .when((small & (s < 16 * q)) | (~small & (s < 4 * q)), "WIRES")
        .when(median / view * view_size < max(4 * q, 4), "WIRES")
        .otherwise("GEOMETRY")
    )

"""Rotations by Euler angles, and positions at the end of chains of joints, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Vector = tuple[Column, Column, Column]


def matrix_zyx(z: Column, y: Column, x: Column) -> list[list[Column]]:
    """Rz Ry Rx of angles in degrees, row by row."""
    cz, sz, cy, sy, cx, sx = (f(F.radians(a)) for a in (z, y, x) for f in (F.cos, F.sin))
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def applied(m: list[list[Column]], v: Sequence) -> Vector:
    return tuple(m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2] for i in range(3))


def turned(axis: str, degrees: Column, v: Vector) -> Vector:
    """v turned around one axis."""
    x, y, z = v
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    if axis == "x":
        return x, c * y - s * z, s * y + c * z
    if axis == "y":
        return c * x + s * z, y, c * z - s * x
    return c * x - s * y, s * x + c * y, z


def chain_end(angles: Sequence[tuple[Column, Column, Column]], offsets: Sequence[tuple[float, float, float]]) -> Vector:
    """Where a chain ends: joint k, from the root on, turns by angles[k] (z, y, x) what hangs at offsets[k]."""
    v: Vector = tuple(F.lit(0.0) for _ in range(3))
    for (z, y, x), offset in zip(reversed(angles), reversed(offsets)):
        v = tuple(a + o for a, o in zip(v, offset))
        v = turned("z", z, turned("y", y, turned("x", x, v)))
    return v

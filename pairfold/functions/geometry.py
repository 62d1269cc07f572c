"""Vectors of three Columns, internal coordinates, cells, and truncated radial kernels."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def vector(prefix: str, axes: str = "xyz") -> Vector:
    return tuple(F.col(f"{prefix}{a}") for a in axes)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


@dataclass(frozen=True)
class Cell:
    """A periodic cell: edges per axis (None: open), and the tilts of a lower-triangular one."""

    edges: tuple[float | None, ...]
    tilts: tuple[float, float, float] = (0.0, 0.0, 0.0)  # b on x, c on x, c on y

    def __post_init__(self) -> None:
        if any(e is not None and not 0 < e < float("inf") for e in self.edges):
            raise ValueError("edges must be finite and positive")
        if not self.rectangular and (len(self.edges) != 3 or None in self.edges):
            raise ValueError("a tilted cell has three periodic axes")

    @property
    def rectangular(self) -> bool:
        return self.tilts == (0.0, 0.0, 0.0)

    @property
    def widths(self) -> tuple[float | None, ...]:
        """The distances of opposite faces; those of a rectangular cell are its edges."""
        if self.rectangular:
            return self.edges
        (a, b, c), (bx, cx, cy) = self.edges, self.tilts
        along = math.sqrt((b * c) ** 2 + (bx * c) ** 2 + (bx * cy - b * cx) ** 2)  # |b x c|
        return a * b * c / along, b * c / math.hypot(c, cy), c

    def fractional(self, x: Vector) -> Vector:
        """Positions in units of the lattice vectors; all axes must be periodic."""
        if self.rectangular:
            return tuple(c / F.lit(e) for c, e in zip(x, self.edges, strict=True))
        (a, b, c), (bx, cx, cy) = self.edges, self.tilts
        w = x[2] / F.lit(c)
        v = (x[1] - F.lit(cy) * w) / F.lit(b)
        return (x[0] - F.lit(bx) * v - F.lit(cx) * w) / F.lit(a), v, w

    def image(self, d: Vector) -> Vector:
        """The nearest image of a difference, if that is shorter than half of each of ``widths``."""
        if self.rectangular:
            return tuple(x if e is None else x - F.lit(e) * F.rint(x / F.lit(e)) for x, e in zip(d, self.edges, strict=True))
        x, y, z = d
        (a, b, c), (bx, cx, cy) = self.edges, self.tilts
        k = F.rint(z / c)
        x, y, z = x - cx * k, y - cy * k, z - c * k
        k = F.rint(y / b)
        x, y = x - bx * k, y - b * k
        return x - a * F.rint(x / a), y, z

    def wrapped(self, x: Vector) -> Vector:
        """Positions moved into the cell."""
        if not self.rectangular:
            (a, b, c), (bx, cx, cy) = self.edges, self.tilts
            u, v, w = (F.floor(f) for f in self.fractional(x))
            return x[0] - a * u - bx * v - cx * w, x[1] - b * v - cy * w, x[2] - c * w
        return tuple(c if e is None else c - F.lit(e) * F.floor(c / F.lit(e)) for c, e in zip(x, self.edges, strict=True))


def angle(a: Vector, b: Vector, c: Vector) -> Column:
    """At b; the cosine is clamped."""
    p, q = minus(a, b), minus(c, b)
    return F.acos(F.least(F.greatest(dot(p, q) / (norm(p) * norm(q)), F.lit(-1.0)), F.lit(1.0)))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """The angle in (-pi, pi] between the plane of a, b, c and that of b, c, d, turned about the line from b to c."""
    first, axis, last = minus(b, a), minus(c, b), minus(d, c)
    normal = cross(axis, last)
    return F.atan2(norm(axis) * dot(first, normal), dot(cross(first, axis), normal))


def checked_rectangular(edges: list[Column], tilts: list[Column]) -> list[Column]:
    """The edges of a cell that stands in columns; an error where one is not finite and positive, or a tilt is not 0."""
    bad = reduce(Column.__or__, [~((e > 0) & (e < float("inf"))) | e.isNull() for e in edges] + [(t != 0) | t.isNull() for t in tilts])
    return [F.when(bad, F.raise_error(F.lit("a rectangular cell needs finite positive edges and no tilts")).cast("double")).otherwise(e) for e in edges]


def wrapped_angle(x: Column) -> Column:
    """A difference of angles in [-pi, pi)."""
    turn = F.lit(2) * F.pi()
    return x - turn * F.floor((x + F.pi()) / turn)


Radial = Callable[[Column], Column]


def truncated(kind: str, u: Radial, cutoff: float, slope: Radial | None = None, curvature: Radial | None = None, start: float | None = None) -> Radial:
    """A radial kernel that ends at the cutoff: none, shift, force_shift, switch or force_switch.

    ``slope`` and ``curvature`` are the kernel's first and second derivatives, where the kind needs them.
    """
    end = F.lit(float(cutoff))
    if kind == "none":
        return u
    if kind == "shift":
        return lambda r: u(r) - u(end)
    if kind == "force_shift":
        return lambda r: u(r) - u(end) - (r - end) * slope(end)
    t = lambda r: (r - F.lit(float(start))) / F.lit(float(cutoff - start))
    if kind == "switch":
        s = lambda x: 1 - 10 * x * x * x + 15 * x * x * x * x - 6 * x * x * x * x * x
        return lambda r: F.when(r <= start, u(r)).when(r < cutoff, u(r) * s(t(r))).otherwise(0.0)
    if kind == "force_switch":
        width = float(cutoff - start)
        f, df = -slope(end), -curvature(end)
        a, b = (df * width - 3 * f) / width**2, (2 * f - df * width) / width**3
        ramp = lambda x: a / 3 * x * x * x + b / 4 * x * x * x * x
        rest = u(end) - a / 3 * width**3 - b / 4 * width**4
        return lambda r: u(r) - F.when(r > start, ramp(r - F.lit(float(start)))).otherwise(0.0) - rest
    raise ValueError(f"unknown truncation: {kind}")

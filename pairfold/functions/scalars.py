"""Scalar functions with IEEE meaning, as Columns.

Spark's own functions are used wherever they agree with IEEE doubles; the others are guarded:
division by zero gives infinities or NaN instead of an error, the logarithm of a negative number is
NaN instead of NULL, floor and ceil stay doubles, and min and max pass NaN on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int
NAN, INF = float("nan"), float("inf")


def col(x: Number | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def divide(a: Number, b: Number) -> Column:
    """a / b as IEEE has it; null if either is."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))).otherwise(a / b)


def recip(x: Number) -> Column:
    return divide(1.0, x)


def power(x: Number, y: Number) -> Column:
    return F.pow(col(x), col(y))


def log(x: Number) -> Column:
    x = col(x)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))


def sqrt(x: Number) -> Column:
    return F.sqrt(col(x))


def sec(x: Number) -> Column:
    return recip(F.cos(col(x)))


def csc(x: Number) -> Column:
    return recip(F.sin(col(x)))


def cot(x: Number) -> Column:
    return recip(F.tan(col(x)))


def floor(x: Number) -> Column:
    return F.floor(col(x)).cast("double")


def ceil(x: Number) -> Column:
    return F.ceil(col(x)).cast("double")


def step(x: Number) -> Column:
    """1 from 0 on, else 0."""
    return F.when(col(x) >= 0, 1.0).otherwise(0.0)


def delta(x: Number) -> Column:
    """1 at 0, else 0."""
    return F.when(col(x) == 0, 1.0).otherwise(0.0)


def square(x: Number) -> Column:
    return col(x) * col(x)


def cube(x: Number) -> Column:
    return col(x) * col(x) * col(x)


def minimum(a: Number, b: Number) -> Column:
    a, b = col(a), col(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def maximum(a: Number, b: Number) -> Column:
    return F.greatest(col(a), col(b))  # NaN is the greatest double in Spark


def select(condition: Number, a: Number, b: Number) -> Column:
    """a where the condition is not 0, else b."""
    return F.when(col(condition) != 0, col(a)).otherwise(col(b))


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def erf(x: Number) -> Column:
    """The error function: its Maclaurin series up to 2.5, a continued fraction beyond; errors below 1e-12."""
    x = col(x)
    a = F.abs(x)
    terms, c = [], 1.0
    for n in range(48):
        terms.append(c / (2 * n + 1))
        c *= -1.0 / (n + 1)
    inner = F.lit(1.1283791670955126) * x * _polynomial(x * x, terms[::-1])
    return F.when(F.isnan(x), F.lit(NAN)).when(a < 2.5, inner).otherwise(F.signum(x) * (1 - _erfc_tail(a)))


def _erfc_tail(a: Column) -> Column:
    """erfc for 2.5 and more."""
    fraction = a
    for k in range(40, 0, -1):
        fraction = a + F.lit(k / 2.0) / fraction
    return F.when(a > 27, F.lit(0.0)).otherwise(F.exp(-a * a) / (fraction * F.lit(1.7724538509055159)))


def erfc(x: Number) -> Column:
    x = col(x)
    return F.when(x >= 2.5, _erfc_tail(x)).otherwise(1 - erf(x))


def chebyshev(y: Number, coefficients: Sequence[float]) -> Column:
    """The series of Chebyshev polynomials, by Clenshaw's recurrence over the literal coefficients."""
    y = col(y)
    b1, b2 = F.lit(0.0), F.lit(0.0)
    folded = F.aggregate(
        F.array(*[F.lit(float(c)) for c in reversed(coefficients[1:])]),
        F.struct(b1.alias("b1"), b2.alias("b2")),
        lambda s, c: F.struct((2 * y * s["b1"] - s["b2"] + c).alias("b1"), s["b1"].alias("b2")),
        lambda s: y * s["b1"] - s["b2"],
    )
    return folded + F.lit(float(coefficients[0]))


def bspline(order: int, u: Number) -> Column:
    """The cardinal B-spline of an order at u, 0 outside of [0, order]; a piecewise polynomial."""
    u = col(u)
    if order == 1:
        return F.when((u >= 0) & (u < 1), 1.0).otherwise(0.0)
    lower = lambda x: bspline(order - 1, x)
    return (u * lower(u) + (F.lit(float(order)) - u) * lower(u - 1)) / F.lit(float(order - 1))


def literals(values: Sequence[float]) -> Column:
    """An array of doubles as one literal of the plan."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def tabulated(x: Number, low: float, high: float, values: Sequence[float]) -> Column:
    """The entry nearest to x of a table over equal steps; the ends go on."""
    return tabulated_grid([x], [(low, high)], values)


def tabulated_grid(x: Sequence[Number], spans: Sequence[tuple[float, float]], values) -> Column:
    """The entry nearest to a point of a table of one to three axes over equal steps; the ends go on."""
    v = np.asarray(values, dtype=float)
    place = F.lit(0)
    for c, (low, high), n in zip(x, spans, v.shape, strict=True):
        at = F.rint((col(c) - low) / ((high - low) / (n - 1)))
        place = place * n + F.least(F.greatest(at, F.lit(0.0)), F.lit(float(n - 1))).cast("int")
    return F.element_at(literals(v.ravel()), place + 1)


def _second_derivatives(v: np.ndarray, periodic: bool) -> np.ndarray:
    """Along the first axis, in units of the squared step: natural ends, or those of a turn whose last value is its first."""
    n = len(v) - 1
    a, r = np.zeros((n + 1, n + 1)), np.zeros_like(v)
    for k in range(1, n):
        a[k, k - 1 : k + 2] = 1, 4, 1
        r[k] = 6 * (v[k - 1] - 2 * v[k] + v[k + 1])
    if periodic:
        a[0, 0], r[0] = 4, 6 * (v[n - 1] - 2 * v[0] + v[1])
        a[0, 1] += 1
        a[0, n - 1] += 1
        a[n, 0], a[n, n] = 1, -1
    else:
        a[0, 0] = a[n, n] = 1
    return np.linalg.solve(a, r.reshape(n + 1, -1)).reshape(v.shape)


def _patches(v: np.ndarray, periodic: bool) -> np.ndarray:
    """The first axis in intervals and, last of all, the four coefficients of powers of the place in each."""
    m = _second_derivatives(v, periodic)
    y, z, p, q = v[:-1], v[1:], m[:-1], m[1:]
    return np.stack([y, z - y - (2 * p + q) / 6, p / 2, (q - p) / 6], axis=-1)


def spline(x: Number, low: float, high: float, values: Sequence[float], periodic: bool = False) -> Column:
    """The cubic spline through equally spaced values; 0 outside unless periodic."""
    return spline_grid([x], [(low, high)], values, periodic)


def spline_grid(x: Sequence[Number], spans: Sequence[tuple[float, float]], values, periodic: bool = False) -> Column:
    """The cubic spline of one to three axes through equally spaced values; 0 outside unless periodic.

    It is the spline along each axis of the splines along the others. Coefficients, four per interval and axis, are
    solved once where the plan is made and are one literal of the plan.
    """
    c = np.asarray(values, dtype=float)
    dims, sizes = c.ndim, [n - 1 for n in c.shape]
    for _ in range(dims):  # each turn takes the axis in front to the end, as intervals and coefficients
        c = np.moveaxis(_patches(c, periodic), 0, -2)
        # Axes are now those left, then (interval, power) of each that is done.
    order = [2 * k for k in range(dims)] + [2 * k + 1 for k in range(dims)]
    table = literals(c.transpose(order).ravel())
    place, t, outside = F.lit(0), [], F.lit(False)
    for value, (low, high), n in zip(x, spans, sizes, strict=True):
        y = col(value)
        if periodic:
            y = F.lit(low) + (y - low) - F.floor((y - low) / (high - low)) * (high - low)
        else:
            outside = outside | (y < low) | (y > high)
        u = (y - low) / ((high - low) / n)
        k = F.least(F.greatest(F.floor(u), F.lit(0)), F.lit(n - 1)).cast("int")
        place = place * n + k
        t.append(u - k)
    size = 4**dims

    def horner(axis: int, first: int) -> Column:
        if axis == dims:
            return F.element_at(table, place * size + (first + 1))
        inner = [horner(axis + 1, first + p * 4 ** (dims - 1 - axis)) for p in range(4)]
        return ((inner[3] * t[axis] + inner[2]) * t[axis] + inner[1]) * t[axis] + inner[0]

    return horner(0, 0) if periodic else F.when(outside, 0.0).otherwise(horner(0, 0))


def gamma_cdf(x: Number, shape: float, scale: float = 1.0) -> Column:
    """The distribution function of a gamma variable; 0 up to 0.

    A power series below shape + 1 and a continued fraction, worked from its tail, above; errors are below 1e-12
    for shapes up to 100.
    """
    z = col(x).cast("double") / F.lit(float(scale))
    steps = 400
    front = F.exp(F.lit(float(shape)) * F.log(z) - z - F.lit(math.lgamma(shape)))
    grow = lambda s, k: F.struct((s["t"] * z / (F.lit(float(shape)) + k)).alias("t"), (s["sum"] + s["t"] * z / (F.lit(float(shape)) + k)).alias("sum"))
    begin = F.struct(F.lit(1.0 / shape).alias("t"), F.lit(1.0 / shape).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, grow, lambda s: s["sum"])
    tail = F.aggregate(F.sequence(F.lit(steps), F.lit(1)), z + F.lit(2.0 * steps + 1 - shape), lambda s, k: z + F.lit(-1.0 - shape) + 2 * k - k * (k - F.lit(float(shape))) / s)
    return F.when(z <= 0, 0.0).when(z < shape + 1, series * front).otherwise(1 - front / tail)


def prolate(x: Number, bandwidth: float, terms: int = 60) -> Column:
    """The prolate function of order 0 and a bandwidth on [-1, 1], 1 at 0 and 0 outside, as a Chebyshev series.

    The function is the eigenvector of a tridiagonal matrix over the even Legendre polynomials with the least eigenvalue.
    """
    k = 2.0 * np.arange(terms)
    c2 = bandwidth**2
    diagonal = k * (k + 1) + c2 * (2 * k * (k + 1) - 1) / ((2 * k + 3) * (2 * k - 1))
    beside = c2 * (k + 1) * (k + 2) / ((2 * k + 3) * np.sqrt((2 * k + 1) * (2 * k + 5)))
    _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    legendre = np.zeros(2 * terms - 1)
    legendre[::2] = vectors[:, 0] * np.sqrt(k + 0.5)
    series = np.polynomial.chebyshev.Chebyshev.interpolate(lambda y: np.polynomial.legendre.legval(y, legendre), 2 * terms).coef
    series = series / np.polynomial.chebyshev.chebval(0.0, series)
    return F.when((col(x) < -1) | (col(x) > 1), 0.0).otherwise(chebyshev(x, series.tolist()))


def rounded(x: Number, digits: int) -> Column:
    """x to a number of decimals as SQL on doubles has it: x * 10^digits to the nearest whole number, halves away from zero.

    round() goes by the decimal digits that a double is written with, which differs where the product is just off a half.
    """
    x, unit = col(x).cast("double"), F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit


def fixed(x: Number, digits: int = 6) -> Column:
    """x in whole units of its last digit: sums of these are exact in any order."""
    return F.floor(col(x) * F.lit(10.0**digits) + 0.5).cast("long")


def exact_sum(x: Number, digits: int = 6, times: Column | None = None) -> Column:
    """An aggregate that does not depend on the order of rows: each value is rounded to its last digit first, and counts ``times``.

    Whole units are added up in two parts, so that sums stay exact up to 2^43 rows and rounded once beyond 2^53 units.
    """
    units = F.floor(col(x).cast("double") * F.lit(10.0**digits) + 0.5).cast("double")
    high = F.floor(units / F.lit(float(1 << 20)))
    low = (units - high.cast("double") * F.lit(float(1 << 20))).cast("long")
    if times is not None:
        high, low = high * times, low * times
    return (F.sum(high).cast("double") * F.lit(float(1 << 20)) + F.sum(low).cast("double")) / F.lit(10.0**digits)

"""Regular grids as tables: stencils, spreading and gathering, maps and weighted sums, small transforms.

A grid is a table (g0, g1, ..., value) of the points that hold something; a stencil is an expression
that is exploded where it is used and never stored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfold.functions.expressions import Expression
from pairfold.functions.geometry import Cell
from pairfold.functions.scalars import bspline


def stencil(table: DataFrame, axes: list[str], cell: Cell, shape: list[int], order: int = 2, slopes: bool = False) -> DataFrame:
    """Rows with the order^n grid points around them (g0, g1, ...) and the B-spline weight of each.

    Periodic axes wrap; on open ones the points run from 0 to the shape's end as they come. ``slopes`` adds
    the derivative of the weight by the position on each axis, w_<axis>.
    """
    out = table
    for k, (a, n, e) in enumerate(zip(axes, shape, cell.edges, strict=True)):
        scale = F.lit(float(n)) / F.lit(float(e if e is not None else n))
        u = F.col(a) * scale
        base = F.floor(u)
        steep = lambda x: (bspline(order - 1, x) - bspline(order - 1, x - 1)) * scale
        entries = [F.struct((base - t).alias("g"), bspline(order, u - base + t).alias("w"), *([steep(u - base + t).alias("d")] if slopes else [])) for t in range(order)]
        out = out.withColumn(f"__s{k}", F.explode(F.array(*entries)))
        g = F.pmod(F.col(f"__s{k}.g"), F.lit(n)) if e is not None else F.col(f"__s{k}.g")
        out = out.withColumn(f"g{k}", g.cast("long")).withColumn(f"__w{k}", F.col(f"__s{k}.w"))
        out = (out.withColumn(f"__d{k}", F.col(f"__s{k}.d")) if slopes else out).drop(f"__s{k}")
    weight = reduce(Column.__mul__, [F.col(f"__w{k}") for k in range(len(axes))])
    out = out.withColumn("weight", weight)
    if slopes:
        for k, a in enumerate(axes):
            out = out.withColumn(f"w_{a}", reduce(Column.__mul__, [F.col(f"__d{j}" if j == k else f"__w{j}") for j in range(len(axes))]))
    return out.drop(*(f"__{c}{k}" for k in range(len(axes)) for c in "wd"))


def points(dims: int) -> list[str]:
    return [f"g{k}" for k in range(dims)]


def scatter(spread: DataFrame, dims: int, amplitude: Column, name: str = "value", aggregate=F.sum) -> DataFrame:
    """The grid of weighted sums of an amplitude over a stencil."""
    return spread.groupBy(*points(dims)).agg(aggregate(F.col("weight") * amplitude).alias(name))


def gather(spread: DataFrame, dims: int, grid: DataFrame, key: str, name: str = "value", aggregate=F.sum) -> DataFrame:
    """(key, value): the grid interpolated at the rows of a stencil; absent points count as 0."""
    met = spread.join(grid, points(dims), "left")
    return met.groupBy(key).agg(aggregate(F.col("weight") * F.coalesce(F.col(name), F.lit(0.0))).alias(name))


def reduce_stencil(spread: DataFrame, by: list[str], aggregate=F.sum, **kernels: Column) -> DataFrame:
    """Sums of any kernels of the entries of a stencil, per grid point or per row; ``by`` names what they go to."""
    return spread.groupBy(*by).agg(*(aggregate(k).alias(n) for n, k in kernels.items()))


def scatter_jvp(spread: DataFrame, dims: int, amplitude: Column, moved: dict[str, Column], changed: Column | None = None, name: str = "value", aggregate=F.sum) -> DataFrame:
    """The change of a scattered grid when rows move by ``moved`` (per axis) and amplitudes change by ``changed``; needs slopes."""
    change = reduce(Column.__add__, [F.col(f"w_{a}") * x for a, x in moved.items()]) * amplitude
    return spread.groupBy(*points(dims)).agg(aggregate(change if changed is None else change + F.col("weight") * changed).alias(name))


def scatter_vjp(spread: DataFrame, dims: int, amplitude: Column, axes: list[str], grid: DataFrame, key: str, name: str = "value", aggregate=F.sum) -> DataFrame:
    """(key, amplitude, <axis>...): what a grid of cotangents gives to each row's amplitude and position; the transpose of scatter_jvp."""
    met = spread.join(grid, points(dims), "left").withColumn("__g", F.coalesce(F.col(name), F.lit(0.0)))
    return met.groupBy(key).agg(aggregate(F.col("weight") * F.col("__g")).alias("amplitude"), *(aggregate(F.col(f"w_{a}") * amplitude * F.col("__g")).alias(a) for a in axes))


def gather_jvp(spread: DataFrame, dims: int, grid: DataFrame, key: str, moved: dict[str, Column], name: str = "value", tangent: str | None = None, aggregate=F.sum) -> DataFrame:
    """(key, value): the change of a gathered field when rows move, and the grid changes by its column ``tangent``."""
    met = spread.join(grid, points(dims), "left")
    change = reduce(Column.__add__, [F.col(f"w_{a}") * x for a, x in moved.items()]) * F.coalesce(F.col(name), F.lit(0.0))
    if tangent is not None:
        change = change + F.col("weight") * F.coalesce(F.col(tangent), F.lit(0.0))
    return met.groupBy(key).agg(aggregate(change).alias(name))


def grid_jvp(grid: DataFrame, kernel: str, along: dict[str, Column], name: str = "tangent") -> DataFrame:
    """``grid`` and the change of a kernel, an expression of its columns, along changes of them."""
    e = Expression.parse(kernel)
    return grid.withColumn(name, reduce(Column.__add__, [e.derivative(n).column() * x for n, x in along.items()]))


def grid_vjp(grid: DataFrame, kernel: str, cotangent: Column, of: list[str]) -> DataFrame:
    """``grid`` and, for each of the columns ``of``, bar_<column>: a kernel's cotangent times its derivative."""
    e = Expression.parse(kernel)
    return grid.withColumns({f"bar_{n}": cotangent * e.derivative(n).column() for n in of})


def map_grid(grid: DataFrame, **values: Column) -> DataFrame:
    return grid.withColumns(values)


def sum_grid(grid: DataFrame, kernel: Column, interior: Column | None = None, aggregate=F.sum) -> DataFrame:
    """One row: the sum of a kernel; points of ``interior`` (half-modes that stand for two) count twice."""
    weight = F.lit(1.0) if interior is None else F.when(interior, 2.0).otherwise(1.0)
    return grid.agg(aggregate(weight * kernel).alias("total"))


def dft(table: DataFrame, at: str, value: str, n: int, half: bool = True) -> DataFrame:
    """(k, re, im): the unnormalised transform of a series of n places, as a sum over twiddles.

    Every row meets the n (or n/2 + 1) frequencies by an explode, and the sums are partially
    aggregated, so that only frequencies are shuffled. For transforms of moderate n.
    """
    last = n // 2 if half else n - 1
    turn = F.lit(2) * F.pi() * F.pmod(F.col("k") * F.col(at), F.lit(n)) / F.lit(float(n))
    each = table.select(at, value, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("k"))
    return each.groupBy("k").agg(F.sum(F.col(value) * F.cos(turn)).alias("re"), F.sum(-F.col(value) * F.sin(turn)).alias("im"))


def _along(grid: DataFrame, axes: list[str], axis: str, n: int, transform: Callable[[np.ndarray], np.ndarray], lines: int) -> DataFrame:
    """The lines of a grid along one axis transformed, some thousands of points to a task's array."""
    rest = [a for a in axes if a != axis]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        line, first = pd.factorize(pd.MultiIndex.from_frame(group[rest])) if rest else (np.zeros(len(group), dtype=int), None)
        x = np.zeros((line.max() + 1, n), dtype=complex)
        x[line, group[axis].to_numpy()] = group.re.to_numpy() + 1j * group.im.to_numpy()
        y = transform(x)
        out = {a: np.repeat(np.asarray(first.get_level_values(k)), y.shape[1]) for k, a in enumerate(rest)} | {axis: np.tile(np.arange(y.shape[1]), len(y)), "re": y.real.ravel(), "im": y.imag.ravel()}
        return pd.DataFrame(out)[[*axes, "re", "im"]]

    bucket = F.pmod(F.xxhash64(*rest), F.lit(lines)) if rest else F.lit(0)
    schema = ", ".join(f"{a} long" for a in axes) + ", re double, im double"
    return grid.withColumn("__b", bucket).groupBy("__b").applyInPandas(run, schema)


def transform(grid: DataFrame, shape: list[int], inverse: bool = False, points_a_task: int = 1 << 20) -> DataFrame:
    """(g0, g1, ..., re, im): the unnormalised transform of a real grid, or back from it; absent points are 0.

    A real grid (value) becomes the half of its spectrum with the last frequency up to n // 2; ``inverse`` takes
    that half (re, im) to a real grid (value), the product of the shape times the one that it came from. The
    lines along an axis are dealt to tasks, axis by axis: a shuffle of the grid for each, no line in two tasks.
    """
    axes, last = points(len(shape)), len(shape) - 1
    lines = max(1, math.ceil(math.prod(shape) / points_a_task))
    if not inverse:
        out = _along(grid.select(*axes, F.col("value").alias("re"), F.lit(0.0).alias("im")), axes, axes[last], shape[last], lambda x: np.fft.rfft(x.real, axis=1), lines)
        for k in range(last):
            out = _along(out, axes, axes[k], shape[k], lambda x: np.fft.fft(x, axis=1), lines)
        return out
    out = grid.select(*axes, "re", "im")
    for k in range(last):
        out = _along(out, axes, axes[k], shape[k], lambda x: np.fft.ifft(x, axis=1) * x.shape[1], lines)
    n = shape[last]
    out = _along(out, axes, axes[last], n // 2 + 1, lambda x: np.fft.irfft(x, n, axis=1) * n + 0j, lines)
    return out.select(*axes, F.col("re").alias("value"))


def waves(edges: list[float], most: int, width: float) -> list[tuple]:
    """(k, wave vector, factor) of half of the whole vectors up to ``most``; factors of a sum of screened charges."""
    volume = math.prod(edges)
    out = []
    for k in itertools.product(range(-most, most + 1), repeat=len(edges)):
        if k > (0,) * len(edges):
            wave = [x / e for x, e in zip(k, edges, strict=True)]
            square = sum(x * x for x in wave)
            out.append((k, wave, 2 * math.exp(-((math.pi / width) ** 2) * square) / (2 * math.pi * volume * square)))
    return out


def reciprocal(table: DataFrame, key: str, axes: list[str], edges: list[float], charge: str, most: int, width: float) -> tuple[DataFrame, DataFrame]:
    """((energy, w_<axis>), (key, f_<axis>...)): the long-range sum of screened charges in a periodic cell.

    The energy is the sum over waves k of factor(k) |S(k)|^2 with the structure factors S; the virial's diagonal and
    the forces are its derivatives. The waves, (2 most + 1)^n / 2 of them, are literals of the plan; only their sums are shuffled,
    and the forces meet them again as a broadcast of as many rows.
    """
    wave = waves(edges, most, width)
    factors = structure_factors(table, axes, edges, charge, most)
    names = [f"k{d}" for d in range(len(axes))]
    kinds = table.sparkSession.createDataFrame([(*k, *map(float, v), float(f)) for k, v, f in wave], ", ".join([*(f"{n} int" for n in names), *(f"v{d} double" for d in range(len(axes))), "factor double"]))
    met = factors.join(F.broadcast(kinds), names)
    energy = F.col("factor") * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    square = reduce(Column.__add__, [F.col(f"v{d}") * F.col(f"v{d}") for d in range(len(axes))])
    stretch = F.lit(2.0) * (1 / square + F.lit((math.pi / width) ** 2))
    total = met.agg(F.sum(energy).alias("energy"), *(F.sum(energy * (1 - stretch * F.col(f"v{d}") * F.col(f"v{d}"))).alias(f"w_{a}") for d, a in enumerate(axes)))
    listed = F.array(*[F.struct(*(F.lit(x).alias(n) for n, x in zip(names, k, strict=True))) for k, _, _ in wave])
    each = table.select(key, charge, *axes, F.explode(listed).alias("__k")).select(key, charge, *axes, "__k.*").join(F.broadcast(met), names)
    phase = F.lit(2) * F.pi() * reduce(Column.__add__, [F.col(f"v{d}") * F.col(a) for d, a in enumerate(axes)])
    pull = F.lit(4 * math.pi) * F.col("factor") * F.col(charge) * (F.col("re") * F.sin(phase) - F.col("im") * F.cos(phase))
    forces = each.groupBy(key).agg(*(F.sum(pull * F.col(f"v{d}")).alias(f"f_{a}") for d, a in enumerate(axes)))
    return total, forces


def structure_factors(table: DataFrame, axes: list[str], edges: list[float], charge: str, most: int) -> DataFrame:
    """(k0, k1, ..., re, im): sums of charge times exp(i k x) over the rows, for the whole vectors up to ``most``."""
    ks = [k for k in itertools.product(range(-most, most + 1), repeat=len(axes)) if k > (0,) * len(axes)]
    vectors = F.array(*[F.struct(*(F.lit(x).alias(f"k{d}") for d, x in enumerate(k))) for k in ks])
    each = table.withColumn("__k", F.explode(vectors)).select("*", "__k.*")
    phase = reduce(Column.__add__, [F.lit(2) * F.pi() * F.col(f"k{d}") * F.col(a) / F.lit(float(e)) for d, (a, e) in enumerate(zip(axes, edges, strict=True))])
    return each.groupBy(*(f"k{d}" for d in range(len(axes)))).agg(F.sum(F.col(charge) * F.cos(phase)).alias("re"), F.sum(F.col(charge) * F.sin(phase)).alias("im"))

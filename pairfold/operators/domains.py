"""Spatial domains: owners of rows, boundary replicas, and sums that go back to the owners.

Domains are Spark partitions by a domain column; replicas are rows of their own that name the row
they copy and its image. Axes are periodic and rectangular.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfold.functions.geometry import Cell


def owner(axes: list[str], cell: Cell, grid: list[int]) -> Column:
    """The domain a + ga * (b + gb * c) of a row, by half-open fractional boxes of its wrapped position."""
    out = F.lit(0)
    for a, e, g in reversed(list(zip(axes, cell.edges, grid, strict=True))):
        f = F.col(a) / e - F.floor(F.col(a) / e)
        out = out * g + F.least(F.floor(f * g), F.lit(g - 1))
    return out.cast("long")


def partition(table: DataFrame, axes: list[str], cell: Cell, grid: list[int], physical: bool = True) -> DataFrame:
    """Rows wrapped into the cell, with their domain; spread by it. Called anew, it migrates rows."""
    rows = table.withColumns(dict(zip(axes, cell.wrapped(tuple(F.col(a) for a in axes)), strict=True)))
    rows = rows.withColumn("domain", owner(axes, cell, grid))
    return rows.repartition("domain") if physical else rows


def halo(layout: DataFrame, key: str, axes: list[str], cell: Cell, grid: list[int], reach: float) -> DataFrame:
    """(domain, source, s<axis>..., <axis>...): every image closer than ``reach`` to a domain's box.

    A domain's own rows in the home cell are not among them. Each row is copied to the few domains
    within reach of it, which are enumerated per axis; nothing is joined.
    """
    out = layout.select(F.col(key).alias("source"), F.col("domain").alias("__home"), *axes)

    def box(a: str, g: int, side: float):
        """A box with its image and its distance to a row on one axis."""
        return lambda b: F.struct(F.pmod(b, F.lit(g)).alias("box"), (-F.floor(b / g)).cast("long").alias("shift"), F.greatest(b * side - F.col(a), F.col(a) - (b + 1) * side, F.lit(0.0)).alias("gap"))

    for k, (a, e, g) in enumerate(zip(axes, cell.edges, grid, strict=True)):
        side = e / g
        most = math.ceil(reach / side)
        steps = F.sequence(F.floor(F.col(a) / side) - most, F.floor(F.col(a) / side) + most)
        near = F.transform(steps, box(a, g, side))
        out = out.withColumn(f"__n{k}", F.explode(near))
    gap = reduce(Column.__add__, [F.col(f"__n{k}.gap") * F.col(f"__n{k}.gap") for k in range(len(axes))])
    domain = F.lit(0)
    for k in reversed(range(len(axes))):
        domain = domain * grid[k] + F.col(f"__n{k}.box")
    home = reduce(Column.__and__, [F.col(f"__n{k}.shift") == 0 for k in range(len(axes))]) & (domain == F.col("__home"))
    shifted = [(F.col(a) + F.col(f"__n{k}.shift") * e).alias(a) for k, (a, e) in enumerate(zip(axes, cell.edges, strict=True))]
    return out.where((gap < reach * reach) & ~home).select(domain.cast("long").alias("domain"), "source", *(F.col(f"__n{k}.shift").alias(f"s{a}") for k, a in enumerate(axes)), *shifted)


def halo_copy(replicas: DataFrame, owned: DataFrame, key: str, value: str) -> DataFrame:
    """Replicas with their owners' value."""
    return replicas.join(owned.select(F.col(key).alias("source"), value), "source")


def halo_sum(owned: DataFrame, key: str, value: str, replicas: DataFrame, amount: str) -> DataFrame:
    """(key, value): the owners' values and what their replicas add; the transpose of halo_copy."""
    back = replicas.groupBy(F.col("source").alias("__source")).agg(F.sum(amount).alias("__sum"))
    return owned.select(key, value).join(back, F.col(key) == F.col("__source"), "left").select(key, (F.col(value) + F.coalesce("__sum", F.lit(0))).alias(value))


def covered(before: DataFrame, now: DataFrame, key: str, axes: list[str], reach: float, cutoff: float) -> DataFrame:
    """One row: do the replicas still cover the cutoff? Twice the largest move is less than reach - cutoff."""
    old = before.select(F.col(key).alias("__old"), *(F.col(a).alias(f"__{a}") for a in axes))
    far = reduce(Column.__add__, [(F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in axes])
    return now.join(old, F.col(key) == F.col("__old")).agg((2 * F.sqrt(F.coalesce(F.max(far), F.lit(0.0))) < reach - cutoff).alias("covered"))


def interior_and_boundary(layout: DataFrame, key: str, touching: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose pairs touch no replica, and those (``touching``: their keys as ``source``) whose do."""
    edge = touching.select("source").distinct()
    on = F.col(key) == F.col("source")
    return layout.join(edge, on, "left_anti"), layout.join(edge, on, "left_semi")


def all_reduce(partials: DataFrame, *values: str) -> DataFrame:
    """One row: partial sums of the domains, folded in the order of the domains (a row each)."""
    listed = partials.agg(F.array_sort(F.collect_list(F.struct("domain", *values))).alias("__p"))
    plus = lambda v: lambda acc, x: acc + x[v]
    return listed.select(*(F.aggregate("__p", F.lit(0.0), plus(v)).alias(v) for v in values))

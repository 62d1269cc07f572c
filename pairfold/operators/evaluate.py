"""Derivatives of energies that are written as expressions: what a query asks of a potential.

A potential is an expression (pairfold.functions.expressions) of a row's columns and of parameters; its
derivatives are made as text is differentiated by hand and are ordinary Columns, so that an energy, its
forces and its parameters' derivatives are aggregates of one pass over the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfold.functions.expressions import Expression
from pairfold.functions.scalars import divide
from pairfold.operators.pairs import near_sums
from pairfold.operators.reduce import gather_pairs


def requested(rows: DataFrame, potential: str, parameters: dict[str, float], derivatives: list[str] = (), tangents: dict[str, dict[str, float]] | None = None, aggregate=F.sum) -> DataFrame:
    """One row: energy, d_<name> of each of ``derivatives``, t_<name> of each of ``tangents``.

    ``parameters`` are the potential's names that are not columns. A tangent is the derivative along a
    direction of parameters, given as their shares.
    """
    e = Expression.parse(potential)
    sums = {"energy": e.column(parameters)} | {f"d_{n}": e.derivative(n).column(parameters) for n in derivatives}
    for name, along in (tangents or {}).items():
        sums[f"t_{name}"] = reduce(Column.__add__, [F.lit(float(x)) * e.derivative(n).column(parameters) for n, x in along.items()])
    return rows.agg(*(aggregate(c).alias(n) for n, c in sums.items()))


def pair_force(potential: str, parameters: dict[str, float], axes: list[str], distance: str = "r") -> dict[str, Column]:
    """The force on i of a pair at the difference d<axis> = x_i - x_j: -u'(r) d / r per axis; NaN at r = 0, where it has no direction."""
    slope = Expression.parse(potential).derivative(distance).column(parameters)
    return {f"f{a}": divide(-slope * F.col(f"d{a}"), F.col(distance)) for a in axes}


def pair_forces(entities: DataFrame, key: str, pairs: DataFrame, potential: str, parameters: dict[str, float], axes: list[str]) -> DataFrame:
    """(key, f<axis>...): forces of all entities; 0 for those without a partner."""
    return gather_pairs(entities, key, pairs, [f"d{a}" for a in axes], **pair_force(potential, parameters, axes))


def pair_virial(pairs: DataFrame, potential: str, parameters: dict[str, float], axes: list[str], aggregate=F.sum) -> DataFrame:
    """One row: w<axis><axis> = the sum over pairs of difference times force, row by row."""
    force = pair_force(potential, parameters, axes)
    return pairs.agg(*(aggregate(F.col(f"d{a}") * force[f"f{b}"]).alias(f"w{a}{b}") for a in axes for b in axes))


def soft_forces(entities: DataFrame, key: str, axis: str, stiffness: float, cutoff: float) -> DataFrame:
    """(key, f<axis>): pair_forces() of ``stiffness/2*(cutoff - r)^2`` among all rows on a line, from sums over sorted rows instead of pairs."""
    side = F.col("side").cast("double")
    push = side * F.lit(float(stiffness)) * (F.lit(float(cutoff)) * F.col("n") - F.col("r"))
    found = near_sums(entities, key, axis, cutoff).groupBy(F.col(key).alias("__by")).agg(F.sum(push).alias("__f"), F.sum("zeros").alias("__zeros"))
    force = F.when(F.col("__zeros") > 0, F.lit(float("nan"))).otherwise(F.coalesce("__f", F.lit(0.0)))
    return entities.select(key).join(found, F.col(key) == F.col("__by"), "left").select(key, force.alias(f"f{axis}"))


def soft_virial(entities: DataFrame, key: str, axis: str, stiffness: float, cutoff: float) -> DataFrame:
    """One row: w<axis><axis>, pair_virial() of the potential of soft_forces(); null without a pair."""
    met = near_sums(entities, key, axis, cutoff, above=False)
    work = F.lit(float(stiffness)) * (F.lit(float(cutoff)) * F.col("r") - F.col("r2"))
    sums = met.agg(F.sum(work).alias("w"), F.sum("zeros").alias("zeros"), F.sum("n").alias("n"))
    return sums.select(F.when(F.col("zeros") > 0, F.lit(float("nan"))).when(F.col("n") > 0, F.col("w")).alias(f"w{axis}{axis}"))


def per_frame(frames: DataFrame, frame: str, potential: str, parameters: dict[str, float], derivatives: list[str] = (), aggregate=F.sum) -> DataFrame:
    """(frame, energy, d_<name>...) of rows that belong to frames: the energies and the Jacobian of all frames in one pass."""
    e = Expression.parse(potential)
    sums = {"energy": e.column(parameters)} | {f"d_{n}": e.derivative(n).column(parameters) for n in derivatives}
    return frames.groupBy(frame).agg(*(aggregate(c).alias(n) for n, c in sums.items()))


def frame_vjp(jacobian: DataFrame, cotangents: DataFrame, frame: str, derivatives: list[str], cotangent: str = "g", aggregate=F.sum) -> DataFrame:
    """One row: the sum over frames of cotangent times each column of the Jacobian."""
    met = jacobian.join(cotangents.select(F.col(frame).alias("__f"), F.col(cotangent).alias("__g")), F.col(frame) == F.col("__f"))
    return met.agg(*(aggregate(F.col("__g") * F.col(f"d_{n}")).alias(n) for n in derivatives))


def frame_jvp(jacobian: DataFrame, along: dict[str, float], frame: str) -> DataFrame:
    """(frame, tangent): the change of each frame's energy along a direction of parameters."""
    return jacobian.select(frame, reduce(Column.__add__, [F.lit(float(x)) * F.col(f"d_{n}") for n, x in along.items()]).alias("tangent"))


class Tunables:
    """Parameters with versions: each update is a version of its own, and any of them can be taken again."""

    def __init__(self, **values: float) -> None:
        self.history: list[dict[str, float]] = [dict(values)]

    @property
    def version(self) -> int:
        return len(self.history) - 1

    def snapshot(self, version: int | None = None) -> dict[str, float]:
        return dict(self.history[self.version if version is None else version])

    def update(self, **values: float) -> int:
        unknown = set(values) - set(self.history[-1])
        if unknown:
            raise KeyError(f"no such parameters: {sorted(unknown)}")
        self.history.append(self.history[-1] | {k: float(v) for k, v in values.items()})
        return self.version

    def gradient(self, rows: DataFrame, potential: str, aggregate=F.sum) -> dict[str, float]:
        """The derivatives of a potential's sum over rows by all parameters that it holds."""
        names = [n for n in self.history[-1] if n in Expression.parse(potential).names]
        row = requested(rows, potential, self.snapshot(), names, aggregate=aggregate).first()
        return {n: row[f"d_{n}"] for n in names}

    def table(self, spark) -> DataFrame:
        """(version, name, value) of all versions."""
        return spark.createDataFrame([(k, n, float(x)) for k, v in enumerate(self.history) for n, x in v.items()], "version int, name string, value double")

"""Single-step transforms of entity tables (positions x, y, z; velocities vx..; forces fx..; mass m).

Each is one projection or one aggregate; loops over steps are the caller's. Entities of mass 0 keep
their velocity and have no kinetic energy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def kick(table: DataFrame, dt: float, axes=AXES, mass: str = "m") -> DataFrame:
    return table.withColumns({f"v{a}": F.when(F.col(mass) == 0, F.col(f"v{a}")).otherwise(F.col(f"v{a}") + dt * F.col(f"f{a}") / F.when(F.col(mass) == 0, 1.0).otherwise(F.col(mass))) for a in axes})


def drift(table: DataFrame, dt: float, axes=AXES) -> DataFrame:
    return table.withColumns({a: F.col(a) + dt * F.col(f"v{a}") for a in axes})


def shift(table: DataFrame, by: dict[str, float]) -> DataFrame:
    """v - u."""
    return table.withColumns({f"v{a}": F.col(f"v{a}") - u for a, u in by.items()})


def scale(table: DataFrame, by: float | dict[str, float], axes=AXES) -> DataFrame:
    return table.withColumns({f"v{a}": F.col(f"v{a}") * (by if isinstance(by, (int, float)) else by[a]) for a in axes})


def momentum(table: DataFrame, axes=AXES, mass: str = "m", aggregate=F.sum) -> DataFrame:
    return table.agg(*(aggregate(F.col(mass) * F.col(f"v{a}")).alias(f"p{a}") for a in axes))


def kinetic(table: DataFrame, axes=AXES, mass: str = "m", aggregate=F.sum) -> DataFrame:
    """Half of the mass times the squared velocity, per axis."""
    return table.agg(*(aggregate(0.5 * F.col(mass) * F.col(f"v{a}") * F.col(f"v{a}")).alias(f"k{a}") for a in axes))


def half_step_excess(table: DataFrame, dt: float, axes=AXES, mass: str = "m", aggregate=F.sum) -> DataFrame:
    """dt^2 / 8 times the squared force over the mass, per axis; mass 0 is skipped."""
    return table.where(F.col(mass) > 0).agg(*(aggregate(dt * dt / 8 * F.col(f"f{a}") * F.col(f"f{a}") / F.col(mass)).alias(f"e{a}") for a in axes))


def centers(table: DataFrame, group: str, axes=AXES, mass: str = "m") -> DataFrame:
    """(group, c<axis>..., mass): mass-weighted centers of groups."""
    return table.groupBy(group).agg(*((F.sum(F.col(mass) * F.col(a)) / F.sum(mass)).alias(f"c{a}") for a in axes), F.sum(mass).alias("mass"))


def group_kinetic(table: DataFrame, group: str, axes=AXES, mass: str = "m") -> DataFrame:
    """Kinetic energy of the groups' centers, per axis."""
    sums = table.groupBy(group).agg(F.sum(mass).alias("__m"), *(F.sum(F.col(mass) * F.col(f"v{a}")).alias(f"__p{a}") for a in axes))
    return sums.where("__m > 0").agg(*(F.sum(0.5 * F.col(f"__p{a}") * F.col(f"__p{a}") / F.col("__m")).alias(f"k{a}") for a in axes))


def scale_positions(table: DataFrame, by: dict[str, float], group: str | None = None, mass: str = "m") -> DataFrame:
    """Positions scaled per axis; with ``group`` the groups move whole, by their centers."""
    if group is None:
        return table.withColumns({a: F.col(a) * f for a, f in by.items()})
    c = centers(table, group, tuple(by), mass).drop("mass").withColumnRenamed(group, "__group")
    return table.join(c, F.col(group) == F.col("__group")).withColumns({a: F.col(a) + (f - 1) * F.col(f"c{a}") for a, f in by.items()}).select(*table.columns)


def pressure(kinetic_: Column, virial: Column, volume: Column) -> Column:
    """(2 K - W) / V per axis, in bar for kJ/mol and nm^3."""
    return (2 * kinetic_ - virial) / volume * F.lit(16.605390671738466)

"""Energy terms as queries: tuples joined with their members' positions, a kernel, a sum.

Every function returns the tuples (or pairs) with their energy in the column ``u``; sum it, or gather
it per entity, with pairfold.operators.reduce. Positions are x, y, z of a table with a key.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfold.functions.expressions import Expression
from pairfold.functions.geometry import Cell, angle, dihedral, minus, norm, truncated, wrapped_angle
from pairfold.functions.scalars import erf, erfc, spline_grid
from pairfold.operators.pairs import block_sums
from pairfold.operators.reduce import members, per_entity

XYZ = ["x", "y", "z"]


def _at(place: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{place}_{a}") for a in XYZ)


def _with(table: DataFrame, tuples: DataFrame, places: list[str], key: str) -> DataFrame:
    return members(table, tuples, places, key, XYZ)


def bond(table: DataFrame, bonds: DataFrame, key: str = "pid", cell: Cell | None = None) -> DataFrame:
    """k/2 (r - r0)^2 of bonds (i, j, k, r0); also Urey-Bradley terms of outer members."""
    d = minus(_at("i"), _at("j"))
    r = norm(cell.image(d) if cell else d)
    return _with(table, bonds, ["i", "j"], key).withColumn("r", r).withColumn("u", 0.5 * F.col("k") * (F.col("r") - F.col("r0")) * (F.col("r") - F.col("r0")))


def bend(table: DataFrame, angles: DataFrame, key: str = "pid") -> DataFrame:
    """force/2 (theta - theta0)^2 of angles (i, j, k, force, theta0)."""
    t = _with(table, angles, ["i", "j", "k"], key).withColumn("theta", angle(_at("i"), _at("j"), _at("k")))
    return t.withColumn("u", 0.5 * F.col("force") * (F.col("theta") - F.col("theta0")) * (F.col("theta") - F.col("theta0")))


def torsion(table: DataFrame, dihedrals: DataFrame, key: str = "pid") -> DataFrame:
    """force (1 + cos(n phi - phase)) of dihedrals (i, j, k, l, force, n, phase)."""
    t = _with(table, dihedrals, ["i", "j", "k", "l"], key).withColumn("phi", dihedral(_at("i"), _at("j"), _at("k"), _at("l")))
    return t.withColumn("u", F.col("force") * (1 + F.cos(F.col("n") * F.col("phi") - F.col("phase"))))


def improper(table: DataFrame, impropers: DataFrame, key: str = "pid") -> DataFrame:
    """force/2 times the squared difference to xi0, wrapped to a turn, of (i, j, k, l, force, xi0)."""
    t = _with(table, impropers, ["i", "j", "k", "l"], key).withColumn("d", wrapped_angle(dihedral(_at("i"), _at("j"), _at("k"), _at("l")) - F.col("xi0")))
    return t.withColumn("u", 0.5 * F.col("force") * F.col("d") * F.col("d"))


def lennard_jones(pairs: DataFrame, sigma: Column, epsilon: Column, cutoff: float, kind: str = "none", start: float | None = None) -> DataFrame:
    """4 epsilon ((sigma/r)^12 - (sigma/r)^6) of pairs with a distance r, truncated as asked."""
    six = lambda r: F.pow(sigma / r, 6)
    u = lambda r: 4 * epsilon * (six(r) * six(r) - six(r))
    slope = lambda r: 4 * epsilon * (6 * six(r) - 12 * six(r) * six(r)) / r
    curvature = lambda r: 4 * epsilon * (156 * six(r) * six(r) - 42 * six(r)) / (r * r)
    return pairs.withColumn("u", truncated(kind, u, cutoff, slope, curvature, start)(F.col("r")))


def coulomb(pairs: DataFrame, qi: Column, qj: Column, cutoff: float, reaction_field: float | None = None, constant: float = 138.935456) -> DataFrame:
    """constant qi qj / r, or with a reaction field of the given permittivity, 0 at the cutoff."""
    r = F.col("r")
    if reaction_field is None:
        return pairs.withColumn("u", constant * qi * qj / r)
    k = (reaction_field - 1) / (2 * reaction_field + 1) / cutoff**3
    return pairs.withColumn("u", constant * qi * qj * (1 / r + k * r * r - (1 / cutoff + k * cutoff**2)))


def lennard_jones_power(pairs: DataFrame, sigma: Column, epsilon: Column, cutoff: float, start: float) -> DataFrame:
    """The same with forces switched off in half powers of r: each power n is r^-n less (start cutoff)^(-n/2) up to the
    start, and k (r^(-n/2) - cutoff^(-n/2))^2 with k = cutoff^(n/2) / (cutoff^(n/2) - start^(n/2)) behind it."""

    def part(n: int) -> Column:
        half = n // 2
        k = cutoff**half / (cutoff**half - start**half)
        rest = F.pow("r", -half) - F.lit(cutoff**-half)
        return F.when(F.col("r") <= start, F.pow("r", -n) - F.lit((start * cutoff) ** -half)).when(F.col("r") < cutoff, F.lit(k) * rest * rest).otherwise(0.0)

    return pairs.withColumn("u", 4 * epsilon * (F.pow(sigma, 12) * part(12) - F.pow(sigma, 6) * part(6)))


def soft_core(pairs: DataFrame, sigma: Column, epsilon: Column, decoupled: Column, alpha: float = 0.5, power: int = 1) -> DataFrame:
    """The energy of pairs that are decoupled by a share from 0 to 1: (1 - share) times that at (alpha sigma^6 share^power + r^6)^(1/6)."""
    six = F.pow(sigma, 6) / (alpha * F.pow(sigma, 6) * F.pow(decoupled, power) + F.pow("r", 6))
    return pairs.withColumn("u", (1 - decoupled) * 4 * epsilon * (six * six - six))


def screened(pairs: DataFrame, qi: Column, qj: Column, width: float, excluded: bool = False, constant: float = 138.935456) -> DataFrame:
    """The short-range part of a screened sum, constant qi qj erfc(width r) / r; for ``excluded`` pairs what the long-range
    part has given them and takes back, -constant qi qj erf(width r) / r."""
    share = -erf(width * F.col("r")) if excluded else erfc(width * F.col("r"))
    return pairs.withColumn("u", constant * qi * qj * share / F.col("r"))


def custom(rows: DataFrame, potential: str, **values: Column | float) -> DataFrame:
    """Any expression of a pair's, tuple's or row's columns and of values given by name."""
    return rows.withColumn("u", Expression.parse(potential).column(values))


def restraint(table: DataFrame, reference: DataFrame, key: str = "pid") -> DataFrame:
    """k/2 |x - x0|^2 of a reference table (key, x0, y0, z0, k)."""
    t = table.join(reference, key)
    d = tuple(F.col(a) - F.col(f"{a}0") for a in XYZ)
    return t.withColumn("u", 0.5 * F.col("k") * (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def external(table: DataFrame, field: Column, mask: Column | None = None) -> DataFrame:
    """Any field of a row's columns, over the rows of a selection."""
    return (table if mask is None else table.where(mask)).withColumn("u", field)


def correction_map(table: DataFrame, maps: DataFrame, values: list[list[float]], key: str = "pid") -> DataFrame:
    """A bicubic surface over two torsions of maps (i, j, k, l, m): phi of i, j, k, l and psi of j, k, l, m.

    ``values`` are the surface's at equal steps of both angles over a turn, from -pi on; it is periodic in both.
    """
    t = _with(table, maps, ["i", "j", "k", "l", "m"], key)
    t = t.withColumn("phi", dihedral(_at("i"), _at("j"), _at("k"), _at("l"))).withColumn("psi", dihedral(_at("j"), _at("k"), _at("l"), _at("m")))
    closed = [[*row, row[0]] for row in [*values, values[0]]]
    return t.withColumn("u", spline_grid([F.col("phi"), F.col("psi")], [(-math.pi, math.pi)] * 2, closed, periodic=True))


def close_pairs(table: DataFrame, pairs: DataFrame, key: str = "pid", charge: str = "q", cutoff: float = float("inf"), kind: str = "none", start: float | None = None, constant: float = 138.935456) -> DataFrame:
    """The scaled energy of pairs three bonds apart (i, j, sigma, epsilon, scale): 4 epsilon (..) and scale times the charges' one.

    The factor of the first part is in epsilon already.
    """
    t = members(table, pairs, ["i", "j"], key, [*XYZ, charge]).withColumn("r", norm(minus(_at("i"), _at("j"))))
    t = lennard_jones(t, F.col("sigma"), F.col("epsilon"), cutoff, kind, start)
    return t.withColumn("u", F.col("u") + constant * F.col("scale") * F.col(f"i_{charge}") * F.col(f"j_{charge}") / F.col("r"))


def pull(table: DataFrame, group: str, tuples: DataFrame, energy: Column, mass: str = "m", cell: Cell | None = None) -> DataFrame:
    """Energies of the centers of groups: tuples (a, b) with dx, dy, dz, r, or (a, b, c) with theta, and u, their energy.

    Centers are weighted by mass; a group of any size is one row of partial sums.
    """
    places = [c for c in ("a", "b", "c") if c in tuples.columns]
    center = table.groupBy(F.col(group).alias("__g")).agg(*((F.sum(F.col(mass) * F.col(x)) / F.sum(mass)).alias(x) for x in XYZ))
    t = members(center, tuples, places, "__g", XYZ)
    if len(places) == 3:
        return t.withColumn("theta", angle(_at("a"), _at("b"), _at("c"))).withColumn("u", energy)
    d = minus(_at("b"), _at("a"))
    d = cell.image(d) if cell else d
    return t.withColumns({f"d{x}": c for x, c in zip(XYZ, d, strict=True)}).withColumn("r", norm(tuple(F.col(f"d{x}") for x in XYZ))).withColumn("u", energy)


#: Shape of the smoothed radii: alpha, beta, gamma of the two published sets.
BORN_SHAPES = {"obc1": (0.8, 0.0, 2.909125), "obc2": (1.0, 0.8, 4.85)}


def _with_sides(entities: DataFrame, key: str, pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs (i, j, r) with i_<field> and j_<field>; those that come along with the pairs (``carry`` of range_pairs()) need no join."""
    names = [f"{s}_{f}" for s in "ij" for f in fields]
    if set(names) <= set(pairs.columns):
        return pairs.select("i", "j", "r", *names)
    side = lambda c: entities.select(F.col(key).alias(c), *(F.col(f).alias(f"{c}_{f}") for f in fields))
    return pairs.select("i", "j", "r").join(side("i"), "i").join(side("j"), "j")


def born_screened(entities: DataFrame, key: str, pairs: DataFrame, radius: str = "rho", scale: str = "scaled") -> DataFrame:
    """(key, screened): the sums over the pairs (i, j, r) of what each partner screens of an entity."""
    met = _with_sides(entities, key, pairs, [radius, scale])
    # Both directions of a pair at once, and shared terms as columns: Spark works a term out anew wherever a condition uses it.
    r, sides = F.col("r"), (("i", "j"), ("j", "i"))
    met = met.withColumns({f"__low_{a}": F.greatest(F.col(f"{a}_{radius}"), F.abs(r - F.col(f"{b}_{scale}"))) for a, b in sides} | {f"__high_{a}": r + F.col(f"{b}_{scale}") for a, b in sides})
    met = met.withColumns({f"__{n}_{a}": F.when(F.col(f"__low_{a}") < F.col(f"__high_{a}"), 1 / F.col(f"__{x}_{a}")) for a, _ in sides for n, x in (("p", "low"), ("q", "high"))})

    def integral(a: str, b: str) -> Column:
        p, q, ri, sj = F.col(f"__p_{a}"), F.col(f"__q_{a}"), F.col(f"{a}_{radius}"), F.col(f"{b}_{scale}")
        found = p - q + (p * p - q * q) * (sj * sj / (4 * r) - r / 4) + F.log(F.col(f"__low_{a}") * q) / (2 * r) + F.when(ri < sj - r, 2 * (1 / ri - p)).otherwise(0.0)
        return F.when(p.isNotNull(), found).otherwise(0.0)

    flat = met.select(F.explode(F.array(*(F.struct(F.col(a).alias("at"), integral(a, b).alias("value")) for a, b in sides))).alias("t")).select("t.*")
    return per_entity(entities, key, flat, "at", screened=F.col("value"))


def born_screened_near(entities: DataFrame, key: str, axes: list[str], cutoff: float, radius: str = "rho", scale: str = "scaled", rows: str | None = None) -> DataFrame:
    """born_screened() of all pairs closer than ``cutoff``, from blocks of rows instead of listed pairs.

    Entities may be sites() of equal radii, with ``rows`` as the number of their rows: at distance 0 nothing is screened.
    """

    def kernel(r, i, j):
        def one(ri, sj, n):
            low, high = np.maximum(ri, np.abs(r - sj)), r + sj
            p, q = 1 / low, 1 / high
            found = p - q + (p * p - q * q) * (sj * sj / (4 * r) - r / 4) + np.log(low * q) / (2 * r) + np.where(ri < sj - r, 2 * (1 / ri - p), 0.0)
            return np.where(low < high, found * n, 0.0)

        return one(i[radius], j[scale], j[rows] if rows else 1.0), one(j[radius], i[scale], i[rows] if rows else 1.0)

    flat = block_sums(entities, key, axes, cutoff, [radius, scale, *([rows] if rows else [])], kernel)
    return per_entity(entities, key, flat, "at", screened=F.col("value"))


def born_of(screened: Column, radius: Column, shape: str | None = None, own: Column | None = None) -> Column:
    """The effective radius from what is screened; with ``shape`` through a hyperbolic tangent and the intrinsic radius ``own``."""
    half = screened / 2
    if shape is None:
        return 1 / (1 / radius - half)
    a, b, c = BORN_SHAPES[shape]
    psi = half * radius
    return 1 / (1 / radius - F.tanh(a * psi - b * psi * psi + c * psi * psi * psi) / own)


def born_radii(entities: DataFrame, key: str, pairs: DataFrame, radius: str = "rho", scale: str = "scaled", shape: str | None = None, own: str | None = None) -> DataFrame:
    """(key, born): effective radii from sums over the pairs (i, j, r) of what each partner screens of an entity.

    ``radius`` is an entity's reduced radius, ``scale`` its scaled one. Without ``shape`` the radius is that of the
    plain sum; with one the sum goes through a hyperbolic tangent and needs the intrinsic radius ``own``.
    """
    sums = born_screened(entities, key, pairs, radius, scale)
    out = entities.join(sums.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"))
    return out.select(key, born_of(F.col("screened"), F.col(radius), shape, F.col(own) if own else None).alias("born"))


def generalized_born(entities: DataFrame, key: str, pairs: DataFrame, radii: DataFrame, charge: str = "q", inside: float = 1.0, outside: float = 78.5, constant: float = 138.935456) -> DataFrame:
    """(own, pairs): the energies of charges in a solvent, each one's own and that of the pairs (i, j, r)."""
    factor = -constant * (1 / inside - 1 / outside)
    held = entities.join(radii.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k")).select(F.col(key), F.col(charge), "born")
    own = held.agg(F.sum(F.lit(factor / 2) * F.col(charge) * F.col(charge) / F.col("born")).alias("own"))
    met = _with_sides(held, key, pairs, [charge, "born"])
    product = F.col("i_born") * F.col("j_born")
    f = F.sqrt(F.col("r") * F.col("r") + product * F.exp(-F.col("r") * F.col("r") / (4 * product)))
    between = met.agg(F.coalesce(F.sum(F.lit(factor) * F.col(f"i_{charge}") * F.col(f"j_{charge}") / f), F.lit(0.0)).alias("pairs"))
    return own.select("own", F.lit(0.0).alias("pairs")).unionByName(between.select(F.lit(0.0).alias("own"), "pairs")).agg(F.sum("own").alias("own"), F.sum("pairs").alias("pairs"))


def generalized_born_near(sites: DataFrame, key: str, axes: list[str], cutoff: float, charge: str, squares: str, inside: float = 1.0, outside: float = 78.5, constant: float = 138.935456) -> DataFrame:
    """generalized_born() of all pairs closer than ``cutoff``, from blocks of rows instead of listed pairs.

    ``sites`` (key, <axes>, born) have the sums of their rows' charges and, as ``squares``, of their squares: pairs of rows at
    one site are added.
    """
    factor = -constant * (1 / inside - 1 / outside)

    def kernel(r, i, j):
        product = i["born"] * j["born"]
        return i[charge] * j[charge] / np.sqrt(r * r + product * np.exp(-r * r / (4 * product))), np.zeros(len(r))

    q, q2, born = F.col(charge), F.col(squares), F.col("born")
    own = sites.agg(F.sum(F.lit(factor / 2) * q2 / born).alias("own"), F.coalesce(F.sum(F.lit(factor / 2) * (q * q - q2) / born), F.lit(0.0)).alias("pairs"))
    between = block_sums(sites, key, axes, cutoff, [charge, "born"], kernel).agg((F.lit(factor) * F.coalesce(F.sum("value"), F.lit(0.0))).alias("pairs"))
    return own.unionByName(between.select(F.lit(0.0).alias("own"), "pairs")).agg(F.sum("own").alias("own"), F.sum("pairs").alias("pairs"))


def alchemical(rows: DataFrame, potential: str, components: list[str], states: list[dict[str, float]], own: int, by: str | None = None, aggregate=F.sum) -> DataFrame:
    """([by], dh_<component>..., du_<state>...): derivatives by each component at the run's state, and U(state) - U(own).

    ``potential`` is an expression of a row's columns and the components; all states come from one pass over the rows.
    """
    e = Expression.parse(potential)
    at_own = e.column(states[own])
    sums = {f"dh_{c}": e.derivative(c).column(states[own]) for c in components} | {f"du_{k}": e.column(s) - at_own for k, s in enumerate(states)}
    return (rows if by is None else rows.groupBy(by)).agg(*(aggregate(c).alias(n) for n, c in sums.items()))

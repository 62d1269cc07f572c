"""Sums over rows, pairs and tuples; per-entity sums that keep the entities without a partner; lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfold.functions.geometry import Cell
from pairfold.functions.scalars import exact_sum
from pairfold.operators.pairs import at_sites, directed, site_pairs, site_sums, sites


def total(table: DataFrame, **sums: Column) -> DataFrame:
    """One row of sums over the rows of a table; flags (boolean columns) combine by any."""
    kinds = dict(table.select(*(c.alias(n) for n, c in sums.items())).dtypes)
    return table.agg(*((F.coalesce(F.bool_or(c), F.lit(False)) if kinds[n] == "boolean" else F.coalesce(F.sum(c), F.lit(0))).alias(n) for n, c in sums.items()))


def per_entity(entities: DataFrame, key: str, contributions: DataFrame, by: str, **sums: Column) -> DataFrame:
    """(key, sums...) of every entity; 0 for those without a contribution."""
    found = contributions.groupBy(F.col(by).alias("__by")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    return entities.select(key).join(found, F.col(key) == F.col("__by"), "left").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in sums))


def gather_pairs(entities: DataFrame, key: str, pairs: DataFrame, signed: list[str] = (), **kernels: Column) -> DataFrame:
    """Per-entity sums of kernels over the directed pairs; the kernels see i, j and the pair's columns."""
    return per_entity(entities, key, directed(pairs, signed), "i", **kernels)


def gather_sites(entities: DataFrame, key: str, axes: list[str], cutoff: float, cell: Cell | None = None, **kernels: Column) -> DataFrame:
    """gather_pairs() of kernels that depend on the distance only, and are even in it, from the pairs of places (site_pairs())."""
    places = sites(entities, key, axes)
    sums = site_sums(site_pairs(places, axes, cutoff, cell), **kernels)
    return at_sites(entities.select(key, *axes), places, axes).join(sums, "site", "left").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in kernels))


def lookup(table: DataFrame, dimension: DataFrame, on: list[str], symmetric: bool = False) -> DataFrame:
    """Parameters by type codes; rows without an entry get nulls.

    A symmetric table of two codes need hold one order of them. The join is left to Spark, which
    broadcasts the dimension if its measured size allows.
    """
    if symmetric:
        a, b = on
        turned = {a: b, b: a}
        other = dimension.where(F.col(a) != F.col(b)).select(*(F.col(turned.get(c, c)).alias(c) for c in dimension.columns))
        dimension = dimension.unionByName(other.join(dimension.select(a, b), [a, b], "left_anti"))
    return table.join(dimension, on, "left")


def members(table: DataFrame, tuples: DataFrame, places: list[str], key: str, fields: list[str]) -> DataFrame:
    """Tuples with their members' fields: <place>_<field> for each place, by one equi-join per place."""
    out = tuples
    for p in places:
        side = table.select(F.col(key).alias(p), *(F.col(f).alias(f"{p}_{f}") for f in fields))
        out = out.join(side, p)
    return out


def gather_tuples(entities: DataFrame, key: str, tuples: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(key, total): per entity the sum of its values over the tuples and places that it is in."""
    flat = tuples.select(F.explode(F.array(*(F.struct(F.col(p).alias("at"), v.alias("value")) for p, v in values.items()))).alias("t")).select("t.*")
    return per_entity(entities, key, flat, "at", total=F.col("value"))


def scatter_add(destination: DataFrame, key: str, base: Column, source: DataFrame, index: str, value: Column) -> DataFrame:
    """(key, total): the base of each destination row and what the source rows add to it."""
    added = source.groupBy(F.col(index).alias("__at")).agg(F.sum(value).alias("__sum"))
    return destination.select(F.col(key), base.alias("__base")).join(added, F.col(key) == F.col("__at"), "left").select(key, (F.col("__base") + F.coalesce("__sum", F.lit(0))).alias("total"))


def disjoint(*memberships: DataFrame) -> DataFrame:
    """Entities that stand in more than one tuple of (tid, member) tables; empty if the tables are disjoint."""
    out = memberships[0].select("member")
    for m in memberships[1:]:
        out = out.unionByName(m.select("member"))
    return out.groupBy("member").count().where("count > 1")


def mixed_parameter(a: Column, b: Column, rule: str) -> Column:
    """Combining rules of pair parameters: arithmetic, geometric or product."""
    return {"arithmetic": (a + b) / 2, "geometric": F.sqrt(a * b), "product": a * b}[rule]


def overridden(mixed: Column, override: Column) -> Column:
    """A pair-type override in place of the mixed value."""
    return F.coalesce(override, mixed)


def accumulate(*contributions: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) sums of several contributions in one aggregation instead of a join each."""
    out = contributions[0].select(key, value)
    for c in contributions[1:]:
        out = out.unionByName(c.select(key, value))
    return out.groupBy(key).agg(F.sum(value).alias(value))


__all__ = ["accumulate", "disjoint", "exact_sum", "gather_pairs", "gather_sites", "gather_tuples", "lookup", "members", "mixed_parameter", "overridden", "per_entity", "scatter_add", "total"]

"""Ordered collections: prefix sums, binned sorts and folds, compaction, stable partition, ragged rows.

Places in a global order and prefix sums are made in two phases: rows are range-partitioned and sorted
in their partitions, where they get a running number, and are written out once, so that both phases see
the same partitions; then the sums of the partitions before it (one row per partition) are joined to
each. There is one shuffle of the rows, and no window ever runs over a whole table in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairfold.work import stored

#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def _ordered(table: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows with their range partition and their place in it, from 1; stored."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = stored(table.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    return rows.select(*table.columns, F.shiftright("__id", _ROW_BITS).alias("__part"), (F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1) + 1).alias("__at"))


def _before(per_part: DataFrame, value: str) -> DataFrame:
    """(__p, __base): the sum of ``value`` over the partitions before each; as many rows as partitions."""
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(F.col("__part").alias("__p"), F.coalesce(F.sum(value).over(ahead), F.lit(0)).alias("__base"))


def places(table: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """0-based places in a global order; ``order`` must tell all rows apart."""
    rows = _ordered(table, order)
    base = _before(rows.groupBy("__part").agg(F.count("*").alias("__n")), "__n")
    return rows.join(base, F.col("__part") == F.col("__p")).select(*table.columns, (F.col("__base") + F.col("__at") - 1).alias(name))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column becomes the sum of its values in the partition's rows before; nulls count 0."""
    total = 0
    for batch in batches:
        v = np.nan_to_num(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)).astype(np.int64)
        upto = np.cumsum(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total + upto - v, pa.int64())], batch.schema.names)
        total += int(upto[-1]) if len(upto) else 0


def scan(table: DataFrame, order: list[str | Column], count: str, name: str = "start") -> DataFrame:
    """The exclusive prefix sum of whole counts; the total is the last start and its count. 64 bits, no wrapping."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = table.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__in", F.col(count).cast("long"))
    rows = stored(rows.mapInArrow(_running, rows.schema).withColumn("__part", F.spark_partition_id()), "scanned")
    base = _before(rows.groupBy("__part").agg(F.sum(count).alias("__n")), "__n")
    return rows.join(base, F.col("__part") == F.col("__p")).select(*table.columns, (F.col("__base") + F.col("__in")).alias(name))


def ordered_by_group(table: DataFrame, group: str, order: list[str | Column], name: str = "at") -> DataFrame:
    """Rows with their 0-based place inside their group; a group of any size spans many partitions."""
    rows = places(table, [group, *order], "__place")
    first = rows.groupBy(F.col(group).alias("__group")).agg(F.min("__place").alias("__first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("__group"))).select(*table.columns, (F.col("__place") - F.col("__first")).alias(name))


def bin_starts(table: DataFrame, bin_: Column, bins: int) -> DataFrame:
    """(bin, count, start) of all bins 0..bins-1, empty ones included; rows with a negative or null bin are in none."""
    counts = table.select(bin_.cast("long").alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))
    every = table.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("count"))
    return scan(every, ["bin"], "count", "start")


def sort_by_key(table: DataFrame, bin_: Column, bins: int | None, by: list[str], name: str = "place") -> DataFrame:
    """Rows with bin and place: a counting sort, stable by ``by`` in each bin; bin_starts() has the bins' starts.

    Without ``bins`` there are as many as the rows need.
    """
    rows = table.withColumn("bin", bin_.cast("long")).where("bin >= 0" if bins is None else F.col("bin").between(0, bins - 1))
    return places(rows, ["bin", *by], name)


def scatter_to_bins(table: DataFrame, bin_: Column, bins: int, item: str) -> DataFrame:
    """(bin, item): the items of each bin, in no order; null and negative bins, and those beyond, are in none."""
    return table.select(bin_.cast("long").alias("bin"), F.col(item).alias("item")).where(F.col("bin").between(0, bins - 1))


def bin_span(runs: DataFrame, starts: DataFrame, from_: str = "from", to: str = "to") -> DataFrame:
    """``runs`` with first and end: the places of the bins from ``from`` up to, not including, ``to``.

    ``starts`` is bin_starts(); a run may end behind the last bin.
    """
    at = starts.select(F.col("bin"), F.col("start"))
    behind = starts.select((F.col("bin") + 1).alias("__to"), (F.col("start") + F.col("count")).alias("__end"))
    met = runs.join(at.select(F.col("bin").alias("__from"), F.col("start").alias("first")), F.col(from_) == F.col("__from"), "left").join(behind, F.col(to) == F.col("__to"), "left")
    return met.select(*runs.columns, "first", F.when(F.col(to) <= F.col(from_), F.col("first")).otherwise(F.col("__end")).alias("end"))


def bin_item(wanted: DataFrame, ordered: DataFrame, item: str, at: str = "at", place: str = "place") -> DataFrame:
    """``wanted`` with the item that stands at the place ``at`` of an ordered collection; null beyond its end."""
    return wanted.join(ordered.select(F.col(place).alias("__place"), F.col(item).alias("item")), F.col(at) == F.col("__place"), "left").drop("__place")


def sort_bins(table: DataFrame, bin_: str, by: list[str | Column], name: str = "rank") -> DataFrame:
    """Ranks from 0 inside each bin."""
    return ordered_by_group(table, bin_, by, name)


_SIGN = 1 << 63


def _unsigned(fold: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A fold of whole numbers in the order of their bits: the sign bit turned over and back."""
    turned = lambda c: c.cast("long").bitwiseXOR(F.lit(-_SIGN).cast("long"))
    return lambda c: turned(fold(turned(c)))


def _numbers(fold: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A fold of doubles that leaves NaN out unless there is nothing else."""
    return lambda c: F.coalesce(fold(F.when(~F.isnan(c.cast("double")), c.cast("double"))), F.max(c.cast("double")))


COMBINERS: dict[str, Callable[[Column], Column]] = {
    "add": F.sum, "multiply": F.product, "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor, "max": F.max, "min": F.min,
    "max_unsigned": _unsigned(F.max), "min_unsigned": _unsigned(F.min), "max_number": _numbers(F.max), "min_number": _numbers(F.min),
}


def bin_members(table: DataFrame, bin_: str, value: str, combiners: list[str]) -> DataFrame:
    """(bin, <combiner>...): folds of each bin's values that any order gives alike."""
    return table.groupBy(bin_).agg(*(COMBINERS[c](F.col(value)).alias(c) for c in combiners))


def ordered_fold(table: DataFrame, bin_: str, by: list[str], value: str, start: float, step: Callable[[Column, Column], Column], name: str = "fold") -> DataFrame:
    """(bin, fold): a fold of each bin's values in the order of ``by``. The members of a bin are gathered in one array."""
    listed = table.groupBy(bin_).agg(F.array_sort(F.collect_list(F.struct(*by, F.col(value).alias("__v")))).alias("__m"))
    return listed.select(bin_, F.aggregate("__m", F.lit(start), lambda acc, x: step(acc, x["__v"])).alias(name))


def streamed_fold(table: DataFrame, bin_: str, by: list[str], value: str, start: float, step: Callable[[float, np.ndarray], float], name: str = "fold") -> DataFrame:
    """(bin, fold): the same for bins of any size: a bin's rows stream through a task in the order of ``by``.

    ``step`` takes the fold so far and the next values of the bin, as many as happen to be at hand.
    """
    rows = table.select(F.col(bin_).alias("__bin"), F.xxhash64(F.col(bin_), F.col(bin_).isNull()).alias("__of"), *by, F.col(value).cast("double").alias("__v"))
    kind = table.schema[bin_].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, key, fold = None, None, start
        for frame in frames:
            ids = frame["__of"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist() if len(ids) else []
            done = []
            for a, b in zip(cuts, [*cuts[1:], len(ids)]):
                if ids[a] != of:
                    if of is not None:
                        done.append((key, fold))
                    of, key, fold = ids[a], frame["__bin"].iloc[a], start
                fold = step(fold, frame["__v"].to_numpy()[a:b])
            yield pd.DataFrame(done, columns=[bin_, name])
        if of is not None:
            yield pd.DataFrame([(key, fold)], columns=[bin_, name])

    return rows.repartition("__of").sortWithinPartitions("__of", *by).mapInPandas(run, f"{bin_} {kind}, {name} double")


def append(table: DataFrame, keep: Column, order: list[str], block: int, blocks: int) -> DataFrame:
    """Kept rows in blocks of ``block``: columns place, block, slot and written.

    Rows beyond the capacity of ``blocks`` blocks are counted (written is false), not lost.
    """
    rows = places(table.where(keep), order)
    return rows.withColumn("block", F.floor(F.col("place") / block).cast("long")).withColumn("slot", F.pmod("place", F.lit(block))).withColumn("written", F.col("place") < block * blocks)


def nonzero(table: DataFrame, order: list[str], value: str, name: str = "item") -> DataFrame:
    """(place, item): the places of nonzero (or NaN) values ascending, then -1-place of the others ascending."""
    rows = places(table, order, "__place")
    hit = (F.col(value) != 0) | F.isnan(F.col(value).cast("double"))
    found = rows.select(F.coalesce(hit, F.lit(False)).alias("hit"), "__place")
    out = places(found, [(~F.col("hit")).cast("int"), F.col("__place")])
    return out.select("place", F.when(F.col("hit"), F.col("__place")).otherwise(-1 - F.col("__place")).alias(name))


def permute(table: DataFrame, key: str, permutation: DataFrame, to: str = "place", source: str = "item") -> DataFrame:
    """Rows taken by a permutation (place, item): row ``item`` comes to ``place``."""
    moves = permutation.select(F.col(source).alias("__from"), F.col(to))
    return moves.join(table, F.col("__from") == F.col(key)).drop("__from")


def spatial_order(table: DataFrame, axes: list[str], width: float, key: str, name: str = "place") -> DataFrame:
    """Places in the order of (bin, key), bins being ``width`` wide."""
    bins = [F.floor(F.col(a) / width).cast("long").alias(f"__c{k}") for k, a in enumerate(axes)]
    return places(table.select("*", *bins), [f"__c{k}" for k in range(len(axes))] + [key], name).select(*table.columns, name)


def incidence(tuples: DataFrame, tid: str, members: list[str]) -> DataFrame:
    """(member, tuples): the inverted index from members to the tuples and places that they stand in."""
    flat = tuples.select(tid, F.posexplode(F.array(*members)).alias("place", "member"))
    return flat.groupBy("member").agg(F.array_sort(F.collect_list(F.struct(F.col(tid).alias("tid"), "place"))).alias("tuples"))


def incidence_entries(tuples: DataFrame, tid: str, members: list[str]) -> DataFrame:
    """(member, at, tid, place): the same, an entry a row, with its place in the member's list."""
    flat = tuples.select(F.col(tid).alias("tid"), F.posexplode(F.array(*members)).alias("place", "member"))
    return ordered_by_group(flat, "member", ["tid", "place"], "at").select("member", "at", "tid", "place")


def renumber(tuples: DataFrame, members: list[str], ids: DataFrame, old: str, new: str) -> DataFrame:
    """Members of tuples by new numbers; one equi-join per place."""
    out = tuples
    for m in members:
        out = out.join(ids.select(F.col(old).alias("__old"), F.col(new).alias("__new")), F.col(m) == F.col("__old")).withColumn(m, F.col("__new")).drop("__old", "__new")
    return out


def ragged(table: DataFrame, owner: str, owners: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, first, count, entries): the entries of each owner as an array in order; owners without any have an empty one."""
    kinds = ", ".join(f"{f}: {table.schema[f].dataType.simpleString()}" for f in [*order, *[x for x in fields if x not in order]])
    listed = table.groupBy(F.col(owner).alias("__owner")).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("entries"))
    rows = owners.select(key).join(listed, F.col(key) == F.col("__owner"), "left").select(key, F.coalesce("entries", F.array().cast(f"array<struct<{kinds.replace(': ', ':')}>>")).alias("entries"))
    return scan(rows.withColumn("count", F.size("entries").cast("long")), [key], "count", "first").select(key, "first", "count", "entries")


def ragged_entries(table: DataFrame, owner: str, order: list[str], fields: list[str]) -> DataFrame:
    """(owner, entry, <order>..., <fields>...): the entries of all owners, an entry a row, numbered from 0 in its owner."""
    rows = table.where(F.col(owner).isNotNull()).select(owner, *order, *[f for f in fields if f not in order])
    return ordered_by_group(rows, owner, order, "entry")


def grid_plan(length: float, width: float, least: int, most: int) -> int:
    """Bins along an axis: length / width in whole numbers, from ``least`` to ``most``; NaN gives ``least``."""
    ratio = length / width if width else float("inf")
    if ratio != ratio:
        return least
    return int(min(max(ratio // 1 if ratio != float("inf") else most, least), most))


def occupancy_width(occupancy: float, volume: float, population: float) -> float:
    """The edge of a bin that holds ``occupancy`` rows on average."""
    return (occupancy * volume / population) ** (1 / 3) if population else float("nan")


def wrap(start: Column, offset: Column, size: int) -> Column:
    """(start + offset) modulo size, for both below size."""
    s = start + offset
    return F.when(s >= size, s - size).otherwise(s)

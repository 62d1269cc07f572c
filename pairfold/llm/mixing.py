"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies (the source's target over its
size). The prefix sums of these expectations run along the documents of the source in order of
size; one random offset per source is added, and a document is emitted once for each integer
boundary that its step crosses. In order of size the sum of the words taken telescopes, so that a
source misses its target by about the size of its largest document at most.

The order is a distributed one: documents are range-partitioned by (source, size, key), ranked
within (partition, source), and each partition's offset is the count before it. A source that holds
a third of all rows spans many partitions; no group is gathered in one task. Sources are ordered the
same way; plain windows run over a row per partition, or over one source's partitions.

Defined cases: null and empty texts have size 0 and are taken with 0 words; a null source is a
source of its own, ordered last; a null key sorts first; rows that agree in source, size, key and
text are interchangeable; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from pairfold.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(table: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """``table`` and inclusive running sums along a global order: inside range partitions, and over the partitions before."""
    placed = stored(table.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "mix-order")
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(F.col("__part").alias("__p")).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = parts.select("__p", *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums))
    rows = placed.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(before, F.col("__part") == F.col("__p"))
    return rows.select(*table.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: int = 2) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, source_size), of which there may be many.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``budget`` times
    all sizes. A target stops at ``cap`` times its source's size and the rest is shared anew by
    weight: with the sources ordered by cap / weight those that stop come first, so one running sum
    finds the common level, a number that comes to the driver.
    """
    ranked = _running(sizes.withColumn("missing", F.col("source").isNull()), ["missing", "source"], rank=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).withColumn("full_at", F.col("most") / F.col("weight")).drop("rank")
    filled = stored(_running(full, ["full_at", "missing", "source"], upto=F.col("most"), weighed=F.col("weight")), "mix-sources")
    everything, weighed = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    spent, left = F.col("upto") - F.col("most"), F.lit(weighed or 0) - F.col("weighed") + F.col("weight")
    levels = filled.withColumn("spent", spent).withColumn("level", (F.lit(everything or 0) * F.lit(budget) - F.col("spent")) / left)
    first = levels.where(F.col("most") > F.col("weight") * F.col("level")).agg(F.min(F.struct("full_at", "spent", "level")).alias("first")).first()["first"]
    target = F.least(F.col("weight") * F.lit(float("inf") if first is None else float(first.level)), F.col("most").cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def systematic_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: int = 2, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", tie: Column | None = None) -> DataFrame:
    """(key, tie, source, size, source_size, target, copies), a row per row of ``docs``.

    ``tie`` is a hash of the text if none is given. ``copies`` is at most ``cap``; the copies of all rows of a source
    times their sizes come near its target. The same rows give the same copies, however they are
    partitioned.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), (F.xxhash64(F.col(text)) if tie is None else tie).alias("tie"))
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("key"), F.col("tie")]
    placed = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix")
    counts = placed.groupBy("part", "source").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).select("part", "source", "start")
    targets = source_targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    targets = targets.withColumn("offset", F.conv(F.substring(F.md5(named), 1, 4), 16, 10).cast("double") / 65536)
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # Of the two tables that are joined to the rows, one has a row per source and the other one per source and partition.
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.part", F.col("s.source").alias("of"), "start", "source_size", "target", "offset", "rate")
    within = Window.partitionBy("part", "source").orderBy("size", "key", "tie")
    ranked = placed.withColumn("place", F.row_number().over(within)).withColumnRenamed("part", "in_part")
    joined = ranked.join(starts, (F.col("in_part") == F.col("part")) & F.col("source").eqNullSafe(F.col("of")))
    place = F.col("start") + F.col("place")
    crossed = F.floor(F.col("offset") + F.col("rate") * place) - F.floor(F.col("offset") + F.col("rate") * (place - 1))
    return joined.select("key", "tie", "source", "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; nulls count by their place, nested values as JSON."""
    nested = {f.name for f in docs.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))}
    named = {c: F.col(f"`{c}`") for c in docs.columns}
    values = [F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"}) if c in nested else x for c, x in named.items()]
    return F.xxhash64(*values, *[x.isNull() for x in named.values()])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the columns of ``docs`` and ``copy``, a row for each copy that is taken.

    Rows that agree in all columns are one document here, with the copies of all of them.
    """
    tie = row_hash(docs)
    taken = (
        systematic_copies(docs, weights, budget, cap, seed, tie=tie)
        .groupBy(F.col("key").alias("__key"), F.col("source").alias("__from"), F.col("tie").alias("__of"))
        .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
        .where("__copies > 0")
    )
    tied = docs.withColumn("__tie", tie)
    found = tied.join(taken, F.col("doc_id").eqNullSafe(F.col("__key")) & F.col("source").eqNullSafe(F.col("__from")) & (F.col("__tie") == F.col("__of")))
    # Each of several equal rows would bring the copies of all of them.
    out = found.where("__rows = 1").unionByName(found.where("__rows > 1").dropDuplicates(["doc_id", "source", "__tie"]))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns, "copy")

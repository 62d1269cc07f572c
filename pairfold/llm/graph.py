"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per vertex and a join, both of which split hot vertices (partial
aggregation; skewed joins are split at run time); no component is ever gathered. Each round is
written to the shared folder, so that lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(vertex, root) of every vertex that has a link to another one; the root is the least vertex.

    ``edges``: columns a and b of one orderable type, in any order, repeated or not.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), label)
    mark = None
    while True:
        edges = stored(_small_star(_large_star(edges)), label)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or row[0] == 0:
            break
        mark = tuple(row)
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())

"""Sinks that a restarted stream continues: a batch that is written again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resumable(path: str, report: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a partition of a Parquet table, overwritten if the batch comes again."""

    def write(batch: DataFrame, number: int) -> None:
        rows = report(batch) if report else batch
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def written_batches(rows: DataFrame, path: str, number: Column, report: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Many batches at once into the table of resumable(): ``number`` is a row's batch; each batch given replaces itself.

    One pass over the rows, whatever their number of batches.
    """
    numbered = rows.withColumn("batch", number.cast("int"))
    kept = (report(numbered) if report else numbered).repartition("batch")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def reporters(reports: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]], step: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: several resumable sinks of one stream; each path gets its report of the rows of every ``period``-th step."""
    if any(period < 1 for period, _ in reports.values()):
        raise ValueError("a period is 1 or more")
    writers = {path: (period, resumable(path, report)) for path, (period, report) in reports.items()}

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read once, written several times
        for period, writer in writers.values():
            writer(held.where(F.col(step) % period == 0), number)
        held.unpersist()

    return write


def continued(rows: DataFrame, step: str, after: int) -> DataFrame:
    """Rows that a continuation from a step keeps: those up to it; later ones are made anew."""
    return rows.where(F.col(step) <= after)

"""Windows over whole steps or event time; the same calls serve tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_step(table: DataFrame, step: str, period: int, *keys: str):
    """Groups of ``period`` consecutive steps."""
    if period < 1:
        raise ValueError("a period is 1 or more")
    return table.groupBy(F.floor(F.col(step) / period).cast("long").alias("period"), *keys)


def nested(*periods: int) -> None:
    """Check that reporting periods nest: each divides the next longer one."""
    for short, long in zip(sorted(periods), sorted(periods)[1:]):
        if long % short:
            raise ValueError(f"the periods {short} and {long} do not nest")


def by_time(table: DataFrame, time: str, length: str, *keys: str, late: str | None = None):
    """Tumbling windows of event time; ``late`` is how long a stream waits for late rows."""
    if late is not None:
        table = table.withWatermark(time, late)
    return table.groupBy(F.window(time, length), *keys)

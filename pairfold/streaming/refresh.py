"""Emit a row when a value has moved further from its reference than a threshold; it is the next reference.

The batch form sorts each entity's rows and walks through them with one number of state per entity;
the streaming form keeps that number in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crossings(table: DataFrame, key: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """(key, <order>..., value) of the rows that reset their entity's reference, the first one included.

    Rows stream through the tasks in order; an entity, however long, needs no memory but its reference.
    """
    rows = table.where(F.col(value).isNotNull()).select(key, *order, value)
    # Rows of one key have one number; null is a key like any other.
    marked = rows.withColumn("__of", F.xxhash64(F.col(key), F.col(key).isNull()))

    names = rows.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, reference = None, None
        for frame in frames:
            keep = []
            missing = frame[key].isna().tolist()
            for k, gone, of, v in zip(frame[key].tolist(), missing, frame["__of"].tolist(), frame[value].tolist(), strict=True):
                now = (of, gone, None if gone else k)
                far = now != entity or abs(v - reference) > threshold
                if far:
                    entity, reference = now, v
                keep.append(far)
            yield frame.loc[keep, names]

    return marked.repartition(key).sortWithinPartitions(key, *order).mapInPandas(walk, rows.schema)


def stream_crossings(stream: DataFrame, key: str, step: str, value: str, threshold: float) -> DataFrame:
    """The same for a stream of (key, step, value) rows: state is the reference of each key.

    The rows of a key in one micro-batch are put in order; the trigger bounds how many these are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def update(keys, frames, state):
        reference = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values(step, kind="stable")
        keep = []
        for v in frame[value].tolist():
            far = reference is None or abs(v - reference) > threshold
            reference = v if far else reference
            keep.append(far)
        yield frame[keep]
        if reference is not None:
            state.update((float(reference),))

    rows = stream.where(F.col(value).isNotNull()).select(key, step, value)
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, {step} {kinds[step]}, {value} {kinds[value]}", "reference double", "append", "NoTimeout")

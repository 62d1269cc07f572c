"""Chunks of documents and an exchange of named values between them.

Corpus statistics over millions of distinct names (shingles, n-grams, substrings) cost a row of
dozens of bytes per name and document if they are exploded. Here documents are packed where they are
read into chunks of a few MB of text. A chunk names what it holds by sorted 64-bit hashes and sends
each name once, with one combined value, in blobs cut by ranges of names; a reducer combines all
chunks' values of a name and sends each chunk the results in the order that the chunk sent its
names. Whatever is combined is combined inside the chunk first, so that no name, however frequent,
weighs more than one entry per chunk, and no task holds more than a range of names.

A blob for each chunk and range grows with the square of the input. Beyond ``ONE_LEVEL`` ranges the
exchange has two levels: chunks cut their names into the square root of the ranges, groups of as many
chunks are merged there and cut into the ranges themselves, and the results come back by the same way.
The blobs then grow with the power 1.5, and stay as large as chunks of a terabyte make them.

The chunk table is bucketed by chunk: passes over it that join what came back move only the blobs.
Names are 64-bit hashes; two of n different strings share one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import new_path, stored

#: Bytes of text in a chunk (a longer document is a chunk of its own) and per range of names.
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 6 << 20
#: Ranges that an exchange of one level may have.
ONE_LEVEL = 4096

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    out = a * M1
    out += b * M2
    out ^= out >> np.uint64(32)
    out *= M3
    return out


def pack_ints(values: np.ndarray) -> bytes:
    """Whole numbers in few bytes each; those that need more than most others are held apart, with their places."""
    if not len(values):
        return b""
    values = values.astype(np.int64)
    low = int(values.min())
    rest = (values - low).astype(np.uint64)
    width, apart = max(1, (int(rest.max()).bit_length() + 7) // 8), np.zeros(0, dtype=np.uint32)
    while width > 1:
        over = np.flatnonzero(rest >= np.uint64(1 << (8 * width - 8))).astype(np.uint32)
        if 12 * len(over) >= len(rest) + 12 * len(apart):
            break
        width, apart = width - 1, over
    head = low.to_bytes(8, "little", signed=True) + bytes([width | (0x80 if len(apart) else 0)])
    if len(apart):
        head += len(apart).to_bytes(4, "little") + apart.tobytes() + rest[apart].tobytes()
    return head + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    width, at = data[8] & 0x7F, 9
    if data[8] & 0x80:
        n = int.from_bytes(data[9:13], "little")
        apart, whole, at = np.frombuffer(data, dtype=np.uint32, count=n, offset=13), np.frombuffer(data, dtype=np.uint64, count=n, offset=13 + 4 * n), 13 + 12 * n
    body = np.frombuffer(data, dtype=np.uint8, offset=at).reshape(-1, width)
    wide = np.zeros((len(body), 8), dtype=np.uint8)
    wide[:, :width] = body
    out = wide.view(np.uint64).ravel()
    if data[8] & 0x80:
        out[apart] = whole
    return out.astype(np.int64) + int.from_bytes(data[:8], "little", signed=True)


def pack_names(names: np.ndarray) -> bytes:
    """Sorted names as steps from one to the next."""
    if not len(names):
        return b""
    return int(names[0]).to_bytes(8, "little") + pack_ints(np.diff(names).view(np.int64)) if len(names) > 1 else int(names[0]).to_bytes(8, "little")


def unpack_names(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    first = np.frombuffer(data, dtype=np.uint64, count=1)
    steps = unpack_ints(data[8:]).view(np.uint64)
    return np.cumsum(np.r_[first, steps], dtype=np.uint64)


def make_chunks(docs: DataFrame, columns: list, schema: str, pack: Callable[[list[tuple]], dict], n_bytes: int, chunk_bytes: int | None = None) -> DataFrame:
    """A table of chunks, bucketed by ``chunk``.

    ``columns``: what a document is packed from, the text first. ``pack`` turns the documents of a
    chunk, tuples of those columns with the text as bytes or None, into the columns of ``schema``.
    """
    spark, chunk_bytes = docs.sparkSession, chunk_bytes or CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, group, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            made = {"chunk": at, **pack(group)}
            return pa.RecordBatch.from_pylist([{f.name: made[f.name] for f in arrow}], arrow)

        for batch in batches:
            rest = [c.to_pylist() for c in batch.columns[1:]]
            for k, value in enumerate(batch.column(0).cast(pa.binary())):
                text = value.as_py()
                if group and size + len(text or b"") > chunk_bytes:
                    yield row()
                    at, group, size = at + 1, [], 0
                group.append((text, *(c[k] for c in rest)))
                size += len(text or b"") + 16
        if group:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(f"chunk long, {schema}")
    arrow = to_arrow_schema(spark_schema)
    name = f"chunks_{uuid.uuid4().hex}"
    # Spark takes 100,000 buckets at most; beyond as many chunks a bucket holds several rows, which are worked on one by one.
    buckets = max(8, min(100_000, math.ceil(n_bytes / chunk_bytes)))
    made = docs.select(*columns).mapInArrow(run, spark_schema)
    made.write.option("path", new_path(spark, "chunks")).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    # The frame knows the files and their buckets; the catalog keeps no entry (the files are not its own and stay).
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return chunks


@dataclass(frozen=True)
class Ranges:
    """``first``: ranges that chunks cut their names into; ``second``: ranges that groups of chunks cut each of these into."""

    first: int
    second: int = 1
    groups: int = 1


def ranges_for(n_bytes: int) -> Ranges:
    ranges = max(8, math.ceil(n_bytes / RANGE_BYTES))
    if ranges <= ONE_LEVEL:
        return Ranges(ranges)
    first = math.ceil(math.sqrt(ranges))
    return Ranges(first, math.ceil(ranges / first), math.ceil(math.sqrt(n_bytes / CHUNK_BYTES)))


def blobs(chunk: int, level: int, names: np.ndarray, values: list[np.ndarray], ranges: Ranges) -> list[tuple]:
    """Rows (range, chunk, level, names, values...) of a chunk's sorted distinct names."""
    return _cut(chunk, level, names, values, 0, ranges.first, ranges.first)


def _cut(chunk: int, level: int, names: np.ndarray, values: list[np.ndarray], begin: int, end: int, ranges: int) -> list[tuple]:
    """Rows of the ranges from ``begin`` to ``end`` of so many in all."""
    edges = np.array([(k << 64) // ranges for k in range(begin + 1, end)], dtype=np.uint64)
    cuts = np.r_[0, np.searchsorted(names, edges), len(names)].astype(np.int64)
    return [(begin + k, chunk, level, pack_names(names[a:b]), *(pack_ints(v[a:b]) for v in values)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def send(chunks: DataFrame, emit: Callable[[dict], list[tuple]], n_values: int) -> DataFrame:
    """What ``emit`` makes of each row of the chunk table: rows of blobs()."""
    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("level", pa.int32()), ("names", pa.binary()), *((f"v{k}", pa.binary()) for k in range(n_values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = emit(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(len(schema))], schema=schema)

    return chunks.mapInArrow(run, f"part long, chunk long, level int, names binary{''.join(f', v{k} binary' for k in range(n_values))}")


#: Folds the values of equal names that chunks have sent, one for each value: the ufuncs of a level.
Folds = Callable[[int], list[np.ufunc]]


def _merged(rows: pd.DataFrame, folds: list[np.ufunc]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct names of blobs, their folded values, each entry's place among them, the blobs' ends, and the values as sent."""
    names = [unpack_names(x) for x in rows.names]
    values = [np.concatenate([unpack_ints(x) for x in rows[f"v{k}"]]) for k in range(len(folds))]
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.r_[True, every[1:] != every[:-1]]
    starts = np.flatnonzero(new)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return every[new], [f.reduceat(v[order], starts) for f, v in zip(folds, values, strict=True)], back, np.cumsum([len(x) for x in names]), values


def combined(sent: DataFrame, folds: Folds, finish: Callable[[int, list[np.ndarray]], np.ndarray], n_values: int, label: str, ranges: Ranges, summary: Callable[[int, np.ndarray], int] | None = None, others: bool = False) -> DataFrame:
    """(chunk, part, level, result): the results for the names of each blob, in its order; stored.

    ``folds`` combine the values of a name, ``finish(level, values)`` makes one whole number per name of them.
    ``summary`` makes one number of a range's results; it is returned in a row of chunk -1.
    ``others``: a chunk gets a result less its own first value, which it knows; for most rare names that is 0.
    """
    columns, schema = ["chunk", "part", "level", "result"], "chunk long, part long, level int, result binary"

    def reduced(minus_own: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            out = []
            for level, rows in group.groupby("level"):
                _, merged, back, ends, values = _merged(rows, folds(int(level)))
                result = finish(int(level), merged)
                for chunk, part, a, b in zip(rows.chunk, rows.part, np.r_[0, ends[:-1]], ends, strict=True):
                    out.append((chunk, part, level, pack_ints(result[back[a:b]] - values[0][a:b] if minus_own else result[back[a:b]])))
                if summary is not None:
                    out.append((-1, rows.part.iloc[0], level, pack_ints(np.array([summary(int(level), result)]))))
            return pd.DataFrame(out, columns=columns)

        return run

    sent = sent.where("part >= 0")
    if ranges.second == 1:
        return stored(sent.repartition(ranges.first, "part").groupBy("part").applyInPandas(reduced(others), schema), label)

    def gathered(group: pd.DataFrame) -> pd.DataFrame:
        out, part, of = [], int(group.part.iloc[0]), int(group.of.iloc[0])
        for level, rows in group.groupby("level"):
            names, merged, *_ = _merged(rows, folds(int(level)))
            out += _cut(of, int(level), names, merged, part * ranges.second, (part + 1) * ranges.second, ranges.first * ranges.second)
        return pd.DataFrame(out, columns=["part", "chunk", "level", "names", *(f"v{k}" for k in range(n_values))])

    def dealt(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for level, rows in group.groupby("level"):
            _, _, back, ends, values = _merged(rows, folds(int(level)))
            result = np.concatenate([unpack_ints(x) for x in found[found.level == level].sort_values("part").result])
            for chunk, part, a, b in zip(rows.chunk, rows.part, np.r_[0, ends[:-1]], ends, strict=True):
                out.append((chunk, part, level, pack_ints(result[back[a:b]] - values[0][a:b] if others else result[back[a:b]])))
        return pd.DataFrame(out, columns=columns)

    # What chunks have sent is read twice: on the way to the ranges, and on the way back.
    sent = stored(sent.withColumn("of", F.pmod(F.xxhash64("chunk"), F.lit(ranges.groups))), f"{label}-sent")
    merged = sent.groupBy("part", "of").applyInPandas(gathered, f"part long, chunk long, level int, names binary{''.join(f', v{k} binary' for k in range(n_values))}")
    found = stored(merged.repartition(ranges.first * ranges.second, "part").groupBy("part").applyInPandas(reduced(False), schema), f"{label}-ranges")
    wide = found.where("chunk >= 0").select(F.expr(f"part div {ranges.second}").alias("wide"), F.col("chunk").alias("group"), "part", "level", "result")
    back = sent.groupBy("part", "of").cogroup(wide.groupBy("wide", "group")).applyInPandas(dealt, schema)
    return stored(back.unionByName(found.where("chunk < 0")), label)


def total_of(results: DataFrame, level: int) -> int:
    """The sum of the ranges' summaries of a level."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(unpack_ints(x.as_py())[0]) for x in batch.column(0))], pa.int64())], ["n"])

    return int(results.where(F.col("level") == level).where("chunk = -1").select("result").mapInArrow(add, "n long").agg(F.sum("n")).first()[0] or 0)


def with_results(chunks: DataFrame, *results: DataFrame) -> DataFrame:
    """The chunk table and, for each of ``results``, a column r0, r1, ... of its rows for the chunk."""
    for k, result in enumerate(results):
        rows = result.where("chunk >= 0").groupBy(F.col("chunk").alias(f"__c{k}")).agg(F.collect_list(F.struct("level", "part", "result")).alias(f"r{k}"))
        chunks = chunks.join(rows, F.col("chunk") == F.col(f"__c{k}"), "left").drop(f"__c{k}")
    return chunks


def results_of(rows: list[dict] | None, level: int) -> np.ndarray:
    """The results of a chunk for its sorted names of one level."""
    mine = sorted((r["part"], r["result"]) for r in rows or [] if r["level"] == level)
    return np.concatenate([unpack_ints(x) for _, x in mine]) if mine else np.zeros(0, dtype=np.int64)


def map_rows(chunks: DataFrame, make: Callable[[dict], dict[str, list]], schema: str) -> DataFrame:
    """``make`` turns a row of the chunk table into columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                made = make(batch.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return chunks.mapInArrow(run, spark_schema)

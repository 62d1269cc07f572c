"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

The windows of the benchmark (``n`` consecutive words of an item; a shorter item is one window) are
numbered by a vocabulary of the benchmark's words, hashed, sorted and broadcast. Each text is
turned into vocabulary numbers once; only places where a whole window of known words stands are
hashed and looked up, and a hit is verified number by number, so that no hash can invent one.

What is broadcast is bounded: the benchmark's words are counted first, and beyond ``max_bytes`` of
index it is cut into slices by a hash of the item. Each slice is its own broadcast and its own pass over
the documents, whose spans are written out and merged into those of the next pass, so that a task holds
one slice at a time and the driver drops each one when its pass is done.

Defined cases: a null or empty text has no words; a null or wordless item has no window; items that
share a window are all reported; equal items are all reported, items without an id under ``null``;
null keys, repeated rows and other columns pass through; an empty table or benchmark gives no hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import stored

#: Bytes to word bytes or spaces: ASCII letters (made small) and digits, and all of UTF-8 beyond ASCII.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
OVERLAP = "n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


#: Bytes of the index per word of the benchmark, beside the window's numbers: hash, item numbers, vocabulary.
WORD_BYTES = 96


@dataclass
class Index:
    """``by_length``: for each length of a window the sorted hashes, the words' numbers, and the items that hold each.

    The items of window k are ``items[ends[k-1]:ends[k]]``, numbers of ``names``.
    """

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    names: list[str]
    multiplier: int


def _hash(columns: list[np.ndarray], multiplier: int) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(multiplier)
        out ^= out >> np.uint64(29)
    return out


def build_index(items: list[tuple[str, bytes]], n: int) -> Index:
    """Windows are made, sorted and told apart as arrays; equal ones are one with several items."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, (_, text) in enumerate(items):
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int32)
        size = min(n, len(numbers))
        if size:
            found.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(numbers, size), k))
    multiplier = 0x9E3779B97F4A7C15
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    while len(by_length) < len(found):
        by_length = {}
        for size, views in found.items():
            windows = np.concatenate([w for w, _ in views])
            item = np.repeat(np.array([k for _, k in views], dtype=np.int32), [len(w) for w, _ in views])
            hashes = _hash([windows[:, c] for c in range(size)], multiplier)
            order = np.lexsort((item, hashes))
            hashes, windows, item = hashes[order], windows[order], item[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]]
            if ((windows[1:] != windows[:-1]).any(axis=1) & ~new[1:]).any():
                multiplier += 2  # two windows met in one hash; no window may hide another
                break
            held = np.r_[True, (item[1:] != item[:-1]) | new[1:]]  # an item may hold a window twice
            ends = np.searchsorted(np.flatnonzero(held), np.r_[np.flatnonzero(new)[1:], len(item)])
            by_length[size] = hashes[new], windows[new], item[held], ends
    return Index(vocabulary, by_length, [name for name, _ in items], multiplier)


def find(text: bytes | None, index: Index) -> tuple[int, list[int], list[int], list[str]]:
    """Words of the text, its maximal hit runs [start, end) in words, and the items hit."""
    words = words_of(text or b"")
    get = index.vocabulary.get
    numbers = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
    known = np.r_[0, np.cumsum(numbers >= 0)]
    marks, names = None, set()
    for size, (sorted_hashes, held, items, ends) in index.by_length.items():
        if len(words) < size or known[-1] < size:
            continue
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(at):
            continue
        columns = [numbers[at + k] for k in range(size)]
        hashes = _hash(columns, index.multiplier)
        place = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
        hit = sorted_hashes[place] == hashes
        for k in range(size):
            hit &= held[place, k] == columns[k]
        if hit.any():
            marks = np.zeros(len(words) + 1, dtype=np.int64) if marks is None else marks
            np.add.at(marks, at[hit], 1)
            np.add.at(marks, at[hit] + size, -1)
            for p in np.unique(place[hit]).tolist():
                names.update(index.names[k] for k in items[ends[p - 1] if p else 0 : ends[p]].tolist())
    if marks is None:
        return len(words), [], [], []
    edges = np.diff(np.r_[0, (np.cumsum(marks)[:-1] > 0).astype(np.int8), 0])
    return len(words), np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), sorted(names)


def _merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [a for a, _ in out], [b for _, b in out]


def with_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", max_bytes: int = 128 << 20) -> DataFrame:
    """``docs`` and the column __overlap (n_words, starts, ends, items), with no shuffle.

    ``max_bytes`` bounds the index of a pass, by its size in memory.
    """
    spark = docs.sparkSession
    kept = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("body")).where("body IS NOT NULL")
    words = F.regexp_count("body", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = kept.agg(F.sum(words * (4 * n + WORD_BYTES) + F.octet_length("body") + F.octet_length("name"))).first()[0] or 0
    slices = max(1, math.ceil(total / max_bytes))
    out = docs.withColumn("__overlap", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in OVERLAP.split(', '))}>").alias("__overlap"))
    for k in range(slices):
        part = kept if slices == 1 else kept.where(F.pmod(F.xxhash64("name", "body"), F.lit(slices)) == k)
        index = spark.sparkContext.broadcast(vars(build_index([(r.name, r.body.encode()) for r in part.collect()], n)))
        out = out.mapInArrow(_matcher(index, docs.columns.index(text), k > 0), out.schema)
        if slices > 1:
            out = stored(out, "overlaps")
            index.unpersist()
    return out


def _matcher(index, column: int, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Index(**index.value)
        for batch in batches:
            found = []
            before = batch.column(batch.num_columns - 1).to_pylist() if again else None
            for k, value in enumerate(batch.column(column).cast(pa.binary())):
                n_words, starts, ends, items = find(value.as_py(), table)
                if again:
                    old = before[k]
                    starts, ends = _merged(old["starts"] + starts, old["ends"] + ends)
                    items = sorted({*old["items"], *items})
                found.append({"n_words": n_words, "starts": starts, "ends": ends, "items": items})
            kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], batch.schema.names)

    return run


def n_hit(overlap: str = "__overlap"):
    """Words inside the hit runs."""
    sizes = F.zip_with(F.col(f"{overlap}.ends"), F.col(f"{overlap}.starts"), lambda a, b: a - b)
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda total, x: total + x)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without a hit, as they were."""
    return with_overlaps(docs, benchmark, n).where(F.size("__overlap.starts") == 0).select(*docs.columns)

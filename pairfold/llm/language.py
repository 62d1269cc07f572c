"""Language identification by rank-order profiles.

Training counts the byte n-grams (1 to 3 bytes of lower-cased letters, words set off by spaces) of
all labelled texts per language, adds the counts up in Spark and keeps each language's most frequent
``profile`` n-grams in order. A document's own most frequent n-grams are ranked the same way and
compared to each profile: the distance is the sum of the differences of places, a missing n-gram
counts ``profile``. The least distance names the language.

A document's profile is its ``profile`` most frequent n-grams, whether a language knows them or not; of
equally frequent ones those that stand higher in some language's list come first, then the lower bytes.
Its text is read whole. The lists, a few thousand n-grams per language, are broadcast; the number of
languages is checked against ``max_languages``.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any training
text all are ``und``; equal distances go to the language that sorts first; null labels and null
texts teach nothing; repeated rows count as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
SPACE = 0x20


def letters(text: str) -> np.ndarray:
    """The UTF-8 bytes of the lower-cased words of a text, with a space around each."""
    body = NO_LETTERS.sub(" ", text.lower()).strip(" ")
    return np.frombuffer(f" {body} ".encode("utf-8", "replace"), dtype=np.uint8)


def grams(b: np.ndarray) -> list[np.ndarray]:
    """Keys of the n-grams of 1, 2 and 3 bytes; no key of one length is one of another."""
    one = b.astype(np.uint32)
    two = (one[:-1] << 8) | one[1:]
    return [one, two, (two[:-1] << 8) | one[2:]]


#: N-grams of a language that a task holds before it sends their counts.
HELD = 1 << 22


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their counts."""
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams per language; memory follows the n-grams that are there, not those that may be."""
    held: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}

    def rows(lang: str) -> pa.RecordBatch:
        found, n = _added(*held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by_lang.setdefault(lang, []).append(letters(text.as_py()))
        for lang, texts in by_lang.items():
            joined = np.concatenate(texts)
            if len(joined) <= 2:
                continue
            keys, counts = held.setdefault(lang, ([], []))
            for found, n in (np.unique(x, return_counts=True) for x in grams(joined)):
                keys.append(found)
                counts.append(n)
            if sum(map(len, keys)) > HELD:
                held[lang] = tuple([x] for x in _added(keys, counts))
                if len(held[lang][0][0]) > HELD // 2:
                    yield rows(lang)
    for lang in list(held):
        yield rows(lang)


def learn(labelled: DataFrame, known: int = 1500, lang: str = "lang", text: str = "text", max_languages: int = 1000) -> dict[str, list[int]]:
    """The ``known`` most frequent n-grams of each language, in order."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.where(~F.col("gram").isin(SPACE, SPACE << 8 | SPACE))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= known).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("list"))
    found = top.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages to broadcast that many profiles")
    return {r.lang: [x.gram for x in r.list] for r in sorted(found, key=lambda r: r.lang)}


class Profiles:
    """Places of the n-grams, held only where a language's profile has one: languages x profile entries."""

    def __init__(self, known: dict[str, list[int]], profile: int) -> None:
        self.langs, self.profile = list(known), profile
        every = np.unique(np.array([g for x in known.values() for g in x], dtype=np.int64))
        best = np.full(len(every), len(every), dtype=np.int64)
        of_lang = [np.searchsorted(every, x) for x in known.values()]
        for at in of_lang:
            best[at] = np.minimum(best[at], np.arange(len(at)))
        # Number the n-grams by their best place; ties of a document's counts go to the lower number.
        order = np.argsort(best, kind="stable")
        self.size = len(every)
        self.number = np.zeros(1 << 24, dtype=np.uint32)
        self.number[every[order]] = np.arange(1, self.size + 1)
        # The entries of n-gram k, counted from 0 in that order, are those from start[k] to start[k + 1].
        rank = np.empty(self.size, dtype=np.int64)
        rank[order] = np.arange(self.size)
        grams_of = np.concatenate([rank[at[:profile]] for at in of_lang] or [order])
        by_gram = np.argsort(grams_of, kind="stable")
        self.start = np.searchsorted(grams_of[by_gram], np.arange(self.size + 1))
        self.lang = np.repeat(np.arange(len(of_lang)), [len(at[:profile]) for at in of_lang])[by_gram]
        self.place = np.concatenate([np.arange(len(at[:profile])) for at in of_lang] or [order])[by_gram]

    def of(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0
        each = [np.unique(keys, return_counts=True) for keys in grams(letters(text))]
        found, n = (np.concatenate(x) for x in zip(*each, strict=True))
        kept = (found != SPACE) & (found != (SPACE << 8 | SPACE))
        found, n = found[kept], n[kept]
        if len(found) > self.profile:  # those as frequent as the last one are ranked too
            kept = n >= np.partition(n, len(n) - self.profile)[len(n) - self.profile]
            found, n = found[kept], n[kept]
        number = self.number[found].astype(np.int64) - 1
        number[number < 0] = self.size
        top = number[np.lexsort((found, number, -n))[: self.profile]]
        ranks = np.flatnonzero(top < self.size)
        known = top[ranks]
        # A missing n-gram counts ``profile``; the entries of those that are there make up the difference.
        sizes = self.start[known + 1] - self.start[known]
        at = np.repeat(self.start[known] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        away = np.abs(self.place[at] - np.repeat(ranks, sizes)) - self.profile
        distance = np.full(len(self.langs), self.profile * len(top), dtype=np.int64)
        np.add.at(distance, self.lang[at], away)
        k = int(distance.argmin())
        return self.langs[k], float(1 - distance[k] / (self.profile * len(top)))


def identify(docs: DataFrame, known: dict[str, list[int]], profile: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row; the score is 1 at distance 0 and 0 at the greatest."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value, profile)
        for batch in batches:
            got = [profiles.of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)

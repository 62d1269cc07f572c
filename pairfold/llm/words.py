"""Chunks of tokenised documents: word names and token numbers, shared by the word-based operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame

from pairfold.llm.chunks import make_chunks


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def pack_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sorted names of the distinct words, the tokens as places in them, and each text's tokens.

    Words are runs of anything but ASCII white space, with ASCII letters made small.
    """
    number: dict[bytes, int] = {}
    tokens, sizes = [], []
    for text in texts:
        words = (text or b"").lower().split()
        sizes.append(len(words))
        for w in set(words).difference(number):
            number[w] = len(number)
        tokens.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
    names = word_names(list(number))
    order = np.argsort(names, kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return names[order], place[np.concatenate(tokens)] if tokens else np.zeros(0, dtype=np.uint32), sizes


def word_chunks(docs: DataFrame, key: Column, extra: list[tuple[Column, str, str]], text: Column, n_bytes: int) -> DataFrame:
    """(chunk, key[], <extra>[], n_words[], words, tokens): one row per chunk of documents."""
    schema_key = docs.select(key.alias("key")).schema["key"].dataType.simpleString()

    names_of_extra = [name for _, name, _ in extra]

    def pack(group: list[tuple]) -> dict:
        names, tokens, sizes = pack_words([g[0] for g in group])
        out = {"key": [g[1] for g in group], "n_words": sizes, "words": names.tobytes(), "tokens": tokens.tobytes()}
        return out | {name: [g[2 + k] for g in group] for k, name in enumerate(names_of_extra)}

    fields = "".join(f", {name} array<{kind}>" for _, name, kind in extra)
    return make_chunks(docs, [text.alias("text"), key.alias("key"), *(c.alias(n) for c, n, _ in extra)], f"key array<{schema_key}>{fields}, n_words array<int>, words binary, tokens binary", pack, n_bytes)


def words_and_tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["words"], dtype=np.uint64), np.frombuffer(row["tokens"], dtype=np.uint32)

"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch of texts are held as one ragged numpy array of symbols. In each round every
sequence finds its pair of lowest rank, and all sequences apply theirs at the same time; what
survives when no sequence has a pair is counted. Texts are cut into pre-tokens where no piece of
the vocabulary can cross, so that the cuts change nothing.

A sequence merges the occurrences of its lowest pair in one round, from the left, up to the first one
where a pair of lower rank arises, as the library merges one pair at a time; that pair is the lowest
of the next round. The counts therefore equal the library's. Known words are kept with their counts
in a table of bounded bytes; words too long for it, such as text without spaces, are merged anew.

Defined cases: a null or empty text has 0 tokens; characters outside the vocabulary count their
UTF-8 bytes (byte fallback); special strings inside texts are ordinary text. Rows are independent:
repeated rows give repeated results, an empty table none, and columns but key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: A worker's table of known counts is emptied beyond so many characters (and a fixed cost per word); longer words are not kept.
KNOWN_CHARS, WORD_COST, LONGEST_KNOWN = 32_000_000, 80, 256


@dataclass
class Merges:
    """Symbols are numbered by rank: the symbol that a pair makes is the pair's rank."""

    char_code: np.ndarray  # sorted code points that are pieces
    char_symbol: np.ndarray
    pair_key: np.ndarray  # sorted left * size + right
    pair_rank: np.ndarray
    bigram_key: np.ndarray  # sorted pairs of code points that occur inside pieces
    size: int


def read_pieces(path: str) -> Merges:
    """The merges of a sentencepiece BPE model with byte fallback; runs on the driver.

    An error for models whose counts this operator would not give: those that rewrite characters, drop
    or join spaces, do not set a space before a text, or have no pieces for bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  ﬁ Å\u3000x "
    plain = SPACE + probe.replace(" ", SPACE)
    if "".join(model.encode("a  b", out_type=str)) != f"{SPACE}a{SPACE}{SPACE}b" or model.normalize(probe) not in (plain, probe):
        raise ValueError("the model rewrites texts before it cuts them")
    if sum(model.is_byte(i) for i in range(model.get_piece_size())) != 256:
        raise ValueError("the model has no pieces for bytes")
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in sorted(normal, key=lambda i: (-model.get_score(i), i))]
    rank = {p: k for k, p in enumerate(pieces)}
    size = len(pieces) + 1
    pairs, bigrams = {}, set()
    for p, k in rank.items():
        for cut in range(1, len(p)):
            left, right = rank.get(p[:cut]), rank.get(p[cut:])
            if left is not None and right is not None:
                pairs[left * size + right] = k
        bigrams.update((ord(a) << 32) | ord(b) for a, b in zip(p, p[1:]))
    chars = sorted((ord(p), k) for p, k in rank.items() if len(p) == 1)
    keys = np.array(sorted(pairs), dtype=np.int64)
    return Merges(
        np.array([c for c, _ in chars], dtype=np.uint32),
        np.array([k for _, k in chars], dtype=np.int32),
        keys,
        np.array([pairs[k] for k in keys.tolist()], dtype=np.int32),
        np.array(sorted(bigrams), dtype=np.int64),
        size,
    )


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Merger:
    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        self.symbol[merges.char_code] = merges.char_symbol

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(left) or not len(self.m.pair_key):
            return np.full(len(left), NONE)
        at, ok = _found(self.m.pair_key, left.astype(np.int64) * self.m.size + right)
        return np.where(ok & (left >= 0) & (right >= 0), self.m.pair_rank[at], NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word."""
        out = np.zeros(len(words), dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        word = np.repeat(np.arange(len(words)), lengths)
        sym = self.symbol[codes]
        unknown = sym < 0
        np.add.at(out, word[unknown], (1 + (codes >= 0x80).astype(int) + (codes >= 0x800) + (codes >= 0x10000))[unknown])
        # Pieces cross a boundary only where they hold its two characters.
        cut = np.ones(len(codes), dtype=bool)
        if len(codes) > 1:
            _, inside = _found(self.m.bigram_key, (codes[:-1].astype(np.int64) << 32) | codes[1:])
            cut[1:] = ~inside | (word[1:] != word[:-1]) | unknown[1:] | unknown[:-1]
        segment = np.cumsum(cut) - 1
        of = word[cut]
        keep = ~unknown
        sym, segment = sym[keep], segment[keep]
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            same = np.flatnonzero(segment[1:] == segment[:-1])
            rank[same] = self.rank(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                np.add.at(out, of[segment[first[done]]], size[done])
                keep = np.repeat(~done, size)
                sym, segment, rank, least, size = sym[keep], segment[keep], rank[keep], least[~done], size[~done]
                if not len(sym):
                    break
            at = self._chosen(sym, segment, rank, np.repeat(least, size))
            sym[at] = rank[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, segment, rank = sym[keep], segment[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                rank[left] = NONE
                left = left[left + 1 < len(sym)]
                left = left[segment[left] == segment[left + 1]]
                rank[left] = self.rank(sym[left], sym[left + 1])
        return out

    def _chosen(self, sym: np.ndarray, segment: np.ndarray, rank: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places whose pairs are merged in this round."""
        at = np.flatnonzero(rank == least)
        if len(at) < 2:
            return at
        run = np.r_[True, np.diff(at) != 1]  # of overlapping pairs every other one is merged
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        again = np.r_[False, segment[at[1:]] == segment[at[:-1]]]
        if not again.any():
            return at
        several = np.isin(segment[at], segment[at[again]])
        made = rank[at]
        bad = np.zeros(len(at), dtype=bool)
        inner = np.flatnonzero(several & (at > 0))
        inner = inner[segment[at[inner] - 1] == segment[at[inner]]]
        before = at[inner] - 1
        joined = np.r_[False, np.diff(at) == 2][inner]
        bad[inner] |= self.rank(np.where(joined, made[inner], sym[before]), made[inner]) < made[inner]
        inner = np.flatnonzero(several & (at + 2 < len(sym)))
        inner = inner[segment[at[inner] + 2] == segment[at[inner]]]
        bad[inner] |= self.rank(made[inner], sym[at[inner] + 2]) < made[inner]
        if not bad.any():
            return at
        # The places behind a sequence's first bad one wait for the next round.
        seen = np.cumsum(bad) - bad
        begin = np.flatnonzero(~again)
        return at[seen == np.repeat(seen[begin], np.diff(np.r_[begin, len(at)]))]


#: A run of spaces with the word behind it, or a line break; no piece of a model that splits by white space goes on behind one.
PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Counter:
    """Counts texts; known words are kept in a bounded table."""

    def __init__(self, merges: Merges) -> None:
        self.merger, self.known, self.held = Merger(merges), {}, 0
        inner = {(k >> 32, k & 0xFFFFFFFF) for k in merges.bigram_key.tolist()}
        assert not any(b == ord(SPACE) != a or ord("\n") in (a, b) for a, b in inner), "pieces cross the pre-tokens"

    def texts(self, texts: list[str | None]) -> list[int]:
        split = [PRETOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if self.held > KNOWN_CHARS:
            self.known.clear()
            self.held = 0
        new = list(set().union(*split).difference(self.known))
        counts = dict(zip(new, self.merger.counts(new).tolist(), strict=True))
        kept = {w: n for w, n in counts.items() if len(w) <= LONGEST_KNOWN}
        self.known.update(kept)
        self.held += sum(map(len, kept)) + WORD_COST * len(kept)
        if len(kept) == len(counts):
            get = self.known.__getitem__
            return [sum(map(get, words)) for words in split]
        return [sum(counts[w] if w in counts else self.known[w] for w in words) for words in split]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text", batch_chars: int = 4_000_000) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; the merges (some MB) are broadcast."""
    spark = docs.sparkSession
    merges = spark.sparkContext.broadcast(vars(read_pieces(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Merges(**merges.value))
        for batch in batches:
            tokens, group, chars = [], [], 0
            for value in batch.column(1):
                t = value.as_py()
                group.append(t)
                chars += len(t or "")
                if chars >= batch_chars:
                    tokens += counter.texts(group)
                    group, chars = [], 0
            tokens += counter.texts(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()
    got = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return got.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

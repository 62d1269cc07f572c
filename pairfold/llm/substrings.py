"""Suffix-array dedup by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
key. Sorting every suffix of a large corpus is out of reach, so suffixes are sampled by content: of
every window of ``length`` bytes the q-gram with the least name is its anchor, and equal windows
have equal anchors at equal offsets. The anchored suffixes are then refined bucket by bucket:

1. Initial buckets are the anchors' q-grams. A bucket of one document is finished.
2. The others are refined by the bucket identifiers at later (and, for the part before the anchor,
   earlier) offsets: the names of the pieces that make up the whole stretch of windows with that
   anchor. A suffix whose refined bucket starts in a smaller document is finished: the stretch goes.
3. The first holder of each other stretch is refined once more, window by window, on the sides of
   the anchor where others share it half-way out but not to the stretch's end.

Bucket identifiers are built by doubling: the identifier of 2k bytes is a function of those of k
bytes here and k bytes later, so that each level reuses the identifiers of the one before. They are
64-bit names, so that buckets need not be numbered by a global sort: equal strings have equal names
everywhere, and unequal ones share a name with a chance of 2^-64 a pair. Buckets meet in the exchange
of pairfold.llm.chunks with one entry per chunk, however frequent a string is; no pairs are formed.

Defined cases: a null or empty text has no bytes; keys must be whole numbers, a null key is larger
than all others; documents with equal keys do not remove each other's bytes, and repeats inside one
document stay; strings are judged on the input; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.chunks import blobs, combined, make_chunks, map_rows, mix, pack_ints, ranges_for, results_of, send, with_results
from pairfold.llm.common import stored, text_bytes

LENGTH, GRAM = 50, 20
LAST = np.int64(2**63 - 1)  # stands for a null key
#: Bytes that are named at a time; keeps the arrays in the processor's cache.
BLOCK = 1 << 16


def identifiers(b: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of the strings of ``sizes`` bytes that start at each place, built by doubling."""
    table = mix(np.arange(1, 257, dtype=np.uint64), np.full(256, 7, dtype=np.uint64))
    power, out = {1: table[b]}, {}
    top = max(sizes)
    k = 1
    while 2 * k <= top:
        power[2 * k] = mix(power[k][:-k], power[k][k:]) if len(power[k]) > k else np.zeros(0, dtype=np.uint64)
        k *= 2
    for size in sizes:
        k = 1 << (size.bit_length() - 1)
        if size == k:
            out[size] = power[k]
        else:  # two overlapping pieces make up the rest
            n = len(b) - size + 1
            out[size] = mix(power[k][:n], power[k][size - k : size - k + n]) if n > 0 else np.zeros(0, dtype=np.uint64)
    return out


def _window_least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    k = 1
    while 2 * k <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (width - k)], v[width - k :]) if width > k else v


class Stretches:
    """The anchors of a chunk and, for each, the run of windows that it stands for."""

    def __init__(self, row: dict, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length = length
        b = np.frombuffer(row["body"], dtype=np.uint8)
        self.sizes = np.array(row["n_bytes"], dtype=np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.key = np.array([LAST if k is None else k for k in row["key"]], dtype=np.int64)
        self.half = (length - gram) // 2
        grams, ahead, behind, anchors, firsts, lasts, stretch, texts = [], [], [], [], [], [], [], []
        end_of = self.start + self.sizes
        for lo, hi, text in self._blocks(len(b), end_of):
            piece = b[lo:hi]
            names = identifiers(piece, (gram, 32))
            short, long = names[gram], names[32]
            # The least name of each window with its place; the first one of equals.
            ranked = (short >> np.uint64(20) << np.uint64(20)) | np.arange(len(short), dtype=np.uint64)
            anchor = (_window_least(ranked, length - gram + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
            if text is None:  # several texts: no window crosses their ends
                n = len(anchor)
                inside = np.zeros(len(piece) + 1, dtype=np.int32)
                first, last = np.searchsorted(end_of, lo, "right"), np.searchsorted(end_of, hi, "left")
                docs = np.arange(first, last + 1)
                docs = docs[(self.sizes[docs] >= length)]
                np.add.at(inside, self.start[docs] - lo, 1)
                np.add.at(inside, end_of[docs] - lo - length + 1, -1)
                windows = np.flatnonzero(np.cumsum(inside[:n]) > 0)
            else:
                windows = np.arange(len(anchor))
            if not len(windows):
                continue
            at = anchor[windows]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(windows) != 1)])
            begin = windows[new]
            final = windows[np.r_[new[1:] - 1, len(windows) - 1]]
            # Windows of different texts may stand side by side, but never share an anchor.
            at = at[new]
            anchors.append(at + lo)
            # Anchors are least names; named anew they spread evenly over the ranges of the exchange.
            grams.append(mix(short[at], np.full(len(at), 3, dtype=np.uint64)))
            for names_of_side, from_ in ((ahead, at), (behind, at - self.half)):
                from_ = np.clip(from_, 0, len(long) - 1)
                names_of_side.append(mix(long[from_], long[np.clip(from_ + self.half + gram - 32, 0, len(long) - 1)]))
            firsts.append(begin + lo)
            lasts.append(final + lo)
            size = final - begin + length
            tail = final + length - 32
            name = mix(mix(long[begin], long[begin + (size - 32) // 2]), long[tail])
            stretch.append(mix(name, (size * 128 + at - begin).astype(np.uint64)))
            texts.append(np.searchsorted(end_of, begin + lo, "right"))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        self.gram, self.stretch = join(grams, np.uint64), join(stretch, np.uint64)
        self.ahead, self.behind, self.anchor = join(ahead, np.uint64), join(behind, np.uint64), join(anchors, np.int64)
        self.first, self.last, self.text = join(firsts, np.int64), join(lasts, np.int64), join(texts, np.int64)
        self.bytes = b
        self.owner = self.key[self.text] if len(self.text) else np.zeros(0, dtype=np.int64)

    def _blocks(self, n: int, end_of: np.ndarray):
        """(from, to, text): runs of whole texts (text None), or overlapping parts of a long one."""
        at, k = 0, 0
        while k < len(self.sizes):
            if self.sizes[k] > BLOCK:
                lo, end = int(self.start[k]), int(end_of[k])
                # A part begins at the first window that the part before did not hold whole.
                while lo + self.length <= end:
                    hi = min(lo + BLOCK, end)
                    yield lo, hi, k
                    lo = hi - self.length + 1
                k += 1
            else:
                j = int(np.searchsorted(end_of, self.start[k] + BLOCK, "right"))
                j = max(j, k + 1)
                while j > k + 1 and self.sizes[k:j].max() > BLOCK:
                    j -= 1
                if end_of[j - 1] - self.start[k] >= self.length:
                    yield int(self.start[k]), int(end_of[j - 1]), None
                k = j


def _sorted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts names, and where each distinct one begins in it."""
    order = np.argsort(names)
    n = names[order]
    return order, np.flatnonzero(np.r_[True, n[1:] != n[:-1]][: len(n)])


def _distinct(names: np.ndarray) -> np.ndarray:
    """np.unique() by a sort, which is faster than its table of hashes for as many names."""
    n = np.sort(names)
    return n[np.r_[True, n[1:] != n[:-1]][: len(n)]]


def _places(names: np.ndarray) -> np.ndarray:
    """Each name's place among the distinct ones."""
    order, new = _sorted(names)
    out = np.empty(len(names), dtype=np.int64)
    out[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(names)))
    return out


def _several(names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names and the least and greatest value of each."""
    if not len(names):
        return names, values, values
    order, new = _sorted(names)
    v = values[order]
    return names[order[new]], np.minimum.reduceat(v, new), np.maximum.reduceat(v, new)


def _level_two(row: dict, s: Stretches) -> np.ndarray:
    """Stretches whose bucket holds several documents."""
    distinct = _distinct(s.gram)
    shared = results_of(row["r0"], 1)
    return np.flatnonzero(shared[np.searchsorted(distinct, s.gram)] > 0) if len(distinct) else np.zeros(0, dtype=np.int64)


def _tag(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(16)).astype(np.int64)


def _sides(s: Stretches, at: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(level, stretches, names): what stretches with windows on either side of their anchors hold there.

    A window holds at least half of its bytes beside the anchor before or behind it.
    """
    middle = s.anchor[at] - s.half
    behind, ahead = at[s.first[at] <= middle], at[s.last[at] >= middle]
    return [(2, behind, s.behind[behind]), (3, ahead, s.ahead[ahead])]


def _level_three(row: dict, s: Stretches, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the stretches ``at``: the ones that go, and the first and last windows of those to refine further."""
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return at, none, none
    least = results_of(row["r1"], 1)[_places(s.stretch[at])]
    gone, open_ = at[least < s.owner[at]], np.zeros(len(s.gram), dtype=bool)
    open_[at[least == s.owner[at]]] = True
    lo, hi = s.last.copy(), s.first - 1  # nothing yet
    for level, mine, names in _sides(s, at):
        distinct = _distinct(names)
        mixed = results_of(row["r1"], level)[np.searchsorted(distinct, names)] > 0 if len(names) else np.zeros(0, dtype=bool)
        mine = mine[mixed & open_[mine]]
        middle = s.anchor[mine] - s.half
        if level == 2:
            lo[mine], hi[mine] = s.first[mine], np.minimum(s.last[mine], middle)
        else:
            fresh = hi[mine] < s.first[mine]
            lo[mine] = np.where(fresh, np.maximum(s.first[mine], middle), lo[mine])
            hi[mine] = s.last[mine]
    rest = np.flatnonzero(hi >= s.first)
    return gone, lo[rest], hi[rest]


def _windows(b: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the windows from ``first`` to ``last``."""
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    size = last - first + 1
    places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    names = np.empty(len(places), dtype=np.uint64)
    # Runs of windows that overlap are named together, and the bytes of many runs are put side by side for it: runs are short.
    ends = np.cumsum(size)
    new = np.flatnonzero(np.r_[True, first[1:] > last[:-1] + length])
    until = np.r_[new[1:], len(first)]
    lo, width = first[new], last[until - 1] + length - first[new]
    i, j = ends[new] - size[new], ends[until - 1]
    begin = np.cumsum(width) - width
    part = begin // BLOCK
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(new)], strict=True):
        shift = lo[a:z] - (begin[a:z] - begin[a])
        at = np.repeat(shift, width[a:z])
        at += np.arange(len(at))
        found = identifiers(b[at], (32,))[32]
        p = places[i[a] : j[z - 1]] - np.repeat(shift, j[a:z] - i[a:z])
        names[i[a] : j[z - 1]] = mix(found[p], found[p + length - 32])
    return places, names


def _owners(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a chunk's texts and their keys."""
    sizes = np.array(row["n_bytes"], dtype=np.int64)
    ends = np.cumsum(sizes)
    return ends - sizes, ends, np.array([LAST if k is None else k for k in row["key"]], dtype=np.int64)


def without_spans(body: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left of a text."""
    edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist(), strict=True) for x in pair), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeats(docs: DataFrame, finish: Callable[[bytes | None, np.ndarray, np.ndarray], tuple], schema: str, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", others: list[str] = ()) -> DataFrame:
    """(key, <schema>, o0, o1, ...) of every row of ``docs``.

    ``finish`` makes the values of ``schema`` from the text's bytes (None for a null text) and the
    starts and ends of the runs that go. o0, o1, ... are the columns ``others`` of ``docs``.
    """
    if not 32 <= length <= 64 or not gram < 32 or 2 * length - gram > 95:
        raise ValueError("two names of 32 bytes must make up a window, and three of them a stretch")
    n_bytes = text_bytes(docs, text)
    ranges = ranges_for(n_bytes)

    names = [f"o{k}" for k in range(len(others))]
    kinds = [docs.schema[c].dataType.simpleString() for c in others]

    def pack(group: list[tuple]) -> dict:
        out = {"key": [g[1] for g in group], "n_bytes": [len(g[0] or b"") for g in group], "body": b"".join(g[0] or b"" for g in group)}
        return out | {"missing": [g[0] is None for g in group]} | {name: [g[2 + k] for g in group] for k, name in enumerate(names)}

    carried = "".join(f", {n} array<{k}>" for n, k in zip(names, kinds, strict=True))
    columns = [F.col(text).alias("text"), F.col(key).cast("long").alias("key"), *(F.col(c).alias(n) for c, n in zip(others, names, strict=True))]
    table = make_chunks(docs, columns, f"key array<long>, n_bytes array<int>, missing array<boolean>, body binary{carried}", pack, n_bytes)
    bare = table.select("chunk", "key", "n_bytes", "body")

    def initial(row: dict) -> list[tuple]:
        s = Stretches(row, length, gram)
        distinct, least, greatest = _several(s.gram, s.owner)
        return blobs(row["chunk"], 1, distinct, [1 + (greatest > least)], ranges)

    def refined(row: dict) -> list[tuple]:
        s = Stretches(row, length, gram)
        at = _level_two(row, s)
        stretch, least, _ = _several(s.stretch[at], s.owner[at])
        out = blobs(row["chunk"], 1, stretch, [least, np.zeros(len(stretch), dtype=np.int64)], ranges)
        for level, mine, names in _sides(s, at):
            distinct, low, high = _several(names, _tag(s.stretch[mine]))
            out += blobs(row["chunk"], level, distinct, [low, high], ranges)
        return out

    def last(row: dict) -> list[tuple]:
        s = Stretches(row, length, gram)
        gone, lo, hi = _level_three(row, s, _level_two(row, s))
        _, ends, keys = _owners(row)
        places, names = _windows(s.bytes, lo, hi, length)
        distinct, least, _ = _several(names, keys[np.searchsorted(ends, places, "right")])
        # What this pass has found stays with the chunk, in rows of no range.
        kept = {-1: s.first[gone], -2: s.last[gone], -3: lo, -4: hi}
        return blobs(row["chunk"], 1, distinct, [least], ranges) + [(-1, row["chunk"], level, b"", pack_ints(np.diff(x, prepend=0))) for level, x in kept.items()]

    first = combined(send(bare, initial, 1), lambda level: [np.add], lambda level, v: (v[0] > 1).astype(np.int64), 1, "substrings-1", ranges)
    second = combined(
        send(with_results(bare, first), refined, 2),
        lambda level: [np.minimum, np.add if level == 1 else np.maximum],
        lambda level, v: v[0] if level == 1 else (v[0] < v[1]).astype(np.int64),
        2,
        "substrings-2",
        ranges,
    )
    sent = stored(send(with_results(bare, first, second), last, 1), "substrings-sent")
    kept = sent.where("part < 0").select("chunk", "part", "level", F.col("v0").alias("result"))
    third = combined(sent, lambda level: [np.minimum], lambda level, v: v[0], 1, "substrings-3", ranges)

    def spans(row: dict) -> dict[str, list]:
        b = np.frombuffer(row["body"], dtype=np.uint8)
        begin, finish_, keys = _owners(row)
        gone_first, gone_last, lo, hi = (np.cumsum(results_of(row["r1"], level)) for level in (-1, -2, -3, -4))
        places, names_found = _windows(b, lo, hi, length)
        owner = keys[np.searchsorted(finish_, places, "right")] if len(places) else places
        places = places[results_of(row["r0"], 1)[_places(names_found)] < owner] if len(places) else places
        marks = np.zeros(len(b) + 1, dtype=np.int64)
        for starts_, ends_ in ((gone_first, gone_last + length), (places, places + length)):
            np.add.at(marks, starts_, 1)
            np.add.at(marks, ends_, -1)
        covered = (np.cumsum(marks)[:-1] > 0).astype(np.int8)
        edge = np.diff(np.r_[0, covered, 0])
        starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        # Runs of neighbouring texts may touch.
        inner = np.setdiff1d(begin[finish_ > begin], starts)
        inner = inner[covered[inner] > 0] if len(inner) else inner
        starts, ends = np.sort(np.r_[starts, inner]), np.sort(np.r_[ends, inner])
        of = np.searchsorted(finish_, starts, "right")
        cut = np.searchsorted(of, np.arange(len(keys) + 1))
        body = row["body"]
        made = [
            finish(None if missing else body[a:z], starts[cut[k] : cut[k + 1]] - a, ends[cut[k] : cut[k + 1]] - a)
            for k, (missing, a, z) in enumerate(zip(row["missing"], begin.tolist(), finish_.tolist(), strict=True))
        ]
        return {"key": row["key"], **{f: [m[k] for m in made] for k, f in enumerate(fields)}} | {n: row[n] for n in names}

    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    more = "".join(f", {n} {k}" for n, k in zip(names, kinds, strict=True))
    return map_rows(with_results(table, third, kept), spans, f"key long, {schema}{more}")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with what repeats cut out of the texts; characters that a cut splits go as a whole.

    Every row stays, if with an empty text; null texts stay null. The column n_chars, where there is
    one, follows the text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def finish(body: bytes | None, starts: np.ndarray, ends: np.ndarray) -> tuple:
        return (None if body is None else without_spans(body, starts, ends).decode("utf-8", "ignore") if len(starts) else body.decode("utf-8"),)

    got = repeats(docs, finish, "text string", length, others=others)
    back = {"doc_id": F.col("key").cast(docs.schema["doc_id"].dataType), "text": F.col("text")} | {c: F.col(f"o{k}") for k, c in enumerate(others)}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return got.select(*(back[c].alias(c) for c in docs.columns))

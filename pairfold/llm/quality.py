"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on a bounded sample of labelled rows: of the ``sample`` labels of least
hash the ``sample`` rows of least hash, where equal rows are one with their count as weight; histograms of gradients over at most 64 bins per statistic choose the splits. The statistics
of every whole text are computed and scored in one pass over the documents. A fitted model is flat arrays of
complete trees, which are broadcast (some kB) and traversed for whole batches at once.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; null labels
teach nothing; a document with several labels brings each; if the labels have one class only, or
there are none, every score is the share of class 1 (0.5 for none); repeated rows repeat their
results; null keys carry no label; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "repeats", "distinct_pairs",
    "upper", "digits", "marks", "spaces", "beyond_ascii", "controls", "bangs", "pipes", "brackets", "hashes", "stops", "commas",
    "log_lines", "distinct_lines", "mean_line", "bare_words", "one_letter", "capital_words", "entropy",
]
_CLASSES = {
    "upper": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "spaces": [0x20, *range(9, 14)], "beyond_ascii": range(0x80, 0x100), "controls": [*range(9), *range(14, 32), 127],
    "bangs": b"!?", "pipes": b"|", "brackets": b"{}[]<>()", "hashes": b"#@$%&*=_~^\\/+", "stops": b".", "commas": b",;:",
    "marks": [c for c in range(0x21, 0x7F) if not chr(c).isalnum()],
}
_ROWS = np.array([[c in set(v) for c in range(256)] for v in _CLASSES.values()], dtype=np.float64)


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = dict(zip(_CLASSES, (_ROWS @ count / len(text)).tolist(), strict=True))
    words, lines = text.split(), text.split(b"\n")
    n = len(words) or 1
    each = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    p = count[count > 0] / len(text)
    share |= {
        "log_bytes": np.log1p(len(text)), "log_words": np.log1p(len(words)), "mean_word": sizes.sum() / n, "long_words": (sizes > 20).sum() / n,
        "distinct_words": len(each) / n, "top_word": max(each.values(), default=0) / n, "repeats": sum(map(bytes.__eq__, words, words[1:])) / n,
        "distinct_pairs": len(set(zip(words, words[1:]))) / n, "log_lines": np.log1p(len(lines)), "distinct_lines": len(set(lines)) / len(lines), "mean_line": np.log1p(len(text) / len(lines)),
        "bare_words": sum(k for w, k in each.items() if not any(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in w)) / n,
        "one_letter": (sizes == 1).sum() / n, "capital_words": sum(k for w, k in each.items() if len(w) > 1 and w.isupper()) / n, "entropy": -(p * np.log2(p)).sum(),
    }
    return [float(share[k]) for k in STATISTICS]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of every row, as an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["key", "x"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, x array<double>")


@dataclass
class Trees:
    """Complete trees: node k has the children 2k+1 and 2k+2; the last level holds the leaves."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # the left child has values up to it
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            margin += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _quantiles(c: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """np.quantile of the values, each repeated as often as its weight says."""
    order = np.argsort(c, kind="stable")
    c, upto = c[order], np.cumsum(weight[order])
    place = at * (upto[-1] - 1)
    low, high = (c[np.searchsorted(upto, k, side="right")] for k in (np.floor(place), np.ceil(place)))
    part = place - np.floor(place)
    return np.where(part < 0.5, low + (high - low) * part, high - (high - low) * (1 - part))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: int = 20, weight: np.ndarray | None = None) -> Trees:
    """Boosted trees for the log loss; ties between splits go to the first statistic and bin.

    A row of weight w counts like w equal rows.
    """
    w = np.ones(len(y)) if weight is None else weight.astype(np.float64)
    inner = 2**depth - 1
    share = (w @ y) / w.sum() if len(y) else 0.5
    empty = Trees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(y) == 0 or share in (0, 1):
        return empty
    edges = [np.unique(_quantiles(c, w, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, trees = np.full(len(y), empty.base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf, -1)
            n = w[rows].sum()
            if n >= 2 * least:
                gr, hr = g[rows], h[rows]
                whole = gr.sum() ** 2 / (hr.sum() + smooth)
                for f, e in enumerate(edges):
                    if len(e):
                        b = binned[rows, f]
                        gl, hl, nl = (np.cumsum(np.bincount(b, v, minlength=len(e) + 1))[:-1] for v in (gr, hr, w[rows]))
                        gain = gl**2 / (hl + smooth) + (gr.sum() - gl) ** 2 / (hr.sum() - hl + smooth) - whole
                        gain[(nl < least) | (n - nl < least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, e[k], k)
            _, feature[node], threshold[node], k = best
            right = binned[rows, feature[node]] > k if k >= 0 else np.zeros(len(rows), dtype=bool)
            at[rows] = 2 * node + 1 + right
        leaf = -np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + smooth) * rate
        margin += leaf[at - inner]
        trees.append((feature, threshold, leaf))
    return Trees(*(np.stack(t) for t in zip(*trees, strict=True)), empty.base)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fit to ``sample`` labelled rows at most, taken from the labels whose key has the least hash.

    The sample of labels is broadcast, bounded by its number of rows. The rows of a key that agree in
    label and text are one row with their count as weight; if there are more than ``sample`` such
    rows, those of least hash of key and text are taken. They are found by hashes first, so that
    only their texts are moved and measured.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__of"), F.col(label).alias("__label"))
    marked = marked.orderBy(F.xxhash64("__of"), "__of", "__label").limit(sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = rows.join(F.broadcast(marked), F.col("__key") == F.col("__of")).select("__key", "__label", F.xxhash64("__text").alias("__hash"))
    chosen = found.groupBy("__key", "__label", "__hash").agg(F.count("*").alias("__n"))
    chosen = chosen.orderBy(F.xxhash64("__key", "__hash"), "__key", "__label", "__hash").limit(sample).withColumnRenamed("__key", "__of")
    whole = rows.join(F.broadcast(chosen), (F.col("__key") == F.col("__of")) & (F.xxhash64("__text") == F.col("__hash")))
    whole = whole.groupBy("__key", "__label", "__hash", "__n").agg(F.min("__text").alias("__text"))
    rows = measure(whole.select(F.struct("__key", "__label", "__n").alias("key"), "__text"), "key", "__text").select("key.*", "x").collect()
    rows.sort(key=lambda r: (r["__key"], r["__label"], r["x"]))  # the order of the rows must not change the sums
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(STATISTICS))
    y, n = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("__label", "__n"))
    return fit(x, y, weight=n)


def classify(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(**shared.value)
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1).cast(pa.binary())]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x), pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def accepted(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, as they were; each is judged where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(trees))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(**shared.value)
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(column).cast(pa.binary())]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(trees.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)

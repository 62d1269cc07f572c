"""Language-model scoring by deleted interpolation.

The model mixes the maximum-likelihood estimates of all orders up to ``order`` and a uniform one:

    P(w | h) = sum_n weight[n, bucket(h)] * count(h_n, w) / count(h_n) + weight[0, bucket(h)] / (V + 1)

with h_n the last n-1 words, and the bucket of h by the count of the longest context, in powers of
two. The weights are learned by expectation-maximisation on held-out counts: every training text is
held out in turn, its tokens being predicted from the counts with the text's own ones deleted. What
these predictions look like is gathered over all training tokens in a table of (bucket, the orders'
estimates in steps of a quarter of an octave, down to 2^-50). Each step of the EM is one aggregate over
that table, which stays in Spark; a number per bucket and order comes to the driver.

Counts are exact and cover all training texts. They are added up and brought back by the exchange
of pairfold.llm.chunks; nothing that grows with the corpus reaches the driver or is broadcast.

Defined cases: a null or empty text is one end token; a null ``train`` flag does not train; words of
any length count whole; repeated rows count as often as they stand; without training texts the score
is the uniform one of an empty vocabulary, 0; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairfold.llm.chunks import blobs, combined, map_rows, mix, ranges_for, results_of, send, total_of, with_results
from pairfold.llm.common import stored, text_bytes
from pairfold.llm.words import word_chunks, words_and_tokens

END, BEGIN = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x0BE6190BE6190BE6)
STEPS, FLOOR = 4, 200  # steps an octave; the estimates' least exponent is -FLOOR / STEPS
BUCKETS = 64


class Tokens:
    """The tokens of a chunk with their ends, and the n-grams that end at each."""

    def __init__(self, row: dict, order: int) -> None:
        words, tokens = words_and_tokens(row)
        sizes = np.array(row["n_words"], dtype=np.int64) + 1
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        last = np.cumsum(sizes) - 1
        self.first = last - sizes + 1
        every = np.full(len(self.doc), END)
        body = np.ones(len(every), dtype=bool)
        body[last] = False
        every[body] = words[tokens]
        self.train = np.array([bool(x) for x in row["train"]])[self.doc] if len(sizes) else np.zeros(0, dtype=bool)
        self.names, self.place = [], []
        gram = every
        for n in range(1, order + 1):
            if n > 1:
                gram = mix(self.before(gram, BEGIN), every)
            distinct, place = np.unique(gram, return_inverse=True)
            self.names.append(distinct)
            self.place.append(place)

    def before(self, values: np.ndarray, at_begin) -> np.ndarray:
        """The value of the token before each."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_begin
        return out

    def counts(self, level: int) -> np.ndarray:
        """How often each n-gram stands in the chunk's training texts."""
        return np.bincount(self.place[level], self.train, len(self.names[level])).astype(np.int64)

    def own(self, level: int) -> np.ndarray:
        """How often a token's n-gram stands in its own text."""
        place = self.place[level]
        out = np.ones(len(place), dtype=np.int64)
        often = np.flatnonzero(np.bincount(place)[place] > 1) if len(place) else place
        pair = place[often].astype(np.int64) * (int(self.doc[-1]) + 1 if len(self.doc) else 1) + self.doc[often]
        _, back, n = np.unique(pair, return_inverse=True, return_counts=True)
        out[often] = n[back]
        return out


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 more than the whole logarithm of its count."""
    out = np.zeros(len(count), dtype=np.int64)
    seen = count > 0
    out[seen] = np.frexp(count[seen].astype(np.float64))[1]
    return np.minimum(out, BUCKETS - 1)


def _estimates(tokens: Tokens, rows: list[dict], total: int, texts: int, deleted: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts and context counts of each order at every token; with the own text's deleted."""
    counts, contexts = [], []
    sizes = np.bincount(tokens.doc) if len(tokens.doc) else np.zeros(0, dtype=np.int64)
    for level in range(len(tokens.names)):
        found = (results_of(rows, level + 1) + tokens.counts(level))[tokens.place[level]]
        if level == 0:
            context = np.full(len(found), total) - (sizes[tokens.doc] if deleted else 0)
        else:
            context = tokens.before(counts[-1], texts - deleted)
        counts.append(found - tokens.own(level) if deleted else found)
        contexts.append(context)
    return counts, contexts


#: Rows of the EM's table that a task takes in a step.
CELLS = 1 << 21
#: The buckets taken together; their weights serve a bucket that no token is in.
ALL = -1


def _em(cells: DataFrame, order: int, distinct: int, steps: int, close: float = 1e-4) -> np.ndarray:
    """weights[bucket, 0..order] from rows (bucket, q1..q<order>, n) of estimates in steps; ends when no weight moves by ``close``."""
    weights = np.full((BUCKETS + 1, order + 1), 1 / (order + 1))  # the last row is that of all buckets
    values = [F.lit(1 / (distinct + 1)), *(F.when(F.col(f"q{k}") > FLOOR, 0.0).otherwise(F.pow(F.lit(2.0), -F.col(f"q{k}") / F.lit(float(STEPS)))) for k in range(1, order + 1))]
    every = cells.select(F.explode(F.array("bucket", F.lit(ALL))).alias("bucket"), "n", *(v.alias(f"p{k}") for k, v in enumerate(values)))
    every = stored(every.groupBy("bucket", *(f"p{k}" for k in range(order + 1))).agg(F.sum("n").alias("n")), "lm-cells")
    every = stored(every.coalesce(math.ceil((every.count() + 1) / CELLS)), "lm-cells")
    seen: set[int] = set()
    for _ in range(steps):
        table = F.split(F.lit(",".join(repr(float(x)) for x in weights.ravel())), ",").cast("array<double>")
        at = F.when(F.col("bucket") == ALL, BUCKETS).otherwise(F.col("bucket")) * (order + 1)
        parts = every.select("bucket", "n", *((F.col(f"p{k}") * F.element_at(table, (at + (k + 1)).cast("int"))).alias(f"r{k}") for k in range(order + 1)))
        whole = F.greatest(sum((F.col(f"r{k}") for k in range(1, order + 1)), F.col("r0")), F.lit(1e-300))
        new, far = weights.copy(), 0.0
        for row in parts.groupBy("bucket").agg(*(F.sum(F.col("n") * F.col(f"r{k}") / whole).alias(f"s{k}") for k in range(order + 1))).collect():
            w = np.array([row[f"s{k}"] for k in range(order + 1)])
            w = np.maximum(w / w.sum(), 1e-7)
            far = max(far, float(np.abs(w / w.sum() - weights[row.bucket]).max()))
            new[row.bucket] = w / w.sum()
            seen.add(row.bucket)
        weights = new
        if far < close:
            break
    weights[[b for b in range(BUCKETS) if b not in seen]] = weights[ALL]
    return weights[:BUCKETS]


def score(docs: DataFrame, train: Column, order: int = 2, em_steps: int = 60, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Scores are log10 probabilities of the whole text with its end; ``base_score`` is the add-one
    unigram's. ``train`` marks the rows to learn from.
    """
    if not 1 <= order <= 6:
        raise ValueError("orders are from 1 to 6")
    n_bytes = text_bytes(docs, text)
    ranges = ranges_for(n_bytes)
    table = word_chunks(docs, F.col(key), [(F.coalesce(train, F.lit(False)), "train", "boolean")], F.col(text), n_bytes)

    def emit(row: dict) -> list[tuple]:
        tokens = Tokens(row, order)
        out = []
        for level, names in enumerate(tokens.names):
            out += blobs(row["chunk"], level + 1, names, [tokens.counts(level)], ranges)
        return out

    sums = combined(send(table, emit, 1), lambda level: [np.add], lambda level, values: values[0], 1, "lm-counts", ranges, lambda level, result: int((result > 0).sum()), others=True)
    distinct = total_of(sums, 1)
    size = table.select(F.explode(F.arrays_zip("train", "n_words")).alias("d")).where("d.train").agg(F.sum(F.col("d.n_words") + 1), F.count("*")).first()
    total, texts = int(size[0] or 0), int(size[1])
    joined = with_results(table, sums)

    def look(row: dict) -> dict[str, list]:
        tokens = Tokens(row, order)
        counts, contexts = _estimates(tokens, row["r0"], total, texts, True)
        cell = _bucket(contexts[-1])
        for c, h in zip(counts, contexts, strict=True):
            p = np.where((c > 0) & (h > 0), np.log2(np.maximum(c, 1) / np.maximum(h, 1)), -np.inf)
            cell = cell * (FLOOR + 2) + np.where(np.isfinite(p), np.minimum(np.rint(-np.maximum(p, -FLOOR / STEPS) * STEPS), FLOOR), FLOOR + 1).astype(np.int64)
        found, n = np.unique(cell[tokens.train], return_counts=True)
        return {"cell": found, "n": n}

    found = map_rows(joined, look, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    digits = [F.pmod(F.expr(f"cell div {(FLOOR + 2) ** (order - k)}"), F.lit(FLOOR + 2)).cast("int").alias(f"q{k}") for k in range(1, order + 1)]
    cells = found.select(F.expr(f"cell div {(FLOOR + 2) ** order}").cast("int").alias("bucket"), *digits, "n")
    weights = _em(cells, order, distinct, em_steps)

    def rate(row: dict) -> dict[str, list]:
        tokens = Tokens(row, order)
        counts, contexts = _estimates(tokens, row["r0"], total, texts, False)
        w = weights[_bucket(contexts[-1])]
        p = w[:, 0] / (distinct + 1)
        for n, (c, h) in enumerate(zip(counts, contexts, strict=True), 1):
            p = p + w[:, n] * c / np.maximum(h, 1)
        if total == 0:
            p = np.full(len(p), 1 / (distinct + 1))
        k = len(row["key"])
        add = lambda x: np.bincount(tokens.doc, x, k)
        return {
            "key": row["key"], "train": row["train"], "n_tokens": [x + 1 for x in row["n_words"]], "n_known": add(counts[0] > 0).astype(np.int64),
            "base_score": add(np.log10((counts[0] + 1) / (total + distinct + 1))), "score": add(np.log10(p)),
        }

    kind = table.schema["key"].dataType.elementType.simpleString()
    got = map_rows(joined, rate, f"key {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return got.withColumn("train_tokens", F.lit(total).cast("long")).withColumnRenamed("key", key)

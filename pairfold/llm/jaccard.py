"""Exact Jaccard self-join of shingle sets by set-relation skipping, up to connected components.

A document is the set of its distinct 5-word shingles; two link at a Jaccard similarity of 75 % or
more. The frequency of every shingle is counted over the whole corpus first (pairfold.llm.chunks),
so that most documents are done at once: one that shares less than 75 % of its shingles with anybody
has no partner. Equal sets are one set from there on.

The others put the rarest shingles of their order into an inverted index, as many as any partner
must meet. The lists of the index are worked off by the relations among their sets:

* Index level. An entry knows its position in its set and the set's size; lists are cut into blocks
  of similar sizes. What a position leaves to share bounds the sizes that a partner may have, so that an
  entry meets only the blocks that its position allows and all others are skipped whole, as are lists
  whose sets are in one component already. Short lists are compared pair by pair in their blocks.
* Answer level. A long list is compared to its most central set first, the pivot. Its other sets'
  answers follow from the pivot's: two sets close to it are linked through it and need no comparison
  in a search for components; two whose distances to it differ by more than the threshold are no
  pair (Jaccard distance is a metric); lists fall apart where their components' distances leave such
  a gap. What remains is compared in the next rounds: pivots are then sets outside the list's
  largest component, eight times as many each round, and are done with once compared.

A list ends when one component is left, after as many rounds as its number of sets outside the
largest has octal digits. The sets of one component are never compared to each other. Copies,
however many, cost a row each.

Defined cases: documents without words, or with a null text, have an empty set and link with nobody;
fewer than ``shingle`` words are one shingle; repeated rows and equal keys are rows of their own in
one component; a null key has its row, and a component whose keys are all null has a null id; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.chunks import blobs, combined, map_rows, mix, ranges_for, results_of, send, with_results
from pairfold.llm.common import join_skewed, stored, text_bytes
from pairfold.llm.graph import components
from pairfold.llm.words import word_chunks, words_and_tokens

#: Candidates per entry of a list that is compared pair by pair; the pivots of a long list grow so many times a round.
WIDE, WIDER = 4, 8


class Shingles:
    """The distinct shingle sets of a chunk."""

    def __init__(self, row: dict, size: int) -> None:
        words, tokens = words_and_tokens(row)
        w = words[tokens]
        counts = np.array(row["n_words"], dtype=np.int64)
        start = np.cumsum(counts) - counts
        chain = w
        for k in range(1, size):
            chain = mix(chain[:-1], w[k:]) if len(chain) > 1 else chain[:0]
        self.n, self.name, self.sets, self.which, seen = [], [], [], [], {}
        for a, n in zip(start.tolist(), counts.tolist(), strict=True):
            if n >= size:
                s = np.unique(chain[a : a + n - size + 1])
            elif n:
                short = w[a : a + 1]
                for k in range(1, n):
                    short = mix(short, w[a + k : a + k + 1])
                s = mix(short, np.array([n], dtype=np.uint64))
            else:
                s = w[:0]
            name = None
            if n:
                sums = [mix(s, np.full(len(s), c, dtype=np.uint64)).sum(dtype=np.uint64) for c in (11, 13)]
                name = b"".join(int(x).to_bytes(8, "big") for x in sums) + len(s).to_bytes(4, "big")
            first = name is not None and name not in seen
            if first:
                seen[name] = len(self.sets)
                self.sets.append(s)
            self.n.append(len(s))
            self.name.append(name)
            self.which.append(seen[name] if first else -1)
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, dtype=np.uint64)
        self.distinct, self.place, self.count = np.unique(every, return_inverse=True, return_counts=True)
        self.end = np.cumsum([len(s) for s in self.sets]) if self.sets else np.zeros(0, dtype=np.int64)


def shingle_sets(docs: DataFrame, percent: int, shingle: int, key: str, text: str) -> DataFrame:
    """(key, n, name, shared, central) of every row; stored.

    ``name`` stands for the set. ``shared`` is there for one row of each set and chunk, if the set
    may have a partner: its shingles that other sets have too, the rarest first.
    """
    n_bytes = text_bytes(docs, text)
    ranges = ranges_for(n_bytes)
    table = word_chunks(docs, F.col(key), [], F.col(text), n_bytes)

    def emit(row: dict) -> list[tuple]:
        s = Shingles(row, shingle)
        return blobs(row["chunk"], 1, s.distinct, [s.count], ranges)

    counts = combined(send(table, emit, 1), lambda level: [np.add], lambda level, v: v[0], 1, "jaccard-counts", ranges)

    def keep(row: dict) -> dict[str, list]:
        s = Shingles(row, shingle)
        frequency = results_of(row["r0"], 1)[s.place] if len(s.place) else np.zeros(0, dtype=np.int64)
        shared, central = [], []
        for n, which in zip(s.n, s.which, strict=True):
            mine, center = None, None
            if which >= 0:
                b = int(s.end[which])
                f = frequency[b - n : b]
                if 100 * int((f > 1).sum()) >= percent * n:
                    order = np.lexsort((s.sets[which], f))
                    mine = s.sets[which][order[int((f == 1).sum()) :]].view(np.int64)
                    center = float(f.sum() / n)
            shared.append(mine)
            central.append(center)
        return {"key": row["key"], "n": s.n, "name": s.name, "shared": shared, "central": central}

    kind = table.schema["key"].dataType.elementType.simpleString()
    return stored(map_rows(with_results(table, counts), keep, f"key {kind}, n int, name binary, shared array<long>, central double"), "jaccard-sets")


def _linked(overlap: str, a: str, b: str, percent: int):
    return 100 * F.col(overlap) >= percent * (F.col(a) + F.col(b) - F.col(overlap))


def _possible(percent: int):
    """May two entries of a list be a pair that meets there first, by the sizes and positions?"""
    most = 1 + F.least(F.col("x.n") - F.col("x.pos") - 1, F.col("y.n") - F.col("y.pos") - 1)
    sizes = 100 * F.least(F.col("x.n"), F.col("y.n")) >= percent * F.greatest(F.col("x.n"), F.col("y.n"))
    away = F.abs(F.col("x.d") - F.col("y.d")) <= (100 - percent) / 100 + 1e-9
    return sizes & (100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)) & F.coalesce(away, F.lit(True)) & (F.col("x.root") != F.col("y.root"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance, linked) of distinct pairs of set names."""
    a = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    b = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))


def _block(n, percent: int):
    """The block of a list that sets of n shingles stand in: sizes that grow by the ratio of two that may link."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent))).cast("int")


def _meeting(entries: DataFrame, percent: int) -> DataFrame:
    """Entries with each block that their size and position let them meet; of some, none."""
    n, left = F.col("n"), F.col("n") - F.col("pos")
    low = F.ceil(n * percent / 100)
    high = F.least(F.floor(n * 100 / percent), F.floor(left * (100 + percent) / percent) - n)
    met = entries.where(high >= low)
    return met.withColumn("block", F.explode(F.sequence(_block(low, percent), _block(high, percent))))


#: Cells of the distances from a pivot, which are from 0 to 1.
CELLS = 60


def _parted(rooted: DataFrame, percent: int) -> DataFrame:
    """Lists in parts: components with their distances from the list's pivot, parted where these leave a gap.

    The distances that a component covers are bits of a number, and those of a list are added up bit by bit; a run
    of empty cells wider than the threshold parts it. A gap that the cells do not show parts nothing.
    """
    need = CELLS * (100 - percent) // 100 + 1
    low, high = F.floor(F.min(F.coalesce("d", F.lit(0.0))) * CELLS), F.floor(F.max(F.coalesce("d", F.lit(1.0))) * CELLS)
    groups = rooted.groupBy("s", "part", "root").agg(low.cast("int").alias("low"), high.cast("int").alias("high"))
    groups = groups.withColumn("covered", F.expr("shiftleft(1L, high + 1) - shiftleft(1L, low)"))
    lists = groups.groupBy("s", "part").agg(F.bit_or("covered").alias("mask"))
    cut = F.expr(f"size(filter(sequence({need}, {CELLS}), p -> p <= low AND (shiftright(mask, p) & 1) = 1 AND (shiftright(mask, p - {need}) & {(1 << need) - 1}L) = 0))")
    cuts = groups.join(lists, ["s", "part"]).select("s", "part", "root", cut.alias("cut"))
    return rooted.join(cuts, ["s", "part", "root"]).withColumn("part", F.xxhash64("part", "cut")).drop("cut")


def linked_components(sets: DataFrame, percent: int) -> DataFrame | None:
    """(vertex, root): components of all links among the sets, by name; None if no two share a list."""
    required = F.ceil(F.col("n") * percent / 100).cast("int")
    unshared = F.col("n") - F.size("shared")
    prefix = F.slice("shared", F.lit(1), F.col("n") - required + 1 - unshared)
    entries = sets.select(F.posexplode(prefix).alias("at", "s"), "name", "n", "central", (unshared + F.col("at")).alias("pos"))
    lists = stored(entries.groupBy("s").count().where("count > 1").select("s"), "jaccard-lists")
    entries = stored(entries.join(lists, "s").select("s", "name", "n", "central", "pos", F.lit(0).cast("long").alias("part"), F.lit(None).cast("double").alias("d")), "jaccard-entries")
    links, roots, width = None, None, 1
    for turn in itertools.count():
        rooted = entries.withColumn("root", F.col("name")) if roots is None else entries.join(roots.select(F.col("vertex").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
        if turn == 1:
            rooted = stored(_parted(rooted, percent), "jaccard-parts")
        groups = rooted.groupBy("s", "part", "root").agg(F.count("*").alias("k"), F.max(F.struct("central", "name")).alias("central"), F.min("name").alias("first"))
        lists = groups.groupBy("s", "part").agg(
            F.sum("k").alias("total"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max(F.struct("k", "root")).alias("largest"),
            F.min(F.struct("k", "root", "first")).alias("smallest"), F.max("central").alias("central"),
        )
        # The first pivot is the most central set; later ones are of all components but the largest.
        lists = lists.where("total * total > same").select(
            "s", "part", F.expr(f"(total * total - same) / 2 <= {WIDE} * total").alias("short"), F.col("central.name" if turn == 0 else "smallest.first").alias("pivot"),
            F.col("largest.root").alias("most"), (F.lit(width) / (F.col("total") - F.col("largest.k"))).alias("share"),
        )
        lists = stored(lists, "jaccard-lists")
        if not lists.limit(1).count():
            return roots
        chosen = F.col("name") == F.col("pivot")
        if turn:
            chosen |= (F.col("root") != F.col("most")) & (F.pmod(F.xxhash64("name", "s"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
        active = stored(rooted.join(lists, ["s", "part"]).withColumn("chosen", chosen).drop("most", "share"), "jaccard-active")
        short, long = active.where("short"), active.where("NOT short")
        where = (F.col("x.s") == F.col("y.s")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.block") == F.col("y.block"))
        x, y = F.col("x.name"), F.col("y.name")
        in_blocks = lambda e: e.withColumn("block", _block(F.col("n"), percent))
        pairs = _meeting(short, percent).alias("x").join(in_blocks(short).alias("y"), where & (x < y)).where(_possible(percent)).select(x.alias("a"), y.alias("b"))
        ends = (x.alias("a"), y.alias("b")) if turn == 0 else (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        starred = in_blocks(long).alias("x").join(_meeting(long.where("chosen"), percent).alias("y"), where & (x != y)).where(_possible(percent)).select(*ends)
        # A pair may stand in a short list in one order and in a long one in the other; both are right.
        found = stored(_compared(pairs.unionByName(starred).distinct(), sets), "jaccard-compared")
        new = found.where(_linked("o", "na", "nb", percent)).select("a", "b")
        if roots is None or new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            roots = components(links, "jaccard-components")
        rest = long.where("NOT chosen")
        if turn == 0:
            known = found.select(F.col("a").alias("name"), F.col("b").alias("pivot"), (1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("d"))
            rest = rest.drop("d").join(known, ["name", "pivot"], "left")
        entries = stored(rest.select("s", "name", "n", "central", "pos", "part", "d"), "jaccard-entries")
        width *= WIDER


def similar(docs: DataFrame, percent: int = 75, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; the id is the least key of the component."""
    every = shingle_sets(docs, percent, shingle, key, text)
    own = every.where("name IS NOT NULL").groupBy("name").agg(F.min("key").alias("least"), F.count("*").alias("rows"))
    sets = stored(every.where("shared IS NOT NULL").select("name", "n", "shared", "central").dropDuplicates(["name"]), "jaccard-distinct")
    roots = linked_components(sets, percent)
    if roots is not None:
        roots = stored(roots.withColumnRenamed("vertex", "name").select("name", "root"), "jaccard-roots")
        whole = own.join(roots, "name").groupBy("root").agg(F.min("least").alias("id"), F.count("*").alias("sets"))
        larger = join_skewed(roots, whole, "root", "sets").select("name", "id")
        own = own.join(larger, "name", "left").select("name", F.coalesce("id", "least").alias("least"), "rows")
    # Copies, however many, share a name.
    got = join_skewed(every.select("key", "n", "name"), own.select("name", F.col("least").alias("id"), "rows"), "name", "rows")
    return got.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("key")).otherwise(F.col("id")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """``docs`` without the documents of a component but the one with the least doc_id.

    Of rows that agree in doc_id and text one stays; rows of one doc_id with different texts stay or
    go together. Documents without words stay, and so do those without a doc_id.
    """
    got = similar(docs, percent, shingle).where("doc_id <> component_id")
    gone = stored(got.select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    twice = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice")
    if not twice.limit(1).count():
        return kept
    same = F.col("doc_id") == F.col("__twice")
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))

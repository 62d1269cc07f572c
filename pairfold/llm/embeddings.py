"""Embedding near-duplicates by navigable small-world graphs per shard.

Equal vectors of a label are one class. The classes of a label are dealt to shards of bounded size;
each shard gets a graph (pairfold.llm.hnsw). Every shard is queried with the vectors of its own and
of each later shard of its label, in blocks of one shard; beams widen fourfold for the queries whose
whole beam links, and twofold for all of a block until the block's audit finds the recall that is
asked for. An audit compares queries of the block, in a random order, to every vector of the shard
until it has seen ``LINKS`` true links to other vectors or has tried all queries of the block: a
block without links passes only when all of it has been looked at. What the graphs return is
verified by cosine in double precision, counted for both sides, and united inside the pair of
shards; the small trees that this leaves are united by pairfold.llm.graph. The audits' counts of
true links and of those that the graphs had found come with the result.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows
with a null label, link with nothing; only vectors of one length are compared; equal vectors link
with each other; rows of equal key are rows of their own; a null key sorts after others; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairfold.llm.common import join_skewed, stored
from pairfold.llm.graph import components
from pairfold.llm.hnsw import Graph

SHARD, BEAM = 8192, 64
#: True links that an audit has to see before it may pass without all queries of its block.
LINKS = 64
BLOCK = 512


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's vector as bytes of doubles, null for one that links with nothing."""
    for batch in batches:
        out = []
        for value in batch.column(2):
            x = value.as_py()
            x = np.array(x, dtype=np.float64) if x and None not in x else np.zeros(0)
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "label", "vector"])


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(d, dtype=np.float64) for d in data])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("name")  # names are hashes: a random order, and the same one every time
    unit = _unit(group.vector.tolist())
    row = {k: group[k].iloc[0] for k in ("label", "dim", "shard", "shards")}
    row |= {"names": group.name.tolist(), "sizes": group["size"].tolist(), "unit": unit.tobytes(), "graph": Graph.build(unit).to_bytes()}
    return pd.DataFrame([row])


def _links(graph: Graph, target: np.ndarray, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Pairs (query, place) that the graph finds at a cosine of ``least`` or more."""
    found = []
    for at in range(0, len(queries), BLOCK):
        rest, wide = np.arange(at, min(at + BLOCK, len(queries))), beam
        while len(rest):
            place, sim = graph.search(queries[rest], wide)
            ok = (place >= 0) & (sim >= least - 1e-4)
            full = ok.all(axis=1) & (place.shape[1] < len(target)) if place.shape[1] else np.zeros(len(rest), dtype=bool)
            q, c = np.nonzero(ok & ~full[:, None])
            a, b = rest[q], place[q, c]
            for k in range(0, len(a), 1 << 18):
                i, j = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
                good = np.einsum("kd,kd->k", queries[i], target[j]) >= least
                found.append(np.stack([i[good], j[good]], axis=1))
            rest, wide = rest[full], wide * 4
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def _audited(graph: Graph, target: np.ndarray, queries: np.ndarray, same: bool, least: float, recall: float, beam: int) -> tuple[np.ndarray, int, int]:
    """The links found, the true links of the audited queries, and how many of these were found.

    ``same``: the queries are the shard's own vectors, whose links to themselves are none.
    """
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    audited, truth, at = np.zeros(len(queries), dtype=bool), 0, 0
    while at < len(queries) and truth < LINKS:
        some = order[at : at + min(max(at, 64), BLOCK)]
        near = queries[some] @ target.T >= least
        if same:
            near[np.arange(len(some)), some] = False
        truth += int(near.sum())
        audited[some] = True
        at += len(some)
    while True:
        found = _links(graph, target, queries, least, beam)
        if same:
            found = found[found[:, 0] != found[:, 1]]
        hit = int(audited[found[:, 0]].sum())
        if beam >= len(target) or hit >= recall * truth:
            return found, truth, hit
        beam *= 2


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least place of each place's component."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        pairs = pairs[a != b]
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if not len(pairs):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _compare(least: float, recall: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                target = np.frombuffer(row["unit"], dtype=np.float64).reshape(len(row["names"]), -1)
                same = row["shard"] == row["from_shard"]
                queries = np.frombuffer(row["from_unit"], dtype=np.float64).reshape(len(row["from_names"]), -1)
                pairs, truth, hit = _audited(Graph.from_bytes(target, row["graph"]), target, queries, same, least, recall, beam)
                names, sizes = row["names"], np.array(row["sizes"], dtype=np.int64)
                if same:
                    pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
                else:
                    pairs = pairs + [len(names), 0]
                    names, sizes = names + row["from_names"], np.r_[sizes, np.array(row["from_sizes"], dtype=np.int64)]
                count = np.bincount(pairs[:, 0], sizes[pairs[:, 1]], len(names)) + np.bincount(pairs[:, 1], sizes[pairs[:, 0]], len(names))
                root = _roots(len(names), pairs)
                at = np.flatnonzero(count).tolist()
                # The first row is the block's audit; it has no name.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None, *(names[x] for x in at)], pa.binary()), pa.array([0, *count[at].astype(np.int64).tolist()], pa.int64()), pa.array([None, *(names[root[x]] for x in at)], pa.binary()),
                        pa.array([truth, *[0] * len(at)], pa.int64()), pa.array([hit, *[0] * len(at)], pa.int64()),
                    ],
                    ["name", "n", "root", "truth", "hit"],
                )

    return run


def near_duplicates(table: DataFrame, least: float = 0.98, recall: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(key, n_links, component_id, kept, audited_links, audited_recall) of every row.

    ``recall`` is what the audits ask of each pair of shards, whose searches begin with ``beam``. ``kept`` marks the
    row whose key is its component's id, the least key in it. The last two columns are of the whole run: true
    links that the audits saw, and the share of them that the graphs had found (null if they saw none).
    """
    rows = table.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.mapInArrow(_checked, f"key {kinds['key']}, label {kinds['label']}, vector binary")
    name = F.unhex(F.md5(F.concat(F.col("vector"), F.encode(F.col("label").cast("string"), "UTF-8"))))
    rows = stored(rows.withColumn("name", F.when(F.col("label").isNotNull() & F.col("vector").isNotNull(), name)), "vectors")
    classes = rows.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("size"), F.min("key").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "vector-classes")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    n_shards, n_pairs = counts.agg(F.sum("shards"), F.sum(F.col("shards") * (F.col("shards") + 1) / 2)).first()
    linked = classes.select(F.col("name"), "size", "least", F.lit(0).cast("long").alias("n"), F.col("least").alias("id"))
    truth = hit = 0
    if n_shards:
        deal = F.pmod(F.xxhash64("name"), F.col("shards")).cast("int")
        dealt = classes.join(counts, ["label", "dim"]).withColumn("shard", deal).select("label", "dim", "shard", "shards", "name", "size", "vector")
        dealt = dealt.repartition(int(n_shards), "label", "dim", "shard")
        kind = kinds["label"]
        graphs = stored(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, f"label {kind}, dim int, shard int, shards int, names array<binary>, sizes array<long>, unit binary, graph binary"), "graphs")
        asked = graphs.select("label", "dim", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("shard"), F.col("shard").alias("from_shard"), F.col("names").alias("from_names"), F.col("sizes").alias("from_sizes"), F.col("unit").alias("from_unit"))
        pairs = asked.join(graphs.drop("shards"), ["label", "dim", "shard"])
        pairs = pairs.repartition(min(100_000, int(math.ceil(n_pairs))), "label", "dim", "shard", "from_shard")
        found = stored(pairs.mapInArrow(_compare(least, recall, beam), "name binary, n long, root binary, truth long, hit long"), "vector-links")
        truth, hit = found.agg(F.sum("truth"), F.sum("hit")).first()
        found = found.where("name IS NOT NULL")
        roots = components(found.select(F.col("name").alias("a"), F.col("root").alias("b")), "vector-components")
        joined = classes.join(found.groupBy("name").agg(F.sum("n").alias("n")), "name").join(roots.withColumnRenamed("vertex", "name"), "name")
        joined = stored(joined.select("name", "size", "least", "n", "root"), "vector-linked")
        ids = joined.groupBy("root").agg(F.min("least").alias("id"), F.count("*").alias("members"))
        linked = linked.join(joined.select("name"), "name", "left_anti").unionByName(join_skewed(joined, ids, "root", "members").select("name", "size", "least", "n", "id"))
    linked = linked.select("name", "size", (F.col("n") + F.col("size") - 1).alias("n_links"), "id")
    out = join_skewed(rows.select("key", "name"), linked, "name", "size")
    component = F.when(F.col("name").isNull(), F.col("key")).otherwise(F.col("id"))
    audited = [F.lit(truth).cast("long").alias("audited_links"), F.lit(hit / truth if truth else None).cast("double").alias("audited_recall")]
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"), *audited)

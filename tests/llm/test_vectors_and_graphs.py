"""Embedding near-duplicates and components against brute force."""

import random

import numpy as np
import pytest

from pairfold.llm import embeddings, graph, queries
from pairfold.llm.hnsw import Graph

SF = "/root/testdata/sf0.01"


def brute(rows, least=0.98):
    groups = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and None not in v:
            x = np.array(v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                groups.setdefault((label, len(x)), []).append((k, x / np.linalg.norm(x)))
    root, links = list(range(len(rows))), [0] * len(rows)

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for group in groups.values():
        at, unit = [k for k, _ in group], np.stack([u for _, u in group])
        for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= least - 1e-12, 1)), strict=True):
            a, b = at[i], at[j]
            links[a] += 1
            links[b] += 1
            root[of(a)] = of(b)
    least_of = {}
    for k, (key, _, _) in enumerate(rows):
        if key is not None:
            least_of[of(k)] = min(key, least_of.get(of(k), key))
    return sorted(((key, links[k], least_of.get(of(k)), key is not None and key == least_of.get(of(k))) for k, (key, _, _) in enumerate(rows)), key=repr)


def got(df, **more):
    return sorted(map(tuple, embeddings.near_duplicates(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    found = queries.op10_embedding_dedup(spark, SF)
    assert sorted(map(tuple, found.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr) == brute(rows)


def test_recall_of_many_shards(spark):
    """The vectors of sf0.1 and near copies of some, in several shards a label, against brute force."""
    base = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rng = np.random.default_rng(6)
    near = [(100_000 + 10 * k + j, (np.array(v) + rng.normal(size=len(v)) * s * np.linalg.norm(v) / len(v) ** 0.5).tolist(), label) for k, (_, v, label) in enumerate(base[::3]) for j, s in enumerate((0.1, 0.18, 0.2))]
    rows = base + near
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    found = embeddings.near_duplicates(df, shard=128).collect()
    true, held = sum(n for _, n, _, _ in want), {r.vec_id: r.n_links for r in found}
    assert all(held[k] <= n for k, n, _, _ in want)
    assert sum(held.values()) >= 0.98 * true > 1000
    assert found[0].audited_recall >= 0.98 and found[0].audited_links > 1000


def test_audits_see_sparse_links(spark):
    """A few links among many unlinked vectors of several shards; beams begin at 1 and have to widen."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 48))
    for k in range(0, 80, 2):
        x[k + 1] = x[k] + rng.normal(size=48) * 0.08
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = brute(rows)
    assert 0 < sum(n for _, n, _, _ in want) <= 80
    found = embeddings.near_duplicates(df, shard=300, beam=1)
    assert sum(r.n_links for r in found.collect()) >= 0.9 * sum(n for _, n, _, _ in want)
    seen = found.first()
    assert seen.audited_links > 0
    assert seen.audited_recall >= 0.98


def test_audit_counts_no_vector_with_itself():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, truth, hit = embeddings._audited(Graph.build(x), x, x, True, 0.98, 0.98, 4)
    assert len(found) == truth == hit == 0


@pytest.mark.parametrize("shard", [64, 2048])
def test_odd_vectors_and_shards(spark, shard):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    rows = [(k, (centers[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 1.0])).astype(float).tolist(), int(k % 3)) for k in range(600)]
    rows += [(700 + k, centers[0].tolist(), 0) for k in range(30)]
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 16, 1), (803, [float("nan")] * 16, 1), (804, [None, 1.0], 1), (805, rows[0][1], None), (806, [1.0, 2.0], 1), (807, [2.0, 4.0], 1), (808, [1e300] * 16, 2), (809, [1e-300] * 16, 2), (810, [float("inf"), 1.0], 2), rows[0]]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, size int, name string").repartition(4)
    scaled = [(k, None if v is None else v if None in v or not all(map(np.isfinite, v)) or not any(v) else (np.array(v) / np.abs(v).max()).tolist(), label) for k, v, label in rows]
    assert got(df, shard=shard) == brute(scaled)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert got(df) == []


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.from_bytes(x, Graph.build(x).to_bytes())
    place, _ = g.search(x[:100], 128)
    truth = np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(p[:10]) & set(t)) / 10 for p, t in zip(place, truth, strict=True)]) >= 0.9


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(9)
    edges = {"chain": [(k, k + 1) for k in range(200)], "star": [(0, k) for k in range(1, 200)] + [(300, 300)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(100)], "none": []}[kind]
    rng.shuffle(edges)
    root = {}

    def of(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((of(a), of(b)))
            root[hi] = lo
    df = spark.createDataFrame(edges + edges[:3], "a long, b long")
    found = [(r.vertex, r.root) for r in graph.components(df).collect()]
    assert sorted(found) == sorted((x, of(x)) for x in list(root))

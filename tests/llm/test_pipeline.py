"""Stages of the pipeline: what each keeps and changes, and their rows put together."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pairfold.llm import decontaminate, jaccard, mixing, quality, substrings  # noqa: E402
from pairfold.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def counted(df, *columns):
    return collections.Counter(map(tuple, df.select(*columns).collect()))


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources"]
    columns, steps = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == (columns if k < 4 else [*columns, "copy"])
        steps.append(docs)
    start = table(spark, SF, "documents")
    scores = quality.classify(start, quality.learn(start, table(spark, SF, "labels")))
    assert {r.doc_id for r in steps[0].collect()} == {r.doc_id for r in scores.where("score >= 0.5").collect()}
    assert {r.doc_id for r in steps[1].collect()} == {r.doc_id for r in jaccard.similar(steps[0]).where("doc_id = component_id").collect()}
    assert counted(steps[2], "doc_id", "text") == counted(substrings.deduplicated(steps[1]), "doc_id", "text")
    over = decontaminate.with_overlaps(steps[2], table(spark, SF, "benchmark"))
    assert {r.doc_id for r in steps[3].collect()} == {r.doc_id for r in over.where("size(__overlap.starts) = 0").collect()}
    copies = {r.key: r.copies for r in mixing.systematic_copies(steps[3]).collect()}
    assert counted(steps[4], "doc_id") == {(k,): n for k, n in copies.items() if n}
    assert counted(corpus_pipeline.run(spark, SF), "doc_id", "text", "copy") == counted(steps[4], "doc_id", "text", "copy")


def test_stages_take_odd_documents(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "a b c", "en", None, 5, "x"), (4, "a b c", "en", "s", 5, "x"), (4, "a b c", "en", "s", 5, "x"), (5, "word " * 30_000, "en", "s", 150_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    for name, stage in corpus_pipeline.STAGES:
        assert set(stage(spark, docs, SF).columns) >= set(docs.columns), name
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0

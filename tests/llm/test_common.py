"""Shared helpers: joins on hot keys, the shared folder, what a session leaves behind."""

import os

import pytest

from pairfold.llm import common


def test_join_on_hot_keys_equals_a_plain_join(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 == 0 else None if k % 7 == 0 else f"k{k}", k % 5) for k in range(3000)], "id long, name string, part int")
    side = rows.where("name IS NOT NULL AND id % 11 <> 0").groupBy("name").count().selectExpr("name", "length(name) AS size", "count AS n")
    got = common.join_skewed(rows, side, "name", "n", most=10)
    want = rows.join(side.drop("n"), "name", "left").select("id", "name", "part", "size")
    assert got.columns == ["id", "name", "part", "size"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert common.join_skewed(rows.limit(0), side, "name", "n").count() == 0
    assert common.join_skewed(rows, side.limit(0), "name", "n").where("size IS NULL").count() == 3000


def test_release_deletes_what_was_stored(spark, monkeypatch):
    monkeypatch.setattr(common, "_paths", [])
    kept = common.stored(spark.range(10), "kept")
    path = common._paths[0].removeprefix("file:")
    assert kept.count() == 10 and os.path.isdir(path)
    assert common.release(spark) == 1 and not os.path.exists(path)
    assert common.release(spark) == 0


def test_chunk_tables_leave_no_entry_in_the_catalog(spark):
    from pairfold.llm import lm
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"word {k % 7} and more words {k}") for k in range(200)], "doc_id long, text string")
    assert lm.score(docs, F.lit(True)).count() == 200
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


def test_a_cluster_has_to_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return default

        sparkContext = Context

    with pytest.raises(ValueError):
        common.shared_folder(Session)

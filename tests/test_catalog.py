"""Every query of the catalog against its SQL, and the entry without the corpus package."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from pairfold.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def normal(frame):
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        out[c] = out[c].map("{:.9g}".format) if out[c].dtype.kind == "f" else out[c].astype(str)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = normal(got), normal(want)
    assert a.equals(b), a[(a != b).any(axis=1)].head()


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_query(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, check=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]

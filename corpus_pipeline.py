"""A training-data pipeline over the table of documents, in stages that each take and return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairfold.llm import decontaminate, jaccard, mixing, quality, substrings
from pairfold.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; a null doc_id carries no label; without labels of both classes
    every score is the share of class 1 (0.5 for none), so that all documents stay or go alike; repeated rows stay or go together.
    """
    trees = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, trees)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Null and wordless texts have no near copies and stay, as do rows without a doc_id; of rows that agree in doc_id
    and text one stays; rows of one doc_id with different texts stay or go together.
    """
    return jaccard.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that stand in a document before are cut out.

    Every row stays, null texts as null; a null doc_id is larger than all others; rows of equal doc_id do not cut each
    other; characters that a cut splits go whole; n_chars follows the text.
    """
    return substrings.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null and wordless texts hold none and stay; null and wordless items have no window; null keys and repeated rows pass
    through as they are.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; ``copy`` numbers the copies of a document.

    A null source is one of its own; texts without words are taken with 0 words; rows that agree in all columns are
    one document with the copies of all of them.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again as the next one's documents. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


#: The stages learn a classifier and cut bytes; SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

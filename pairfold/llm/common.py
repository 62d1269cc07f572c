"""Shared helpers of the corpus operators: tables, the shared work folder, crc32 splits."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: str | None = None
_cleaned = 0.0
#: What this session has written to the shared folder.
_paths: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader, wherever the folder is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent a folder of our own is made, on a single machine only; a cluster has to name one.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_folder = _own_folder or tempfile.mkdtemp(prefix="pairfold-")
        folder = _own_folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    _paths.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    A lost executor costs the tasks that read the files, not the work that made them. The files
    stay until ``release`` is called, as the frame that reads them may run at any later time.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    forget_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession, seconds: float = 4.0) -> None:
    """Let Spark drop the files of shuffles that nothing refers to any more, at most once in so many seconds.

    Its cleaner acts only when the driver collects garbage, which a driver with little to do puts off while files pile up.
    """
    global _cleaned
    if time.monotonic() - _cleaned >= seconds:
        gc.collect()
        spark._jvm.System.gc()
        _cleaned = time.monotonic()


def release(spark: SparkSession) -> int:
    """Delete what the corpus operators have left in the shared folder; the number of paths.

    For the caller that has written its results: frames that an operator returned read these files.
    """
    gone = 0
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def join_skewed(rows: DataFrame, side: DataFrame, on: str, weight: str, most: int = 1000) -> DataFrame:
    """``rows`` and the columns of ``side``, a left join on ``on``, however many rows share a key.

    ``side`` has one row per key with the number of rows of that key in ``weight``. At most ``most`` keys can
    hold more than one part in ``most`` of all rows: these are broadcast, the others are joined by a shuffle.
    """
    side = stored(side, "skewed")
    every = side.agg(F.sum(weight)).first()[0] or 0
    hot, rest = side.where(F.col(weight) * most > every), side.where(F.col(weight) * most <= every)
    more = [c for c in side.columns if c not in (on, weight)]
    marked = rows.join(F.broadcast(hot.select(F.col(on).alias("__on"), *(F.col(c).alias(f"__{c}") for c in more))), F.col(on) == F.col("__on"), "left")
    done = marked.where("__on IS NOT NULL").select(*rows.columns, *(F.col(f"__{c}").alias(c) for c in more))
    return done.unionByName(marked.where("__on IS NULL").select(*rows.columns).join(rest.drop(weight), on, "left").select(*rows.columns, *more))


def crc_mod(key: str | Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; -1 for a null key (in no held-out part)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % divisor, F.lit(-1)).cast("int")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes chunks and partitions, never limits the work."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)

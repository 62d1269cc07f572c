"""Column files, snapshots with the one before, manifests of runs, and backups that overwrite nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairfold.work import exists, new_path, remove, rename


def _header(names: list[str], units: list[str]) -> list[str]:
    return ["# " + " ".join(names), "# " + " ".join(units)]


def write_columns(rows: DataFrame, path: str, units: dict[str, str] | None = None) -> None:
    """A column file: names and units after #, then rows in order of the first column, a whole number; the others with six decimals.

    It is a folder of text parts; put together in the order of their names they are one file.
    """
    step, *others = rows.columns
    line = F.concat_ws(" ", F.col(step).cast("long").cast("string"), *(F.format_string("%.6f", F.col(c).cast("double")) for c in others))
    lines = rows.select(F.lit(1).alias("o"), F.col(step).cast("long").alias("s"), line.alias("value"))
    head = rows.sparkSession.createDataFrame([(0, k, x) for k, x in enumerate(_header(rows.columns, [(units or {}).get(c, "-") for c in rows.columns]))], "o int, s long, value string")
    head.unionByName(lines).orderBy("o", "s").select("value").write.text(path)


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a column file, with the names that stand in it."""
    text = spark.read.text(path)
    # Part files sort by name; the header is at the beginning of the first one.
    head = spark.read.text(path).where(F.col("value").startswith("#")).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k")).orderBy("f", "k").limit(2).collect()
    names = head[0].value[1:].split()
    words = text.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), " +").alias("w"))
    return words.select(F.col("w")[0].cast("long").alias(names[0]), *(F.col("w")[k].cast("double").alias(n) for k, n in enumerate(names) if k))


def continue_columns(rows: DataFrame, path: str, after: int, units: dict[str, str] | None = None) -> None:
    """Go on with a column file from a step: its rows up to the step stay, later ones are replaced; the names must be the same.

    The new file is complete before it takes the old one's place.
    """
    spark = rows.sparkSession
    held = read_columns(spark, path)
    if held.columns != rows.columns:
        raise ValueError(f"{path} has the columns {held.columns}, not {rows.columns}")
    step = rows.columns[0]
    fresh = f"{path}.new"
    if exists(spark, fresh):
        remove(spark, fresh)
    write_columns(held.where(F.col(step) <= after).unionByName(rows.where(F.col(step) > after)), fresh, units)
    old = f"{path}.old"
    rename(spark, path, old)
    rename(spark, fresh, path)
    remove(spark, old)


def save_snapshot(state: DataFrame, path: str) -> None:
    """A snapshot: written beside, then put in place; the one before stays as ``<path>.prev``."""
    spark = state.sparkSession
    fresh, before = f"{path}.tmp", f"{path}.prev"
    if exists(spark, fresh):
        remove(spark, fresh)
    state.write.parquet(fresh)
    if exists(spark, path):
        if exists(spark, before):
            remove(spark, before)
        rename(spark, path, before)
    rename(spark, fresh, path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot, or the one before if a run ended between putting that aside and this one in place."""
    return spark.read.parquet(path if exists(spark, path) else f"{path}.prev")


def note(spark: SparkSession, path: str, event: str, **values) -> None:
    """Append an event to a manifest, a folder of JSON lines; values that are no text are kept as JSON."""
    row = (event, {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in values.items()})
    spark.createDataFrame([row], "event string, values map<string,string>").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(at, event, values) of a manifest."""
    return spark.read.schema("at timestamp, event string, values map<string,string>").json(path)


def back_up(spark: SparkSession, path: str, most: int = 99) -> str | None:
    """Rename what is at ``path`` to ``#name.n#`` beside it with the first free n; the new name, or None if nothing is there."""
    if not exists(spark, path):
        return None
    folder, _, name = path.rstrip("/").rpartition("/")
    for n in range(1, most + 1):
        other = f"{folder}/#{name}.{n}#"
        if not exists(spark, other):
            rename(spark, path, other)
            return other
    raise FileExistsError(f"{path} has {most} backups")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return new_path(spark, label)

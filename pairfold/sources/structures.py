"""Structures: PDB, GRO and CRD files and Amber coordinates, as rows of positions; frames from arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(line: str | Column, start: int | Column, width: int | Column) -> Column:
    """A field of a line, trimmed; columns count from 1."""
    c = F.col(line) if isinstance(line, str) else line
    return F.trim(F.substr(c, F.lit(start) if isinstance(start, int) else start, F.lit(width) if isinstance(width, int) else width))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): a row per file; line ends of any kind."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.split("value", "\r\n|\r|\n").alias("lines"))


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """(file, serial, name, resname, chain, resid, x, y, z): the ATOM and HETATM lines; numbers that do not fit their field are null."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    number = lambda a, n, kind: _at("value", a, n).try_cast(kind)
    return rows.select(
        "file", number(7, 5, "int").alias("serial"), _at("value", 13, 4).alias("name"), _at("value", 18, 3).alias("resname"), _at("value", 22, 1).alias("chain"), number(23, 4, "int").alias("resid"),
        number(31, 8, "double").alias("x"), number(39, 8, "double").alias("y"), number(47, 8, "double").alias("z"),
    )


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(value): ATOM lines of rows with the columns of pdb(); numbers go round in their fields."""
    f = "ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00"
    return atoms.select(F.format_string(f, F.col("serial") % 100_000, "name", "resname", "chain", F.col("resid") % 10_000, *(F.col(a).cast("double") for a in "xyz")).alias("value"))


def gro(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, at, resid, resname, name, x, y, z, vx, vy, vz), (file, title, n, box)) of GRO files of one frame.

    The width of a position is the distance of two decimal points; velocities are null where a line has none.
    """
    files = whole_files(spark, path).select("file", "lines", F.trim(F.col("lines")[1]).cast("int").alias("n"))
    rows = files.select("file", F.posexplode(F.slice("lines", F.lit(3), F.col("n"))).alias("at", "line"))
    rows = rows.withColumn("w", F.expr("locate('.', line, locate('.', line, 21) + 1) - locate('.', line, 21)"))
    place = lambda k: _at("line", F.lit(21) + F.col("w") * k, F.col("w")).try_cast("double")
    atoms = rows.select("file", "at", _at("line", 1, 5).try_cast("int").alias("resid"), _at("line", 6, 5).alias("resname"), _at("line", 11, 5).alias("name"), *(place(k).alias(c) for k, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))))
    box = F.split(F.trim(F.element_at("lines", F.col("n") + 3)), " +").cast("array<double>")
    return atoms, files.select("file", F.col("lines")[0].alias("title"), "n", box.alias("box"))


def gro_files(atoms: DataFrame, system: str, order: str, title: Column, box: list[Column]) -> DataFrame:
    """(<system>, value): the text of a GRO file per system, which has to fit one row."""
    line = F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.col("resid") % 100_000, "resname", "name", F.col(order) % 100_000, *(F.col(a).cast("double") for a in "xyz"))
    listed = atoms.groupBy(system).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"), F.first(title).alias("t"), *(F.first(b).cast("double").alias(f"b{k}") for k, b in enumerate(box)))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    end = F.format_string("%10.5f%10.5f%10.5f", *(F.col(f"b{k}") for k in range(3)))
    return listed.select(system, F.concat_ws("\n", "t", F.format_string("%5d", F.size("l")), body, end).alias("value"))


def crd(spark: SparkSession, path: str) -> DataFrame:
    """(file, serial, resnum, resname, name, x, y, z, segment, resid): CRD files, of the usual or the wide form."""
    files = whole_files(spark, path).select("file", F.filter("lines", lambda x: ~x.startswith("*") & (F.trim(x) != "")).alias("lines"))
    head = F.split(F.trim(F.col("lines")[0]), " +")
    files = files.select("file", "lines", head[0].cast("int").alias("n"), (F.contains(F.col("lines")[0], F.lit("EXT")) | (head[0].cast("int") > 99_999)).alias("wide"))
    rows = files.select("file", "wide", F.explode(F.slice("lines", F.lit(2), F.col("n"))).alias("line"))

    def field(usual: tuple[int, int], wide: tuple[int, int]) -> Column:
        return F.when(F.col("wide"), _at("line", *wide)).otherwise(_at("line", *usual))

    return rows.select(
        "file", field((1, 5), (1, 10)).cast("int").alias("serial"), field((6, 5), (11, 10)).cast("int").alias("resnum"), field((12, 4), (23, 8)).alias("resname"), field((17, 4), (33, 8)).alias("name"),
        *(field((21 + 10 * k, 10), (41 + 20 * k, 20)).cast("double").alias(a) for k, a in enumerate("xyz")), field((52, 4), (103, 8)).alias("segment"), field((57, 4), (113, 8)).alias("resid"),
    )


def amber_coordinates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, at, x, y, z, vx, vy, vz), (file, title, n, time, box)) of Amber coordinate files.

    Numbers stand six to a line in fields of 12; velocities and the cell follow the positions if there are so many numbers.
    """
    files = whole_files(spark, path)
    head = F.split(F.trim(F.col("lines")[1]), " +")
    numbers = F.flatten(F.transform(F.slice("lines", F.lit(3), F.size("lines")), lambda x: F.regexp_extract_all(x, F.lit("(.{1,12})"), F.lit(1))))
    files = files.select("file", F.col("lines")[0].alias("title"), head[0].cast("int").alias("n"), F.get(head, F.lit(1)).cast("double").alias("time"), F.filter(F.transform(numbers, lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull()).alias("v"))
    moving = F.size("v") >= 6 * F.col("n")
    rows = files.withColumn("moving", moving).select("file", "n", "v", "moving", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    place = lambda k: F.get("v", 3 * F.col("at") + k)
    speed = lambda k: F.when(F.col("moving"), F.get("v", 3 * (F.col("n") + F.col("at")) + k))
    atoms = rows.select("file", "at", *(place(k).alias(a) for k, a in enumerate("xyz")), *(speed(k).alias(f"v{a}") for k, a in enumerate("xyz")))
    begin = F.when(moving, 6 * F.col("n")).otherwise(3 * F.col("n"))
    rest = F.slice("v", begin + 1, F.greatest(F.size("v") - begin, F.lit(0)))
    return atoms, files.select("file", "title", "n", "time", F.when(F.size(rest) > 0, rest).alias("box"))


def frames(spark: SparkSession, positions: np.ndarray, axes: str = "xyz", first: int = 0) -> DataFrame:
    """(frame, pid, <axis>...) of an array (frames, rows, axes)."""
    k, n, dims = positions.shape
    if dims != len(axes):
        raise ValueError(f"{dims} numbers per row for {len(axes)} axes")
    flat = positions.reshape(-1, dims).astype(np.float64)
    columns = {"frame": np.repeat(np.arange(first, first + k), n), "pid": np.tile(np.arange(n), k)} | {a: flat[:, j].copy() for j, a in enumerate(axes)}
    return spark.createDataFrame(pa.table(columns))

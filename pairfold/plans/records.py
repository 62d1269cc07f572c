"""Queries of sources and sinks: tables are written in a format and read again."""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
from pyspark.sql import functions as F

from pairfold.functions.scalars import rounded
from pairfold.plans.registry import query, table
from pairfold.sources import records, structures, topologies
from pairfold.streaming import sinks


def _written(spark, lines, label: str, *by: str) -> str:
    """Texts as files in a new folder; a value is a line, or a whole file where ``by`` names it."""
    path = records.scratch(spark, label)
    writer = lines.write.partitionBy(*by) if by else lines.write
    writer.text(path)
    return path


_atoms = """WITH a AS (SELECT s_suppkey AS k, s_nationkey AS s, round(s_acctbal / 100, 3) AS x, (s_suppkey % 7) * 1.5::DOUBLE AS y, -s_nationkey * 0.25::DOUBLE AS z, 'C' || (s_suppkey % 10) AS name, 'R' || (s_nationkey % 9) AS resname FROM supplier)"""


def _atom_table(spark, d):
    k, s = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        k.alias("k"), s.alias("s"), rounded(F.col("s_acctbal") / 100, 3).alias("x"), ((k % 7) * 1.5).alias("y"), (-s * F.lit(0.25)).alias("z"), F.concat(F.lit("C"), (k % 10).cast("string")).alias("name"), F.concat(F.lit("R"), (s % 9).cast("string")).alias("resname")
    )


def _system():
    return F.regexp_extract("file", r"/s=(\d+)/", 1).cast("int").alias("s")


@query(f"{_atoms} SELECT k::INTEGER AS serial, name, resname, 'A' AS chain, s AS resid, x, y, z FROM a")
def source_pdb(spark, d):
    atoms = _atom_table(spark, d).select(F.col("k").alias("serial"), "name", "resname", F.lit("A").alias("chain"), F.col("s").alias("resid"), "x", "y", "z")
    path = _written(spark, structures.pdb_lines(atoms).unionByName(spark.createDataFrame([("REMARK   1",), ("END",)], "value string")), "pdb")
    return structures.pdb(spark, path).select("serial", "name", "resname", "chain", "resid", "x", "y", "z")


@query(f"{_atoms} SELECT s, (row_number() OVER (PARTITION BY s ORDER BY k) - 1)::INTEGER AS at, s AS resid, resname, name, x, y, z, count(*) OVER (PARTITION BY s)::INTEGER AS n, s + 1.5 AS edge FROM a")
def source_gro(spark, d):
    atoms = _atom_table(spark, d).withColumn("resid", F.col("s"))
    edge = (F.col("s") + 1.5).cast("double")
    path = _written(spark, structures.gro_files(atoms, "s", "k", F.concat(F.lit("system "), F.col("s").cast("string")), [edge, edge, edge]), "gro", "s")
    rows, cells = structures.gro(spark, path)
    met = rows.join(cells.select(F.col("file").alias("f"), "n", F.col("box")[0].alias("edge")), F.col("file") == F.col("f"))
    return met.select(_system(), "at", "resid", "resname", "name", "x", "y", "z", "n", "edge")


@query(f"{_atoms} SELECT s, k::INTEGER AS serial, resname, name, x, y, z, 'SEG' AS segment FROM a")
def source_crd(spark, d):
    a = _atom_table(spark, d)
    usual = F.format_string("%5d%5d %-4s %-4s%10.5f%10.5f%10.5f %-4s %-4s%10.5f", F.col("k"), F.col("s"), "resname", "name", "x", F.col("y").cast("double"), "z", F.lit("SEG"), F.col("s").cast("string"), F.lit(0.0))
    wide = F.format_string("%10d%10d  %-8s  %-8s%20.10f%20.10f%20.10f  %-8s  %-8s%20.10f", F.col("k"), F.col("s"), "resname", "name", "x", F.col("y").cast("double"), "z", F.lit("SEG"), F.col("s").cast("string"), F.lit(0.0))
    listed = a.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("s") % 2 == 0, usual).otherwise(wide).alias("line")))).alias("l"))
    head = F.when(F.col("s") % 2 == 0, F.format_string("%5d", F.size("l"))).otherwise(F.format_string("%10d  EXT", F.size("l")))
    text = F.concat_ws("\n", F.lit("* TITLE"), F.lit("*"), head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    path = _written(spark, listed.select("s", text.alias("value")), "crd", "s")
    return structures.crd(spark, path).select(_system(), "serial", "resname", "name", "x", "y", "z", "segment")


@query(f"{_atoms}, o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS pos FROM a) SELECT s, pos::INTEGER AS \"at\", round(x, 3) AS x, y, z, CASE WHEN s % 2 = 0 THEN round(x / 10, 5) ELSE -1 END AS vx, CASE WHEN s % 2 = 0 THEN 30.0 ELSE 0 END::DOUBLE AS edge FROM o")
def source_amber_coordinates(spark, d):
    a = _atom_table(spark, d)
    number = lambda c: F.format_string("%12.7f", F.col(c) if isinstance(c, str) else c)
    listed = a.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", F.array(number("x"), number(F.col("y").cast("double")), number("z")).alias("p"), F.array(number(F.col("x") / 10), number(F.lit(0.0)), number(F.lit(0.0))).alias("v")))).alias("l"))
    place, speed = F.flatten(F.transform("l", lambda x: x["p"])), F.flatten(F.transform("l", lambda x: x["v"]))
    block = lambda v: F.regexp_replace(F.array_join(v, ""), "(.{72})(?=.)", "$1\n")
    box = F.lit("".join(f"{x:12.7f}" for x in (30.0, 30.0, 30.0, 90.0, 90.0, 90.0)))
    even = F.col("s") % 2 == 0
    text = F.concat_ws("\n", F.lit("title"), F.format_string("%6d%15.7e", F.size("l"), F.lit(1.5)), block(place), F.when(even, block(speed)), F.when(even, box))
    path = _written(spark, listed.select("s", text.alias("value")), "rst", "s")
    rows, cells = structures.amber_coordinates(spark, path)
    met = rows.join(cells.select(F.col("file").alias("f"), F.get("box", F.lit(0)).alias("edge")), F.col("file") == F.col("f"))
    return met.select(_system(), "at", F.round("x", 3).alias("x"), "y", "z", F.coalesce(F.round("vx", 5), F.lit(-1.0)).alias("vx"), F.coalesce("edge", F.lit(0.0)).alias("edge"))


def _section(flag: str, form: str, values, a_line: int, width: int):
    """A section of a parameter file from an array of numbers or names in fields."""
    body = F.regexp_replace(F.array_join(values, ""), f"(.{{{a_line * width}}})(?=.)", "$1\n")
    return F.concat_ws("\n", F.rpad(F.lit(f"%FLAG {flag}"), 80, " "), F.rpad(F.lit(f"%FORMAT({form})"), 80, " "), body)


@query(f"{_atoms}, o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS pos FROM a) SELECT s, pos::INTEGER AS \"at\", name, round(x * 18.2223, 2) AS charge, y + 1 AS mass, (pos - 1)::INTEGER AS before FROM o")
def source_amber_topology(spark, d):
    a = _atom_table(spark, d)
    e = lambda c, form="%16.8E": F.format_string(form, c)
    listed = a.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", F.rpad("name", 4, " ").alias("name"), e(F.col("x") * 18.2223, "%24.16E").alias("q"), e(F.col("y").cast("double") + 1).alias("m")))).alias("l"))
    pick = lambda f: F.transform("l", lambda x: x[f])
    bonds = F.when(F.size("l") > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.array(F.format_string("%8d", 3 * (k - 1)), F.format_string("%8d", 3 * k), F.format_string("%8d", F.lit(1)))))).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws("\n", F.lit("%VERSION  VERSION_STAMP = V0001.000"), _section("ATOM_NAME", "20a4", pick("name"), 20, 4), _section("CHARGE", "3E24.16", pick("q"), 3, 24), _section("MASS", "5E16.8", pick("m"), 5, 16), _section("BONDS_WITHOUT_HYDROGEN", "10I8", bonds, 10, 8))
    path = _written(spark, listed.select("s", text.alias("value")), "prmtop", "s")
    sections = topologies.amber_sections(spark, path)
    atoms = topologies.amber_fields(sections, {"name": ("ATOM_NAME", "string"), "charge": ("CHARGE", "double"), "mass": ("MASS", "double")})
    tuples = topologies.amber_tuples(sections, "BONDS_WITHOUT_HYDROGEN", 2).select(F.col("file").alias("f"), "m0", "m1")
    met = atoms.join(tuples, (F.col("file") == F.col("f")) & (F.col("at") == F.col("m1")), "left")
    return met.select(_system(), "at", "name", F.round("charge", 2).alias("charge"), "mass", F.coalesce("m0", F.lit(-1)).alias("before"))


@query(f"{_atoms}, o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) AS pos, count(*) OVER (PARTITION BY s) AS n FROM a) SELECT s, pos::INTEGER AS serial, name, 'T' || (k % 3) AS type, y AS charge, CASE WHEN pos < n THEN pos + 1 ELSE 0 END::INTEGER AS bonded FROM o")
def source_psf(spark, d):
    a = _atom_table(spark, d)
    listed = a.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", "name", "resname", F.col("y").cast("double").alias("y")))).alias("l"))
    line = lambda x, k: F.format_string("%8d %-4s %-4s %-4s %-4s %-4s %14.6f%14.4f %11d", k + 1, F.lit("SEG"), F.lit("1"), x["resname"], x["name"], F.concat(F.lit("T"), (x["k"] % 3).cast("string")), x["y"], F.lit(12.0), F.lit(0))
    ends = F.when(F.size("l") > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.array(F.format_string("%8d", k), F.format_string("%8d", k + 1))))).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws("\n", F.lit("PSF\n\n       1 !NTITLE\n REMARKS none\n"), F.format_string("%8d !NATOM", F.size("l")), F.array_join(F.transform("l", line), "\n"), F.format_string("\n%8d !NBOND: bonds", F.size("l") - 1), F.regexp_replace(F.array_join(ends, ""), "(.{64})(?=.)", "$1\n"), F.lit("\n       0 !NTHETA: angles\n\n"))
    path = _written(spark, listed.select("s", text.alias("value")), "psf", "s")
    sections = topologies.psf(spark, path)
    bonds = topologies.psf_tuples(sections, "NBOND", 2).select(F.col("file").alias("f"), "m0", F.col("m1").alias("bonded"))
    met = topologies.psf_atoms(sections).join(bonds, (F.col("file") == F.col("f")) & (F.col("serial") == F.col("m0")), "left")
    return met.select(_system(), "serial", "name", "type", "charge", F.coalesce("bonded", F.lit(0)).alias("bonded"))


@query("SELECT 'BONDS' AS section, 'A' || least(a, b) || ' A' || greatest(a, b) AS types, CASE WHEN (a + b) % 3 = 0 THEN 999.0 ELSE a * 10 + b END::DOUBLE AS k, 1.5 AS r FROM range(5) p(a), range(5) q(b) WHERE a <= b UNION ALL SELECT 'NONBONDED', 'A' || a, 0.0, -a / 10.0 FROM range(5) p(a)")
def source_charmm_parameters(spark, d):
    first = ["* first", "*", "BONDS", "! a comment"] + [f"A{b} A{a} {a * 10 + b}.0 1.5 ! note" for a in range(5) for b in range(a, 5)] + ["", "NONBONDED nbxmod 5 -", "cutnb 14.0"] + [f"A{a} 0.0 {-a / 10} 2.0" for a in range(5)] + ["END"]
    later = ["bonds"] + [f"A{a} A{b} 999.0 1.5" for a in range(5) for b in range(a, 5) if (a + b) % 3 == 0]
    paths = [_written(spark, spark.createDataFrame([("\n".join(x),)], "value string").coalesce(1), "prm") for x in (first, later)]
    got = topologies.charmm_parameters(spark, paths)
    return got.select("section", F.array_join("types", " ").alias("types"), F.col("values")[0].alias("k"), F.col("values")[1].alias("r"))


@query("""SELECT pid, CASE WHEN pid < 6 THEN 'SOL' WHEN pid < 10 THEN 'ION' ELSE 'SOL' END AS molecule, CASE WHEN pid BETWEEN 6 AND 9 THEN 'NA' WHEN (CASE WHEN pid < 6 THEN pid ELSE pid - 10 END) % 3 = 0 THEN 'OW' ELSE 'HW' || ((CASE WHEN pid < 6 THEN pid ELSE pid - 10 END) % 3) END AS name,
CASE WHEN pid BETWEEN 6 AND 9 THEN 1.0 WHEN (CASE WHEN pid < 6 THEN pid ELSE pid - 10 END) % 3 = 0 THEN -0.8 ELSE 0.4 END::DOUBLE AS charge FROM range(16) t(pid)""")
def source_gromacs_topology(spark, d):
    folder = tempfile.mkdtemp(prefix="spark-top-")
    texts = {
        "ions.itp": "[ moleculetype ]\nION 1\n[ atoms ]\n1 NA 1 NA NA 1 Q_ION 22.99\n",
        "topol.top": '#define Q_ION 1.0\n#ifdef FLEX\n[ broken\n#else\n[ defaults ]\n1 2 yes 0.5 0.8333 ; a comment\n#endif\n#include "ions.itp"\n[ moleculetype ]\nSOL 2\n[ atoms ]\n1 OW 1 SOL OW 1 -0.8 \\\n 16.0\n2 HW 1 SOL HW1 1 0.4 1.0\n3 HW 1 SOL HW2 1 0.4 1.0\n#ifndef NONE\n[ bonds ]\n1 2 1\n#endif\n[ system ]\nwater\n[ molecules ]\nSOL 2\nION 4\nSOL 2\n',
    }
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    topology = topologies.gromacs_topology(spark, os.path.join(folder, "topol.top"))
    shutil.rmtree(folder)
    return topologies.expanded(topology).select("pid", "molecule", "name", "charge")


@query("SELECT name, value FROM (VALUES ('run.steps', '100'), ('run.dt', '0.002'), ('system.files', '[\"a.top\", \"b.gro\"]'), ('title', '\"test\"')) t(name, value)")
def source_control(spark, d):
    with tempfile.NamedTemporaryFile("w", suffix=".toml", delete=False) as f:
        f.write('title = "test"\n[run]\nsteps = 100\ndt = 0.002\n[system]\nfiles = ["a.top", "b.gro"]\n')
    topologies.control(f.name, {"title": str, "run.steps": int, "run.dt": float, "system.files": list})
    got = topologies.control_table(spark, f.name)
    os.unlink(f.name)
    return got


@query("SELECT frame, pid, frame * 100.0 + pid * 3 AS x, frame * 100.0 + pid * 3 + 1 AS y, frame * 100.0 + pid * 3 + 2 AS z FROM range(4) f(frame), range(5) p(pid)")
def source_frames(spark, d):
    positions = np.arange(15, dtype=float).reshape(1, 5, 3) + np.arange(4)[:, None, None] * 100
    return structures.frames(spark, positions)


@query("SELECT o_orderkey AS step, round(CASE WHEN o_orderkey <= 5000 THEN o_totalprice ELSE o_totalprice * 2 END, 6) AS price, o_custkey::DOUBLE AS cust FROM orders")
def columns_continued(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    path = records.scratch(spark, "columns")
    records.write_columns(orders, path, {"price": "EUR"})
    records.continue_columns(orders.withColumn("price", F.col("price") * 2), path, 5000, {"price": "EUR"})
    return records.read_columns(spark, path)


@query("SELECT n_nationkey AS k, n_nationkey * 2 AS now, n_nationkey AS before FROM nation")
def snapshots(spark, d):
    state = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("x"))
    path = records.scratch(spark, "snapshot")
    records.save_snapshot(state, path)
    records.save_snapshot(records.load_snapshot(spark, path).withColumn("x", F.col("x") * 2), path)
    before = spark.read.parquet(f"{path}.prev").select(F.col("k").alias("__k"), F.col("x").alias("before"))
    return records.load_snapshot(spark, path).join(before, F.col("k") == F.col("__k")).select("k", F.col("x").alias("now"), "before")


@query("SELECT event, value FROM (VALUES ('start', 'a'), ('segment', '1'), ('segment', '2'), ('end', '[1, 2]')) t(event, value)")
def run_manifest(spark, d):
    path = records.scratch(spark, "manifest")
    for event, value in (("start", "a"), ("segment", 1), ("segment", 2), ("end", [1, 2])):
        records.note(spark, path, event, value=value)
    return records.manifest(spark, path).select("event", F.col("values")["value"].alias("value"))


@query("SELECT generation, count(*) AS n FROM nation, range(3) t(generation) WHERE n_nationkey >= generation * 10 GROUP BY 1")
def backups(spark, d):
    path = records.scratch(spark, "backed")
    places = []
    for generation in range(3):
        if (moved := records.back_up(spark, path)) is not None:
            places.append(moved)
        table(spark, d, "nation").where(F.col("n_nationkey") >= generation * 10).select(F.lit(generation).cast("long").alias("generation"), "n_nationkey").write.parquet(path)
    return spark.read.parquet(path, *places).groupBy("generation").agg(F.count("*").alias("n"))


@query("SELECT event_id // 2500 AS batch, count(*) AS n, max(event_id) AS last FROM events WHERE event_id <= 7000 GROUP BY 1")
def reported_batches(spark, d):
    """Batches of a stream, one of which comes twice, and a continuation from step 7000."""
    path = records.scratch(spark, "reports")
    write = sinks.resumable(path, lambda batch: batch.select("event_id"))
    events = table(spark, d, "events")
    sinks.written_batches(events, path, F.expr("event_id div 2500"), lambda rows: rows.select("event_id", "batch"))
    write(events.where((F.col("event_id") >= 2500) & (F.col("event_id") < 5000)), 1)
    kept = sinks.continued(spark.read.parquet(path), "event_id", 7000)
    return kept.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT report, count(*) AS n, sum(event_id)::BIGINT AS steps FROM (SELECT 'energy' AS report, event_id FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'frame', event_id FROM events WHERE event_id % 50 = 0) GROUP BY 1")
def reporters(spark, d):
    """Two reports of a stream of the table's rows, each with its own period."""
    paths = {name: records.scratch(spark, name) for name in ("energy", "frame")}
    source, events = records.scratch(spark, "steps"), table(spark, d, "events").select("event_id", "value")
    events.repartition(4).write.parquet(source)
    write = sinks.reporters({paths["energy"]: (10, lambda rows: rows), paths["frame"]: (50, lambda rows: rows.select("event_id"))}, "event_id")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", records.scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    both = [spark.read.parquet(p).select(F.lit(name).alias("report"), "event_id") for name, p in paths.items()]
    return both[0].unionByName(both[1]).groupBy("report").agg(F.count("*").alias("n"), F.sum("event_id").alias("steps"))

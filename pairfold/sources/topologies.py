"""Topologies: Amber parameter files, CHARMM PSF and parameter files, GROMACS topologies, control files."""

from __future__ import annotations

import json
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairfold.operators.collection import scan
from pairfold.sources.structures import whole_files


def amber_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, flag, at, value): the entries of every section, cut by the section's own format, trimmed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("body"))
    sections = files.select("file", F.explode(F.slice(F.split("body", "%FLAG +"), F.lit(2), F.lit(1 << 20))).alias("section"))
    lines = F.split("section", "\n")
    width = F.regexp_extract("section", r"%FORMAT\( *\d+[aAiIeEfF](\d+)", 1)
    rows = sections.select("file", F.trim(lines[0]).alias("flag"), F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: ~x.startswith("%") & (x != "")).alias("lines"), width.alias("w"))
    cut = F.flatten(F.transform("lines", lambda x: F.regexp_extract_all(x, F.concat(F.lit("(.{1,"), F.col("w"), F.lit("})")), F.lit(1))))
    return rows.select("file", "flag", F.posexplode(cut).alias("at", "value")).withColumn("value", F.trim("value"))


def amber_fields(sections: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(file, at, <name>...): sections of one entry per row side by side; ``fields``: the flag and type of each name."""
    named = sections.where(F.col("flag").isin([flag for flag, _ in fields.values()]))
    return named.groupBy("file", "at").agg(*(F.max(F.when(F.col("flag") == flag, F.col("value"))).cast(kind).alias(name) for name, (flag, kind) in fields.items()))


def amber_tuples(sections: DataFrame, flag: str, arity: int) -> DataFrame:
    """(file, at, m0, m1, ..., type): tuples of 0-based members, which the file holds times 3, and their 1-based type.

    A negative member, a mark of improper or repeated torsions, is given by its size and ``marked``.
    """
    rows = sections.where(F.col("flag") == flag).select("file", F.expr(f"at div {arity + 1}").cast("int").alias("at"), (F.col("at") % (arity + 1)).alias("k"), F.col("value").cast("int").alias("v"))
    member = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    marked = F.bool_or((F.col("k") < arity) & (F.col("v") < 0))
    return rows.groupBy("file", "at").agg(*((F.abs(member(k)) / 3).cast("int").alias(f"m{k}") for k in range(arity)), member(arity).alias("type"), marked.alias("marked"))


def psf(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, lines): the sections of PSF files, such as NATOM, NBOND, NTHETA."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("body"))
    parts = files.select("file", F.explode(F.slice(F.split("body", r"\n *\d+(?: +\d+)? +!"), F.lit(2), F.lit(1000))).alias("part"))
    lines = F.split("part", "\n")
    return parts.select("file", F.regexp_extract("part", r"^(\w+)", 1).alias("section"), F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x) != "").alias("lines"))


def psf_atoms(sections: DataFrame) -> DataFrame:
    """(file, serial, segment, resid, resname, name, type, charge, mass)."""
    words = sections.where("section = 'NATOM'").select("file", F.explode("lines").alias("line")).select("file", F.split(F.trim("line"), " +").alias("w"))
    kinds = [("serial", "int"), ("segment", "string"), ("resid", "string"), ("resname", "string"), ("name", "string"), ("type", "string"), ("charge", "double"), ("mass", "double")]
    return words.select("file", *(F.col("w")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)))


def psf_tuples(sections: DataFrame, section: str, arity: int) -> DataFrame:
    """(file, at, m0, m1, ...): the members, 1-based serials, of a section's tuples."""
    numbers = F.flatten(F.transform("lines", lambda x: F.split(F.trim(x), " +").cast("array<int>")))
    rows = sections.where(F.col("section") == section).select("file", numbers.alias("v"))
    each = rows.select("file", "v", F.explode(F.sequence(F.lit(0), F.expr(f"size(v) div {arity} - 1"))).alias("at")).where("at >= 0")
    return each.select("file", "at", *(F.get("v", arity * F.col("at") + k).alias(f"m{k}") for k in range(arity)))


#: Sections of parameter files and the number of types that make up a key.
PARAMETER_KEYS = {"BONDS": 2, "ANGLES": 3, "DIHEDRALS": 4, "IMPROPER": 4, "NONBONDED": 1, "NBFIX": 2}


def charmm_parameters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(section, types, values): the entries of parameter files; of a key in several files the last file's count.

    A key reads alike in both directions. Torsions of several terms stay together: a later file replaces all of them.
    """
    read = [whole_files(spark, p).withColumn("priority", F.lit(k)) for k, p in enumerate(paths)]
    files = read[0]
    for f in read[1:]:
        files = files.unionByName(f)
    lines = files.select("file", "priority", F.posexplode(F.transform("lines", lambda x: F.trim(F.regexp_replace(x, "!.*", "")))).alias("at", "line")).where("line <> '' AND NOT startswith(line, '*')")
    head = F.upper(F.split("line", " +")[0])
    known = F.when(head.isin(*PARAMETER_KEYS, "HBOND", "END", "CMAP", "ATOMS"), head)
    section = F.last(known, ignorenulls=True).over(Window.partitionBy("file", "priority").orderBy("at"))
    rows = lines.withColumn("section", section).where(known.isNull() & F.col("section").isin(*PARAMETER_KEYS) & ~F.col("line").rlike("(?i)^(cutnb|ctofnb)|-$"))
    words = F.split("line", " +")
    size = F.element_at(F.create_map(*[F.lit(x) for item in PARAMETER_KEYS.items() for x in item]), F.col("section"))
    types = F.slice(words, F.lit(1), size)
    forward, back = F.array_join(types, " "), F.array_join(F.reverse(types), " ")
    rows = rows.select("section", "priority", "at", F.split(F.least(forward, back), " ").alias("types"), F.slice(words, size + 1, F.size(words)).cast("array<double>").alias("values"))
    newest = rows.groupBy("section", "types").agg(F.max("priority").alias("__last")).withColumnsRenamed({"section": "__s", "types": "__t"})
    met = rows.join(newest, (F.col("section") == F.col("__s")) & (F.col("types") == F.col("__t")) & (F.col("priority") == F.col("__last")))
    return met.select("section", "types", "values", "at")


def _preprocessed(path: str, defined: dict[str, str], folders: list[str]):
    """Lines of a topology with its includes, conditions and definitions worked off; continued lines are joined."""
    open_: list[bool] = []
    with open(path) as f:
        body = re.sub(r"\\\n", " ", f.read())
    for raw in body.split("\n"):
        line = raw.split(";")[0].strip()
        m = re.match(r"#\s*(\w+)\s*(.*)", line)
        if m and m[1] in ("ifdef", "ifndef"):
            open_.append((m[2].split()[0] in defined) == (m[1] == "ifdef"))
        elif m and m[1] == "else":
            open_[-1] = not open_[-1]
        elif m and m[1] == "endif":
            open_.pop()
        elif not all(open_) or not line:
            continue
        elif m and m[1] == "define":
            name, _, value = m[2].partition(" ")
            defined[name] = value.strip()
        elif m and m[1] == "undef":
            defined.pop(m[2].strip(), None)
        elif m and m[1] == "include":
            name = m[2].strip().strip('"<>')
            found = [p for p in (os.path.join(d, name) for d in (os.path.dirname(path), *folders)) if os.path.exists(p)]
            if not found:
                raise FileNotFoundError(f"{path} includes {name}, which is in none of its folders")
            yield from _preprocessed(found[0], defined, folders)
        elif m:
            raise ValueError(f"{path}: unknown directive {line!r}")
        else:
            yield line if line.startswith("[") else " ".join(defined.get(w, w) for w in line.split())
    if open_:
        raise ValueError(f"{path}: a condition is not closed")


def gromacs_topology(spark: SparkSession, path: str, defines: dict[str, str] | None = None, folders: list[str] = ()) -> DataFrame:
    """(molecule, section, at, fields): the entries of a topology and all that it includes.

    A topology names types and one copy of each molecule, so that it is read where the plan is made; what grows with
    the system, its molecules' copies, is made by expanded().
    """
    rows, section, molecule = [], "", None
    for at, line in enumerate(_preprocessed(path, dict(defines or {}), list(folders))):
        m = re.fullmatch(r"\[\s*(\w+)\s*\]", line)
        if m:
            section = m[1]
            molecule = None if section in ("moleculetype", "system", "molecules") else molecule
            continue
        fields = line.split()
        if section == "moleculetype":
            molecule = fields[0]
        rows.append((molecule, section, at, fields))
    return spark.createDataFrame(rows, "molecule string, section string, at int, fields array<string>")


def expanded(topology: DataFrame) -> DataFrame:
    """(pid, copy, molecule, name, type, resname, charge, mass): the atoms of all copies of all molecules, in the file's order."""
    listed = topology.where("section = 'molecules'").select("at", F.col("fields")[0].alias("of"), F.col("fields")[1].cast("long").alias("copies"))
    atoms = topology.where("section = 'atoms'").select("molecule", F.col("fields")[0].cast("long").alias("nr"), *(F.col("fields")[k].alias(n) for k, n in ((1, "type"), (3, "resname"), (4, "name"))), F.col("fields")[6].cast("double").alias("charge"), F.get("fields", F.lit(7)).cast("double").alias("mass"))
    sizes = atoms.groupBy("molecule").agg(F.count("*").alias("size"), F.min("nr").alias("low"))
    starts = scan(listed.join(sizes, F.col("of") == F.col("molecule")).withColumn("rows", F.col("copies") * F.col("size")), ["at"], "rows", "start").drop("molecule")
    each = starts.where("copies > 0").select("of", "start", "size", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    met = each.join(atoms, F.col("of") == F.col("molecule"))
    return met.select((F.col("start") + F.col("copy") * F.col("size") + F.col("nr") - F.col("low")).alias("pid"), "copy", "molecule", "name", "type", "resname", "charge", "mass")


def control(path: str, fields: dict[str, type] | None = None) -> dict:
    """A control file (TOML). ``fields`` names known entries as dotted paths with their types; others are errors."""
    with open(path, "rb") as f:
        body = f.read().decode()
    try:
        values = tomllib.loads(body)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    for name, value in _entries(values):
        if fields is not None:
            line = next((k for k, x in enumerate(body.split("\n"), 1) if re.match(rf"\s*{re.escape(name.split('.')[-1])}\s*=", x)), 0)
            if name not in fields:
                raise ValueError(f"{path}, line {line}: unknown entry {name}")
            if not isinstance(value, fields[name]) and not (fields[name] is float and isinstance(value, int)):
                raise ValueError(f"{path}, line {line}: {name} takes {fields[name].__name__}")
    return values


def _entries(values: dict, before: str = ""):
    for k, v in values.items():
        if isinstance(v, dict):
            yield from _entries(v, f"{before}{k}.")
        else:
            yield before + k, v


def control_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): the entries of a control file, values as JSON."""
    return spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in _entries(control(path))], "name string, value string")

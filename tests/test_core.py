"""Operators and functions beyond what the catalog's SQL covers: limits, errors, odd rows, streams."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairfold.functions import geometry, masks, scalars
from pairfold.functions.expressions import FUNCTIONS, Expression, derivative, parsed
from pairfold.functions.geometry import Cell
from pairfold.operators import collection, pairs, reduce, series, terms
from pairfold.sources import records, structures, topologies
from pairfold.streaming import refresh, windows


def one(df, *columns):
    return df.select(*columns).first()


# Expressions and selections.


def test_derivatives_are_slopes(spark):
    texts = [f"{n}({ {1: 'x*0.9 + y*0.01', 2: 'x*y, y - x', 3: 'x, x*x, y'}[k] })" for n, (k, _) in FUNCTIONS.items()]
    texts += ["x^y", "x^3", "(x*y)^(x + 1)/y", "x/(x + y)", "-x*-y", "q^2/x; q = x*p; p = sin(x)"]
    at = lambda x: one(spark.createDataFrame([(x, 1.3)], "x double, y double"), *(parsed(t).alias(f"c{k}") for k, t in enumerate(texts)))
    slopes = one(spark.createDataFrame([(0.7, 1.3)], "x double, y double"), *(derivative(t, "x").alias(f"c{k}") for k, t in enumerate(texts)))
    for t, low, high, slope in zip(texts, at(0.7 - 1e-6), at(0.7 + 1e-6), slopes):
        assert slope == pytest.approx((high - low) / 2e-6, rel=1e-5, abs=1e-5), t


def test_grammar(spark):
    row = spark.createDataFrame([(2.0, 3.0)], "x double, lambda double")
    assert one(row, parsed("-x^-2"), parsed("2^x^lambda"), parsed("1 - 2 - lambda"), parsed("+x*-lambda"), parsed("x/0")) == (-0.25, 256.0, -4.0, -6.0, math.inf)
    assert Expression.parse("b*a + c; c = d*a; e = 1").names == ["b", "a", "d"]
    for text in ["x+", "x**2", "a=b", "a; a=a+x", "a; a=b; b=a", "x; q=1; q=2", "[x]", "'a'", "x if y else x", "x.y", "", "x//2"]:
        with pytest.raises(ValueError):
            Expression.parse(text)
    for text in ["foo(x)", "sin(x, x)"]:
        with pytest.raises(ValueError):
            parsed(text)


def test_selections(spark):
    rows = [(g, a, f"R{g}", f"{'CH'[a % 2]}{a}") for g, a in itertools.product(range(1, 5), range(1, 8))]
    df = spark.createDataFrame(rows, "g int, a int, gn string, an string")
    cases = {
        ":1-2@3,H?": lambda g, a, gn, an: g <= 2 and (a == 3 or an[0] != "C" and len(an) == 2), "!:R1 & @3 | (:4)": lambda g, a, gn, an: g != 1 and a == 3 or g == 4, "*": lambda *r: True,
        "!(:R*@*) | @C1": lambda g, a, gn, an: an == "C1", ":2 , 3 & !@1-5": lambda g, a, gn, an: g in (2, 3) and a > 5,
    }
    for text, want in cases.items():
        got = {tuple(r) for r in df.where(masks.parsed(text, ("g", "gn"), ("a", "an"))).collect()}
        assert got == {r for r in rows if want(*r)}, text
    for text in ["", ":", ":5-3", ":0", "a", ":A :B", "(:A", "s1", "s0", ":A &", "@1-", ":1@"]:
        with pytest.raises(ValueError):
            masks.parsed(text, ("g", "gn"), ("a", "an"))


# Functions.


def test_special_functions(spark):
    x = [-30.0, -3.0, -0.4, 0.0, 0.3, 1.7, 2.49, 2.51, 5.0, 26.0, 40.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for v, e, c in df.select("x", scalars.erf("x"), scalars.erfc("x")).collect():
        assert e == pytest.approx(math.erf(v), abs=1e-11) and c == pytest.approx(math.erfc(v), rel=1e-8, abs=1e-300 if v > 26 else 1e-11)

    def gamma(shape, z):  # by small steps
        t = np.linspace(0, z, 400_001)[1:]
        y = np.exp((shape - 1) * np.log(t) - t - math.lgamma(shape))
        return float((y[1:] + y[:-1]).sum() / 2 * (t[1] - t[0])) + float(y[0] * t[0] / shape)

    for shape in (1.5, 4.0, 30.0):
        for v, g in df.where("x >= 0").select("x", scalars.gamma_cdf("x", shape)).collect():
            assert g == pytest.approx(gamma(shape, v) if v else 0.0, abs=1e-5)


def test_prolate_function(spark):
    """The function is its own transform over [-1, 1], up to a factor."""
    c = 6.0
    nodes, weights = np.polynomial.legendre.leggauss(60)
    values = np.array([r[0] for r in spark.createDataFrame([(float(v),) for v in [*nodes, 0.0, 1.5, -2.0]], "x double").select(scalars.prolate("x", c)).collect()])
    assert values[60:].tolist() == pytest.approx([1.0, 0.0, 0.0])
    transformed = np.cos(c * np.outer(nodes, nodes)) @ (weights * values[:60])
    ratio = transformed / values[:60]
    assert np.ptp(ratio) < 1e-8 * abs(ratio).max()


@pytest.mark.parametrize("periodic", [False, True])
def test_splines_of_three_axes(spark, periodic):
    """Through every knot, and along a line of knots the spline of one axis."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4, 5, 6))
    if periodic:
        v[-1], v[:, -1], v[:, :, -1] = v[0], v[:, 0], v[:, :, 0]
    spans = [(0.0, 3.0), (-1.0, 1.0), (2.0, 7.0)]
    points = [(i, -1 + 0.5 * j, 2.0 + k, float(v[i, j, k])) for i, j, k in itertools.product(range(4), range(5), range(6))]
    df = spark.createDataFrame([(float(a), b, c, w) for a, b, c, w in points], "x double, y double, z double, w double")
    assert df.where(F.abs(scalars.spline_grid(["x", "y", "z"], spans, v, periodic) - F.col("w")) > 1e-9).count() == 0
    assert df.where(scalars.tabulated_grid(["x", "y", "z"], spans, v) != F.col("w")).count() == 0
    line = spark.createDataFrame([(2.0 + 5 * k / 37,) for k in range(38)], "z double")
    both = line.select(scalars.spline_grid([F.lit(1.0), F.lit(0.5), "z"], spans, v, periodic), scalars.spline("z", 2.0, 7.0, v[1, 3].tolist(), periodic)).collect()
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in both)


def test_correction_map(spark):
    """A surface over two torsions, at its knots."""
    n = 4
    values = [[float((3 * i + j * j) % 5) for j in range(n)] for i in range(n)]
    rows, want = [], []
    for t, (i, j) in enumerate(itertools.product(range(n), range(n))):
        phi, psi = -math.pi + 2 * math.pi * i / n + 1e-9, -math.pi + 2 * math.pi * j / n + 1e-9
        x = [np.array([1.0, 1.0, 0.0]), np.array([1.0, 0.0, 0.0]), np.zeros(3), np.array([0.0, math.cos(phi), -math.sin(phi)])]
        # The fifth point turns by psi about the line from the third to the fourth one.
        axis = x[3] - x[2]
        p = x[1] - x[2]
        p = p - axis * (p @ axis)
        e = np.cross(axis, p)
        x.append(x[3] + p * math.cos(psi) + e * math.sin(psi))
        rows += [(5 * t + k, *map(float, q)) for k, q in enumerate(x)]
        want.append(values[i][j])
    table = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    maps = spark.createDataFrame([(t, *(5 * t + k for k in range(5))) for t in range(n * n)], "tid long, i long, j long, k long, l long, m long")
    got = {r.tid: r.u for r in terms.correction_map(table, maps, values).collect()}
    assert [got[t] for t in range(n * n)] == pytest.approx(want, abs=1e-6)


def test_nan_and_guards(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, float("nan")), (0.0, 0.0), (-1.0, 0.0)], "a double, b double")
    got = df.select(scalars.minimum("a", "b"), scalars.maximum("a", "b"), scalars.divide("a", "b"), scalars.log("a"), scalars.sqrt("a")).collect()
    assert all(math.isnan(x) for x in [got[0][0], got[0][1], got[1][0], got[2][2], got[3][3], got[3][4]]) and got[3][2] == -math.inf and got[2][3] == -math.inf


def test_exact_sums_of_many_large_values(spark):
    big = spark.range(1000).select(F.lit(4.0e12).alias("v"))
    assert one(big.agg(scalars.exact_sum("v").alias("s")), "s")[0] == 4.0e15
    mixed = spark.range(2000).select(F.when(F.col("id") % 2 == 0, -7.25).otherwise(F.lit(7.25)).alias("v"))
    assert one(mixed.agg(scalars.exact_sum("v").alias("s")), "s")[0] == 0.0
    assert one(spark.createDataFrame([(0.1,), (0.2,), (-0.05,), (None,)], "v double").agg(scalars.exact_sum("v").alias("s")), "s")[0] == 0.25


def test_dihedral_signs(spark):
    for turn in (-3.0, -1.2, 0.0, 0.4, 2.9):
        x = [(1.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, math.cos(turn), math.sin(turn))]
        vectors = [tuple(F.lit(v) for v in p) for p in x]
        assert one(spark.range(1), geometry.dihedral(*vectors))[0] == pytest.approx(-turn, abs=1e-12)


def test_checked_cells(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.5)], "a double, t double")
    assert df.where("t = 0").select(geometry.checked_rectangular([F.col("a")], [F.col("t")])[0].alias("a")).first().a == 1.0
    with pytest.raises(PySparkException):
        df.select(geometry.checked_rectangular([F.col("a")], [F.col("t")])[0]).collect()
    with pytest.raises(ValueError):
        Cell((1.0, -1.0, 1.0))


# Pairs.


@pytest.mark.parametrize("tilts", [(0.0, 0.0, 0.0), (2.0, -1.5, 1.0), (-4.0, 3.9, -3.4)])
def test_pairs_in_cells_equal_all_images(spark, tilts):
    """300 rows against every image of every pair."""
    rng = np.random.default_rng(1)
    cell = Cell((9.0, 8.0, 7.0), tilts)
    lattice = np.array([[9.0, 0, 0], [tilts[0], 8.0, 0], [tilts[1], tilts[2], 7.0]])
    x = rng.uniform(-1, 2, size=(300, 3)) @ lattice
    shifts = np.array(list(itertools.product((-4, -3, -2, -1, 0, 1, 2, 3, 4), repeat=3))) @ lattice
    want = set()
    for i in range(300):
        d = np.linalg.norm((x[i] - x[i + 1 :])[:, None, :] + shifts[None], axis=2).min(axis=1)
        want |= {(i, i + 1 + int(j)) for j in np.flatnonzero(d < 1.5)}
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "k long, x double, y double, z double")
    assert {(r.i, r.j) for r in pairs.range_pairs(df, "k", ["x", "y", "z"], 1.5, cell).collect()} == want
    with pytest.raises(ValueError):
        pairs.range_pairs(df, "k", ["x", "y", "z"], 3.6, cell)


def test_gather_tuples_of_several_places(spark):
    entities = spark.createDataFrame([(k,) for k in range(4)], "k long")
    tuples = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "a long, b long, v double")
    got = reduce.gather_tuples(entities, "k", tuples, {"a": F.col("v"), "b": -F.col("v")}).collect()
    assert sorted(map(tuple, got)) == [(0, 2.0), (1, 1.0), (2, -3.0), (3, 0.0)]


# Collections and series.


def test_places_over_many_partitions(spark):
    rng = random.Random(2)
    v = [rng.randrange(50) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(v)), "k long, v long").repartition(7)
    order = {k: p for p, (_, k) in enumerate(sorted((x, k) for k, x in enumerate(v)))}
    assert {r.k: r.place for r in collection.places(df, ["v", "k"]).collect()} == order
    total, start = 0, {}
    for k in sorted(order, key=order.get):
        start[k] = total
        total += v[k]
    assert {r.k: r.start for r in collection.scan(df, ["v", "k"], "v").collect()} == start
    assert collection.places(df.limit(0), ["k"]).count() == 0


def plain_inefficiency(x, last):
    d = np.array(x) - np.mean(x)
    n, g = len(d), 1.0
    for t in range(1, last):
        c = d[: n - t] @ d[t:] / ((n - t) * np.mean(d * d))
        if c <= 0:
            break
        g += 2 * c * (1 - t / n)
    return max(g, 1.0)


def test_inefficiency_of_long_correlations(spark, monkeypatch):
    """Lags over several blocks, whose size is small here."""
    monkeypatch.setattr(series, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = []
    for group, keep in ((1, 0.97), (2, 0.2)):
        x = 0.0
        for k in range(700):
            x = keep * x + rng.normal()
            rows.append((group, k, float(x)))
    rows += [(3, 0, 1.0), (4, 0, 2.0), (4, 1, 2.0), (4, 2, 2.0), (4, 3, 2.0)]
    df = spark.createDataFrame(rows, "g long, k long, v double")
    got = {r.s: r.g for r in series.inefficiency(df.withColumnRenamed("g", "s"), "s", ["k"], "v").collect()}
    assert [r.s for r in series.correlation_time(df.withColumnRenamed("g", "s"), "s", ["k"], "v").orderBy("s").collect()] == [1, 2, 3, 4]
    for group in (1, 2):
        assert got[group] == pytest.approx(plain_inefficiency([v for g, _, v in rows if g == group], 698), rel=1e-9)
    assert got[3] == got[4] == 1.0


def test_mbar_covariance_and_limits(spark):
    """The difference of two states against the variance that repeated draws show; a fit that may not end."""
    rng = np.random.default_rng(7)

    def draw(n):
        x = np.r_[rng.normal(0, 1, n), rng.normal(0.8, 1, n)]
        return [(int(k >= n), float(v * v / 2), float((v - 0.8) ** 2 / 2 + 1.5)) for k, v in enumerate(x)]

    got = series.mbar(spark.createDataFrame(draw(4000), "state int, u0 double, u1 double"), ["u0", "u1"])
    t = got.covariance
    error = math.sqrt(t[0][0] + t[1][1] - 2 * t[0][1])
    assert got.free_energies[0] == 0 and abs(got.free_energies[1] - 1.5) < 4 * error and 0.005 < error < 0.03
    assert np.array(got.overlap).sum(axis=1) == pytest.approx([1.0, 1.0], abs=1e-6)
    with pytest.raises(RuntimeError):
        series.mbar(spark.createDataFrame(draw(50), "state int, u0 double, u1 double"), ["u0", "u1"], tolerance=0.0, most=3)
    apart = spark.createDataFrame([(1.0,), (2.0,)], "v double"), spark.createDataFrame([(5.0,), (6.0,)], "v double")
    with pytest.raises((RuntimeError, ZeroDivisionError, PySparkException)):
        series.two_state_slope(*apart, "v", most=5)


def test_running_maximum_and_crossing_of_ties(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.0), (1, 3, 4.0), (None, 1, 2.0), (None, 2, 1.0)], "g long, k long, v double")
    got = series.running_maximum(df, "g", ["k"], F.col("v")).select("g", "k", "most").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, 3.0), (1, 2, 5.0), (1, 3, 5.0), (None, 1, 2.0), (None, 2, 2.0)], key=repr)


# Streams.


def test_crossings_of_null_keys(spark):
    rows = [(None, 1, 0.0), (None, 2, 10.0), (None, 3, 60.0), (5, 1, 0.0), (5, 2, 50.0), (5, 3, None), (6, 1, 1.0)]
    df = spark.createDataFrame(rows, "k long, step long, v double")
    got = refresh.crossings(df, "k", ["step"], "v", 40.0).collect()
    assert sorted(((r.k, r.step) for r in got), key=repr) == sorted([(None, 1), (None, 3), (5, 1), (5, 2), (6, 1)], key=repr)


def test_stream_crossings_equal_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(6), k, rng.uniform(0, 100)) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, step long, v double")
    for part in range(3):
        df.where((F.col("step") >= part * 200) & (F.col("step") < (part + 1) * 200)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = refresh.stream_crossings(stream, "k", "step", "v", 30.0).writeStream.format("memory").queryName("crossed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.k, r.step) for r in spark.table("crossed").collect()}
    assert got == {(r.k, r.step) for r in refresh.crossings(df, "k", ["step"], "v", 30.0).collect()}


def test_periods_nest():
    windows.nested(10, 100, 50)
    with pytest.raises(ValueError):
        windows.nested(10, 25)


# Sources and sinks.


def test_continuation_needs_the_same_columns(spark, tmp_path):
    path = str(tmp_path / "columns")
    rows = spark.createDataFrame([(0, 1.5), (1, 2.5)], "step long, a double")
    records.write_columns(rows, path)
    with pytest.raises(ValueError):
        records.continue_columns(rows.withColumnRenamed("a", "b"), path, 0)
    assert sorted(map(tuple, records.read_columns(spark, path).collect())) == [(0, 1.5), (1, 2.5)]


def test_snapshot_after_a_break(spark, tmp_path):
    path = str(tmp_path / "state")
    records.save_snapshot(spark.range(3), path)
    records.save_snapshot(spark.range(5), path)
    (tmp_path / "state").rename(tmp_path / "gone")
    assert records.load_snapshot(spark, path).count() == 3


def test_backups_end(spark, tmp_path):
    path = tmp_path / "out"
    assert records.back_up(spark, str(path)) is None
    for k in range(3):
        path.write_text(str(k))
        if k < 2:
            assert records.back_up(spark, str(path), 2).endswith(f"#out.{k + 1}#")
    with pytest.raises(FileExistsError):
        records.back_up(spark, str(path), 2)


def test_control_files(tmp_path):
    path = tmp_path / "run.toml"
    path.write_text("[run]\nsteps = 10\ndt = 1\n")
    assert topologies.control(str(path), {"run.steps": int, "run.dt": float}) == {"run": {"steps": 10, "dt": 1}}
    with pytest.raises(ValueError, match="line 2: unknown entry"):
        topologies.control(str(path), {"run.dt": float})
    with pytest.raises(ValueError, match="line 2: run.steps takes str"):
        topologies.control(str(path), {"run.steps": str, "run.dt": float})
    path.write_text("[run\n")
    with pytest.raises(ValueError, match="line 1"):
        topologies.control(str(path))


def test_topologies_that_are_wrong(spark, tmp_path):
    for text, error in (('#include "none.itp"\n', FileNotFoundError), ("#ifdef A\n", ValueError), ("#what\n", ValueError)):
        (tmp_path / "t.top").write_text(text)
        with pytest.raises(error):
            topologies.gromacs_topology(spark, str(tmp_path / "t.top"))


def test_pdb_of_odd_lines(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("HEADER\nATOM  *****  CA  ALA A   1      11.000   2.000   3.000\nHETATM    2 FE   HEM B  12    -100.125-200.250-300.500  1.00  0.00\nEND\n")
    got = structures.pdb(spark, str(tmp_path)).orderBy("resid").collect()
    assert [(r.serial, r.name, r.resname, r.chain, r.resid, r.x, r.y, r.z) for r in got] == [(None, "CA", "ALA", "A", 1, 11.0, 2.0, 3.0), (2, "FE", "HEM", "B", 12, -100.125, -200.25, -300.5)]


def test_frames_need_an_axis_per_number(spark):
    with pytest.raises(ValueError):
        structures.frames(spark, np.zeros((2, 3, 2)))

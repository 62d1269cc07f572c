"""Sums over close pairs from their places, and what larger tables bring: equal places, many batches, great keys."""

import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from pairfold.functions.scalars import exact_sum
from pairfold.operators import collection, evaluate, pairs, reduce
from pairfold.plans import algebra, catalog
from pairfold.streaming import sinks

ROWS = [(k, round((k * 7 % 12) * 0.01, 2), k % 3, ("click", "purchase", "view")[k % 3]) for k in range(60)] + [(60, None, 1, "view")]
CUT = 0.055


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "event_id long, value double, user_id long, event_type string")


def close(cut=CUT):
    at = [r for r in ROWS if r[1] is not None]
    return [(a, b) for a, b in itertools.combinations(at, 2) if (a[1] - b[1]) ** 2 < cut * cut]


def test_site_pairs_count_the_pairs_of_rows(events):
    found = pairs.site_pairs(pairs.sites(events, "event_id", ["value"], ["user_id"]), ["value"], CUT, by=["user_id"])
    got = {tuple(r) for r in found.groupBy(F.least("i_user_id", "j_user_id"), F.greatest("i_user_id", "j_user_id")).agg(F.sum("pairs")).collect()}
    want: dict = {}
    for a, b in close():
        kinds = tuple(sorted((a[2], b[2])))
        want[kinds] = want.get(kinds, 0) + 1
    assert got == {(*k, n) for k, n in want.items()}
    assert found.count() < len(close()) / 2


def test_first_of_pairs(events):
    places = pairs.sites(events, "event_id", ["value"])
    found = pairs.site_pairs(places, ["value"], CUT)
    first = pairs.first_of_pairs(found, pairs.at_sites(events, places, ["value"]), "event_id").groupBy("event_id").agg(F.sum("later"), F.sum("keys"))
    want: dict = {}
    for a, b in close():
        n, s = want.get(a[0], (0, 0))
        want[a[0]] = (n + 1, s + b[0])
    assert {r[0]: (r[1], r[2]) for r in first.collect()} == want


def test_gather_sites_is_gather_pairs(events):
    kernel = {"total": F.lit(1.0) - F.col("r"), "n": F.lit(1).cast("long")}
    found = pairs.range_pairs(events, "event_id", ["value"], CUT)
    want = reduce.gather_pairs(events, "event_id", found, ["dvalue"], **kernel)
    got = reduce.gather_sites(events, "event_id", ["value"], CUT, **kernel)
    rows = lambda t: sorted((r[0], round(r[1], 9), r[2]) for r in t.collect())
    assert rows(got) == rows(want) and rows(got)[60] == (60, 0.0, 0)


def test_triplet_counts_are_those_of_triplets(events):
    listed = pairs.triplets(pairs.range_pairs(events, "event_id", ["value"], CUT), 0.015).groupBy("i").count()
    assert sorted(map(tuple, pairs.triplet_counts(events, "event_id", ["value"], 0.015).collect())) == sorted(map(tuple, listed.collect()))


def test_exact_sum_with_times(spark):
    t = spark.createDataFrame([(0.1234567, 3), (-2.5, 2)], "x double, n long")
    assert t.agg(exact_sum("x", times=F.col("n"))).first()[0] == pytest.approx(3 * 0.123457 - 5.0, abs=1e-12)


@pytest.mark.parametrize("name", ["kind_pair_segments", "pair_sum_kernel", "pair_gather_kernel", "symmetric_vs_directed", "triplets_events", "kind_pairs_ordered", "kind_pairs_anchored", "lj_truncations", "lj_pair_energy", "coulomb_energies", "screened_energies", "softened_energies"])
def test_queries_join_places_and_not_rows(spark, tmp_path, events, name):
    """Copies of the rows multiply the pairs of rows; the join on bins sees as many places as before."""
    many = events.where("value IS NOT NULL").crossJoin(spark.range(20)).select((F.col("event_id") + 60 * F.col("id")).alias("event_id"), "value", "user_id", "event_type")
    many.write.parquet(f"{tmp_path}/events.parquet")
    met = catalog.QUERIES[name](spark, str(tmp_path))
    met.collect()
    assert "site" in met._jdf.queryExecution().analyzed().toString()


def test_forces_at_one_place_are_nan(spark):
    t = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.02), (3, 9.0)], "k long, x double")
    found = pairs.range_pairs(t, "k", ["x"], CUT)
    got = dict(map(tuple, evaluate.pair_forces(t, "k", found, "k/2*(c - r)^2", {"k": 5.0, "c": CUT}, ["x"]).collect()))
    assert math.isnan(got[0]) and math.isnan(got[1]) and got[2] == pytest.approx(2 * 5 * (CUT - 0.02)) and got[3] == 0
    assert math.isnan(evaluate.pair_virial(found, "k/2*(c - r)^2", {"k": 5.0, "c": CUT}, ["x"]).first()[0])


def test_written_batches_replace_themselves(spark, tmp_path):
    path = f"{tmp_path}/batches"
    sinks.written_batches(spark.range(1000), path, F.expr("id div 10"))
    sinks.written_batches(spark.range(10, 15), path, F.expr("id div 10"))
    sinks.resumable(path)(spark.range(20, 23), 2)
    counts = dict(map(tuple, spark.read.parquet(path).groupBy("batch").count().collect()))
    assert counts == {k: {1: 5, 2: 3}.get(k, 10) for k in range(100)}


def test_sort_by_key_without_a_number_of_bins(spark):
    t = spark.createDataFrame([(12_000,), (3,), (10_000,)], "b long")
    assert sorted(map(tuple, collection.sort_by_key(t, F.col("b"), None, ["b"]).select("b", "place").collect())) == [(3, 0), (10_000, 1), (12_000, 2)]


def test_sorted_lines_keep_every_supplier(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(50)
    lines.withColumn("l_suppkey", F.col("l_suppkey") + 10_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalog.QUERIES["sort_by_key_bins"](spark, str(tmp_path)).count() == 50


def test_charges_keep_the_digits_of_the_sql(spark, tmp_path):
    """Balances whose quotient or charge is next to a half of its last digit."""
    balances = [-818.85, -814.35] + [round((i * 7919 % 1099999 - 99999) / 100, 2) for i in range(12_000)]
    spark.createDataFrame([(k, 0, b) for k, b in enumerate(balances)], "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = {(r[1], r[3]) for r in con.execute(catalog.ORACLES["source_amber_topology"]).fetchall()}
    assert {(r["at"], r["charge"]) for r in catalog.QUERIES["source_amber_topology"](spark, str(tmp_path)).collect()} == want


def test_born_radii_take_what_comes_along_with_the_pairs(spark):
    from pairfold.operators import terms

    t = spark.createDataFrame([(k, 0.03 * k, 0.01 * (k % 3), 0.0, 0.012 + 0.002 * (k % 2), 0.01) for k in range(20)], "pid long, x double, y double, z double, rho double, scaled double")
    joined = terms.born_radii(t, "pid", pairs.range_pairs(t, "pid", ["x", "y", "z"], 0.1))
    met = terms.born_radii(t, "pid", pairs.range_pairs(t, "pid", ["x", "y", "z"], 0.1, carry=["rho", "scaled"]))
    assert {r[0]: round(r[1], 12) for r in met.collect()} == {r[0]: round(r[1], 12) for r in joined.collect()}


def test_candidates_are_dealt_over_partitions(spark):
    """A small table is read by one task; its candidates are not."""
    t = spark.range(2000).coalesce(1).select("id", (F.col("id") % 97 / 97.0).alias("x"))
    found = pairs.range_pairs(t, "id", ["x"], 0.02)
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def odd_events(spark):
    """Copies at one place, a repeated key, null keys, and values that are null or not finite."""
    odd = [(60, None, 1, "view"), (61, math.nan, 1, "view"), (62, math.nan, 2, "click"), (63, math.inf, 1, "purchase"), (64, math.inf, 2, "view"), (65, -0.0, 1, "click"), (66, 0.0, None, "purchase"), (5, 0.02, 2, "click"), (5, 0.0, 1, "view"), (None, 0.0, 1, "view")]
    return spark.createDataFrame(ROWS[:60] + odd, "event_id long, value double, user_id long, event_type string")


def pairs_in_sql(frame, query):
    con = duckdb.connect()
    con.register("frame", frame.toPandas().assign(event_id=lambda t: t.event_id.astype("Int64"), user_id=lambda t: t.user_id.astype("Int64")))
    # toPandas makes NaN of null values; only row 60 has a null.
    con.execute("CREATE VIEW events AS SELECT event_id, CASE WHEN event_id = 60 THEN NULL ELSE value END AS value, user_id, event_type FROM frame")
    return sorted(con.execute(catalog.ORACLES[query]).fetchall())


@pytest.mark.parametrize("rows", [3, 1024])
@pytest.mark.parametrize("name", ["range_pairs_value", "pairs_excluding", "pairs_without_listed", "pairs_groups"])
def test_listed_pairs_of_odd_rows_equal_their_sql(spark, tmp_path, monkeypatch, name, rows):
    monkeypatch.setattr(pairs, "PLACE_ROWS", rows)
    odd_events(spark).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == pairs_in_sql(odd_events(spark), name)


@pytest.mark.parametrize("name", ["range_pairs_value", "range_pairs_periodic", "pairs_excluding", "pairs_without_listed", "pairs_groups"])
def test_listed_pairs_join_places_and_shuffle_no_pairs(spark, tmp_path, events, name):
    """Whatever is exchanged or joined on bins has rows of places and not of pairs: 40 copies of 60 rows make 1.2 million pairs."""
    many = events.where("value IS NOT NULL").crossJoin(spark.range(40)).select((F.col("event_id") + 60 * F.col("id")).alias("event_id"), "value", "user_id", "event_type", F.timestamp_seconds(F.col("value") * 100).alias("ts"))
    many.write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert found.count() > 100_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__rows" in plan and plan.index("explode(") < plan.index("Join ")  # pairs are made above the join
    assert "LeftAnti" not in plan


def test_exclusions_of_a_hub_are_held_by_the_others(spark):
    t = spark.range(200).select("id", (F.col("id") * 0.0).alias("x"))
    hub = spark.range(1, 200).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"))
    held = pairs.with_exclusions(t, "id", hub, "gone")
    assert held.agg(F.max(F.size("gone"))).first()[0] <= math.sqrt(2 * 199)
    found = pairs.listed_pairs(t, "id", ["x"], CUT, excluded=hub.select(F.col("j").alias("i"), F.col("i").alias("j")))
    assert found.count() == 199 * 198 // 2 and found.where("i = 0").count() == 0


def test_guarded_arithmetic_of_odd_lines_equals_its_sql(spark, tmp_path):
    odd = [None, math.nan, math.inf, 0.0, -0.0, 0.01, 0.08, 0.123456789]
    rows = [(k, 1, 1, 1, tax, discount) for k, (tax, discount) in enumerate(itertools.product(odd, odd))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_tax double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    plain = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert plain(map(tuple, catalog.QUERIES["guarded_arithmetic"](spark, str(tmp_path)).collect())) == plain(con.execute(catalog.ORACLES["guarded_arithmetic"]).fetchall())


@pytest.mark.parametrize("name", ["range_pairs_value", "range_pairs_periodic", "pairs_excluding", "pairs_without_listed", "pairs_groups"])
def test_two_blocks_make_few_pairs_at_a_time(spark, tmp_path, monkeypatch, events, name):
    """What meets in the join makes all its pairs before any is passed on: they are to stay few, however many rows are at a place."""
    many = events.where("value IS NOT NULL").crossJoin(spark.range(400)).select((F.col("event_id") + 60 * F.col("id")).alias("event_id"), "value", "user_id", "event_type", F.timestamp_seconds(F.col("value") * 100).alias("ts"))
    many.write.parquet(f"{tmp_path}/events.parquet")
    met, joined = [], pairs.range_pairs
    monkeypatch.setattr(pairs, "range_pairs", lambda blocks, *more: met.append(blocks) or joined(blocks, *more))
    catalog.QUERIES[name](spark, str(tmp_path))
    largest, rows = met[0].agg(F.max(F.size("__rows")), F.sum(F.size("__rows"))).first()
    assert rows == 24_000 and largest**2 <= 4096


@pytest.mark.parametrize("name", ["pair_forces", "pair_virial"])
@pytest.mark.parametrize("odd", [[], [(60, None), (61, math.nan), (62, math.inf), (5, 0.3), (5, 0.02), (7, 0.11), (7, 0.11), (None, 0.4), (63, -0.02), (64, -0.5)], [(1_000_000, 0.5), (1_100_000, 0.49)]])
def test_soft_sums_of_odd_rows_equal_their_sql(spark, tmp_path, name, odd):
    """Repeated and null keys, values that are null or not finite or below 0, and two rows of one x."""
    rows = [(k, round((k * 7 % 97) * 0.013, 3)) for k in range(60)] + odd
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    plain = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert plain(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == plain(con.execute(catalog.ORACLES[name]).fetchall())


def test_soft_sums_grow_with_rows_and_not_with_pairs(spark, tmp_path):
    """20,000 rows within a cutoff are 200 million pairs; what is joined, exchanged or added up is four parts a row at most."""
    t = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 1e-6).alias("x"))
    parts = pairs.near_sums(t, "k", "x", CUT)
    assert parts.count() <= 4 * 20_000
    both = parts.agg(F.sum("n"), F.sum("r"), F.sum("r2")).first()
    d = [(k, 20_000 - k) for k in range(1, 20_000)]
    assert both[0] == 2 * sum(n for _, n in d)
    assert both[1] == pytest.approx(2e-6 * sum(k * n for k, n in d), rel=1e-12) and both[2] == pytest.approx(2e-12 * sum(k * k * n for k, n in d), rel=1e-9)
    t.select(F.col("k").alias("event_id"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("pair_forces", "pair_virial"):
        assert "__own" not in catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()  # no pairs of range_pairs()


@pytest.mark.parametrize("rows", [1, 3, 64])
def test_pairs_of_bins_in_blocks_are_those_of_rows(spark, monkeypatch, rows):
    from pairfold.functions.geometry import Cell

    monkeypatch.setattr(pairs, "BIN_ROWS", rows)
    t = spark.createDataFrame([(k, (k * 37 % 101) / 101.0 if k != 9 else None, (k * 59 % 103) / 103.0, (k * 83 % 107) / 107.0, k % 3) for k in range(150)], "k long, x double, y double, z double, m long")
    for cell in (None, Cell((1.0, 0.4, 1.0)), Cell((1.0, 1.0, 1.0), (0.2, -0.1, 0.1))):
        more = {"carry": ["m"], "left": F.col("m") < 2, "right": F.col("m") > 0}
        found = [sorted(map(tuple, pairs.range_pairs(t, "k", ["x", "y", "z"], 0.2, cell, **more, together=flag).collect())) for flag in (False, True)]
        assert found[0] == found[1] and len(found[0]) > 50


@pytest.mark.parametrize("name", ["born_radii", "born_energy"])
def test_born_queries_with_shared_places_equal_their_sql(spark, tmp_path, name):
    """Keys a whole period of the places (101 * 103 * 107) apart, of the same and of other radii: their sites are joined, not their rows."""
    rows = [(k + 1_113_121 * c, (k % 3 if c < 3 else k % 2) + 1, 1.0) for k in range(60) for c in range(5)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    plain = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert plain(map(tuple, found.collect())) == plain(con.execute(catalog.ORACLES[name]).fetchall())
    places = algebra._solute(spark, str(tmp_path))[1]
    assert places.count() < 60 * 3 + 1


@pytest.mark.parametrize("rows", [1, 7, 256])
def test_block_sums_are_those_of_listed_pairs(spark, monkeypatch, rows):
    """For great tables: sums over pairs in few dimensions without a row a pair; null and odd places have no part."""
    from pairfold.operators import terms

    monkeypatch.setattr(pairs, "SUM_ROWS", rows)
    odd = {7: None, 8: math.nan, 9: math.inf}
    t = spark.createDataFrame([(k, odd.get(k, (k * 37 % 101) / 101.0), (k * 59 % 103) / 103.0, (k * 83 % 107) / 107.0, 0.012 + 0.002 * (k % 3), 0.02) for k in range(400)], "pid long, x double, y double, z double, rho double, scaled double")
    listed = terms.born_screened(t, "pid", pairs.range_pairs(t, "pid", ["x", "y", "z"], 0.15))
    met = terms.born_screened_near(t, "pid", ["x", "y", "z"], 0.15)
    assert {r[0]: round(r[1], 9) for r in met.collect()} == {r[0]: round(r[1], 9) for r in listed.collect()}


@pytest.mark.parametrize("name", ["born_radii", "born_energy"])
def test_born_queries_hand_on_sums_and_not_pairs(spark, name):
    """No row of a pair leaves a task: what is summed up in exchanges comes from blocks."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "__key1" not in plan

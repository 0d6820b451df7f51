"""Scenario column, joint ranks, sums in fixed point, summary sets and source order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from supplyloom.catalogue import frames as A, relational as Q
from supplyloom.catalogue.registry import Tables
from supplyloom.functions.nulls import fixed_mean, fixed_sum
from supplyloom.operators import aggregates, joins, ranking
from supplyloom.plans import production as R, reports, scenarios, sweeps
from supplyloom.sources import delimited, storage

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(monkeypatch):
    """Labels of the stage tables that are written."""
    labels = []

    def counting(df, label="stage"):
        made = storage.settle(df, label)
        if made is not df:
            labels.append(label)
        return made

    def observing(df, label="stage"):
        made, n_rows = storage.settle_counted(df, label)
        if made is not df:
            labels.append(label)
        return made, n_rows

    import sys

    for name, module in list(sys.modules.items()):
        if name.startswith("supplyloom.") and hasattr(module, "settle_counted") and module is not storage:
            monkeypatch.setattr(module, "settle_counted", observing)
        if name.startswith("supplyloom.") and hasattr(module, "settle_together") and module is not storage:
            monkeypatch.setattr(module, "settle_together", lambda *tables: [counting(*x) for x in tables])
        if name.startswith("supplyloom.") and getattr(module, "settle", None) is storage.settle and module is not storage:
            monkeypatch.setattr(module, "settle", counting)
    return labels


# ---- scenario as a column ------------------------------------------------------

CATCH = "fishing_entity string, iso3c string, year int, genus_cat string, scientific_name string, common_name string, sector_type string, end_use_name string, catch double"


def catch_rows(table):
    at = ("Chile", "CHL", 2019, "Crustaceans", "krill", "krill")
    return table(CATCH, [
        (*at, "Artisanal", None, 5.0), (*at, "Artisanal", "Food", -1.0), (*at, "Artisanal", "Other", 9.0),
        (*at, "Industrial", None, 2.0), (*at, "Industrial", None, None), (*at, "Subsistence", None, 3.0),
        (*at, "Subsistence", None, None), (*at, None, None, 4.0),
    ])


def test_scenario_split_equals_splits_of_their_own(table, stored):
    catch = catch_rows(table)
    traded, retained = scenarios.scenario_split(catch)
    assert stored == ["catch"]
    for name, sectors in scenarios.RETENTION.items():
        own_traded, own_retained = R.traded_and_retained(catch, sectors)
        mine = lambda df: df.filter(F.col("scenario") == name).drop("scenario")
        assert rows(mine(traded)) == rows(own_traded)
        assert rows(mine(retained)) == rows(own_retained.dropna(subset=["pred_consumption"]))


def test_scenarios_in_one_run_equal_runs_of_their_own(spark, stored):
    src = A.sources(Tables(spark, FOLDER))
    names = ["iso3c", "nutrient", "pop", "SSF", "total", "perc_SSF", "perc_SSF_ASF"]

    def compact(df):
        close = [F.format_string("%.8e", c).alias(c) if c not in ("iso3c", "nutrient") else F.col(c) for c in names]
        return rows(df.select(*close))

    both = scenarios.scenario_shares(src, years=Q.years(), group_codes=[A.ANCHOR])
    together = len(stored)
    shares = storage.settle(both, "both")
    for name, sectors in scenarios.RETENTION.items():
        before = len(stored)
        own = sweeps.percent_supply(src, sectors, Q.years(), group_codes=[A.ANCHOR])
        assert compact(shares.filter(F.col("scenario") == name)) == compact(own)
        # Two scenarios store no more tables than one.
        assert together <= len(stored) - before
    assert {r[0] for r in shares.select("scenario").distinct().collect()} == set(scenarios.RETENTION)


def test_scenarios_read_each_source_once(spark, stored):
    src = A.sources(Tables(spark, FOLDER))
    scenarios.scenario_consumption(src, years=Q.years())
    assert sorted(stored) == ["balance", "catch", "production"]


def test_scenario_score_ranks_within_the_baseline(table):
    shares = table(
        "scenario string, iso3c string, nutrient string, perc_SSF double",
        [(s, c, n, v * (2 if s == "retained" else 1)) for s in ("traded", "retained") for c, v in zip("ABCD", (1.0, 2.0, 3.0, None)) for n in ("x", "y") if v] + [("retained", "D", "x", None)],
    )
    intake = table("iso3 string, intake double", [("A", 10.0), ("B", 20.0), ("C", None)])
    got = {r.iso3c: (r.scenario, r.perc_SSF, r.q_SSF, r.category) for r in scenarios.scenario_score(shares, intake).collect()}
    # Twice the share: 2, 4 and 6 within 1, 2 and 3.
    assert got["A"][:3] == ("retained", 2.0, pytest.approx(2 / 3)) and got["B"][2] == got["C"][2] == 1.0
    assert got["D"][1:] == (None, None, None) and got["C"][3] is None


def test_one_food_table_serves_two_runs(spark, stored):
    food = storage.settle(Q.food(Tables(spark, FOLDER)), "food")
    before = len(stored)
    sweeps.retention_scenario(A.sources(Tables(spark, FOLDER)), years=Q.years(), group_codes=[A.ANCHOR], food=food)
    assert "food" not in stored[before:]


# ---- several distributions in one exchange -------------------------------------


def plain_rank(values, population):
    known = sorted(v for v in population if v is not None and not math.isnan(v))
    return [None if v is None or math.isnan(v) or not known else sum(p <= v for p in known) / len(known) for v in values]


@pytest.mark.parametrize("per_bucket", [None, 3, 1])
def test_ranks_with_ties_nulls_and_other_populations(table, stored, per_bucket):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, float("nan"), 0.0, -0.0, 1.0, 1.0, 2.5, rng.random() * 4])
    scored = [(i, pick(), pick()) for i in range(60)]
    reference = [(pick(),) for _ in range(80)]
    df = table("id int, a double, b double", scored).repartition(5)
    got = ranking.ecdf_ranks(
        df, [ranking.Rank("a", "qa"), ranking.Rank("b", "qb", table("v double", reference), "v")], per_bucket
    )
    qa = plain_rank([r[1] for r in scored], [r[1] for r in scored])
    qb = plain_rank([r[2] for r in scored], [r[0] for r in reference])
    assert [(r.id, r.qa, r.qb) for r in got.orderBy("id").collect()] == [(i, x, y) for i, (x, y) in enumerate(zip(qa, qb))]
    # The distributions of both are one stored table.
    assert stored == (["distribution"] if per_bucket is None else ["counts", "distribution"])


def test_ranks_of_empty_tables(table):
    none = table("id int, a double", [])
    some = table("id int, a double", [(1, 2.0), (2, None)])
    assert ranking.ecdf_ranks(none, [ranking.Rank("a", "q")]).count() == 0
    assert [r.q for r in ranking.ecdf_ranks(some, [ranking.Rank("a", "q", none)]).collect()] == [None, None]


def test_two_ranks_share_one_range_exchange(table):
    df = table("id int, a double, b double", [(1, 2.0, 3.0)])
    points = ranking._points(df, ranking.Rank("a", "x")).unionByName(ranking._points(df, ranking.Rank("b", "y")))
    ranged = points.groupBy("_m", "_v").agg(F.sum("_w").alias("_w")).repartitionByRange("_m", "_v")
    assert plan(ranged).count("rangepartitioning") == 1


# ---- sums in fixed point -------------------------------------------------------


def test_fixed_sums_have_the_same_bits_in_any_order(spark, table):
    rng = random.Random(5)
    made = [(g, rng.choice([0.1, 0.7, 1 / 3, rng.random() * 100])) for g in range(3) for _ in range(400)]
    df = table("g int, x double", made)
    bits, plain = set(), set()
    for n in (1, 7, 211):
        dealt = df.repartition(n).sortWithinPartitions(F.rand(n))
        got = dealt.groupBy("g").agg(fixed_sum("x").alias("s"), fixed_mean("x").alias("m"), F.sum("x").alias("p"))
        found = got.orderBy("g").collect()
        bits.add(tuple((r.s.hex(), r.m.hex()) for r in found))
        plain.add(tuple(r.p.hex() for r in found))
    assert len(bits) == 1 and len(plain) > 1
    for r in found:
        assert r.s == pytest.approx(math.fsum(x for g, x in made if g == r.g), abs=1e-9)


def test_fixed_means_of_nulls_ties_and_large_values(table):
    df = table("g string, x double", [("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.3), ("b", 0.1), ("b", 0.2), ("c", None), ("d", float("nan")), ("d", 4.0), ("e", -2e9), ("e", 2e9)])
    got = {r.g: r.m for r in df.groupBy("g").agg(fixed_mean("x").alias("m")).collect()}
    assert got["a"] == got["b"] == pytest.approx(0.2) and got["c"] is None and got["d"] == 4.0 and got["e"] == 0.0
    assert df.filter("g = 'z'").agg(fixed_mean("x").alias("m")).first().m is None
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        table("x double", [(1e20,)]).agg(fixed_sum("x")).collect()


def test_classes_do_not_depend_on_the_partitioning(table):
    rng = random.Random(2)
    cells = [0.1, 0.2, 0.7, 1.3, 33.3]
    shares = []
    for c in range(40):
        own = [rng.choice(cells) for _ in range(6)]
        for k in (2 * c, 2 * c + 1):  # pairs of countries whose means are equal
            shares += [(f"C{k}", n, x) for n, x in zip("abcdef", rng.sample(own, 6))]
    intake = [(f"C{k}", "n", float(k // 2 % 9)) for k in range(80)]
    found = set()
    for n in (1, 7, 211):
        means = reports.country_mean_share(table("iso3c string, nutrient string, perc_SSF double", shares).repartition(n))
        known = aggregates.intake_summary(table("iso3 string, nutrient string, perc_deficient double", intake).repartition(n), with_band=False)
        got = {r.iso3c: (r.perc_SSF.hex(), r.q_SSF, r.q_intake, r.category) for r in reports.vulnerability_class(means, known).collect()}
        assert all(got[f"C{2 * c}"][:2] == got[f"C{2 * c + 1}"][:2] for c in range(40))
        found.add(tuple(sorted(got.items())))
    assert len(found) == 1


# ---- summary sets --------------------------------------------------------------


def test_summary_sets(table):
    df = table(
        "region string, nutrient string, x double, y double",
        [("r", "a", 1.0, 1.0), ("r", "b", 3.0, None), (None, "a", 5.0, float("nan")), (None, "a", None, 2.0)],
    )
    got = {(r.level, r.region, r.nutrient): r for r in aggregates.summary_sets(df, [[], ["region"], ["nutrient"], ["region", "nutrient"]], ["x", "y"]).collect()}
    assert len(got) == 1 + 2 + 2 + 3
    whole = got["overall", None, None]
    assert (whole.n, whole.x, whole.strict_x, whole.min_x, whole.max_x, whole.y) == (4, 3.0, None, 1.0, 5.0, 1.5)
    assert got["region", "r", None].strict_x == 2.0 and got["region", "r", None].strict_y is None
    # A null region is a group of its own, told apart from the whole table by its level.
    assert got["region", None, None].x == 5.0 and got["region", None, None].n == 2
    assert got["region+nutrient", None, "a"].y == 2.0


def test_summary_sets_of_an_empty_table(table):
    none = table("g string, x double", [])
    for sets in ([[], ["g"]], [[]]):
        assert aggregates.summary_sets(none, sets, ["x"]).count() == 0
    whole = aggregates.summary_sets(table("g string, x double", [(None, 2.0)]), [[]], ["x"])
    assert [(r.level, r.n, r.x) for r in whole.collect()] == [("overall", 1, 2.0)]


def test_summary_sets_scan_and_aggregate_once(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    made = aggregates.summary_sets(lines, [[], ["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], ["l_tax"])
    text = plan(made)
    assert text.count("FileScan") == 1 and text.count("Expand") == 1 and text.count("Exchange hashpartitioning") == 1


# ---- source order --------------------------------------------------------------


def test_rows_sorted_for_the_first_in_source_hold_no_paths(spark, tmp_path):
    folder = tmp_path / "some files%20ä"
    folder.mkdir()
    for name, some in (("b 2.csv", "k,y,3\nm,,4\n"), ("a.csv", "k,x,1\nk,z,2\n,w,9\n")):
        (folder / name).write_text("key,text,n\n" + some)
    scan = delimited.csv_scan(spark, str(folder), "key string, text string, n int")
    made = joins.first_in_source(scan, ["key"])
    assert made.columns == scan.columns
    assert rows(made) == [(None, "w", 9), ("k", "x", 1), ("m", None, 4)]
    sorts = [line for line in plan(made).splitlines() if "SortAggregate" in line]
    assert sorts and not any("_file" in line or "file_path" in line for line in sorts)


def test_first_row_of_a_file_that_several_tasks_read(spark, tmp_path):
    rng = random.Random(9)
    lines = [(rng.choice("abcdefgh"), k, "x" * rng.randint(0, 60)) for k in range(5_000)]
    for name, some in (("one.csv", lines[:4_000]), ("two.csv", lines[4_000:])):
        (tmp_path / name).write_text("key,n,pad\n" + "".join(f"{k},{n},{p}\n" for k, n, p in some))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = delimited.csv_scan(spark, str(tmp_path), "key string, n int, pad string")
        assert scan.rdd.getNumPartitions() > 5
        placed = delimited.with_source_order(scan).orderBy(*delimited.SOURCE_ORDER)
        assert [r.n for r in placed.select("n").collect()] == list(range(5_000))
        got = {r.key: r.n for r in joins.first_in_source(scan, ["key"]).collect()}
        # A filter between the scan and the order changes which rows there are, not their order.
        later = {r.key: r.n for r in joins.first_in_source(scan.filter("n >= 3900"), ["key"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, after = {}, {}
    for key, n, _ in lines:
        want.setdefault(key, n)
        if n >= 3_900:
            after.setdefault(key, n)
    assert got == want and later == after


def test_first_match_takes_the_first_line(spark, table, tmp_path):
    (tmp_path / "f.csv").write_text("iso3c,tonnes\nB,9\nA,3\nA,1\nB,2\n")
    flows = delimited.with_source_order(delimited.csv_scan(spark, str(tmp_path / "f.csv"), "iso3c string, tonnes double"))
    got = joins.first_match_lookup(table("iso3c string", [("A",), ("B",), ("C",)]), flows, ["iso3c"], delimited.SOURCE_ORDER, "tonnes", "export")
    assert rows(got) == [("A", 3.0), ("B", 9.0), ("C", None)]


def test_tables_settle_together_and_errors_are_raised(table):
    a, b = storage.settle_together((table("x int", [(1,)]), "a"), (table("x int", [(2,)]), "b"))
    assert rows(a) == [(1,)] and rows(b) == [(2,)] and storage.settle(a) is a
    bad = table("x int", [(0,)]).select((F.lit(1) / F.col("x")).alias("y"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        storage.settle_together((bad, "bad"), (table("x int", [(2,)]), "good"))

"""Counted and bucketed stage tables, narrowing, facts by year, outlines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from supplyloom.operators import outlines, ranking, selection
from supplyloom.plans import colocated, trade
from supplyloom.sources import facts, storage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    changed = []

    def put(key, value):
        changed.append((key, spark.conf.get(key, None)))
        spark.conf.set(key, value)

    yield put
    for key, old in reversed(changed):
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def jobs_of(spark, work):
    """Number of jobs that ``work`` starts in this thread."""
    import uuid

    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


# ---- counted stage tables --------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_rows_are_counted_as_they_are_written(spark, n):
    made, count = storage.settle_counted(spark.range(0, n, 1, 7).withColumn("x", F.col("id") % 3))
    assert count == n == made.count()


def test_rows_after_an_exchange_are_counted_once(spark):
    _, count = storage.settle_counted(spark.range(0, 5000, 1, 9).groupBy((F.col("id") % 77).alias("k")).count())
    assert count == 77


def test_an_empty_frame_known_to_be_empty_is_counted(spark):
    made, count = storage.settle_counted(spark.createDataFrame([], "a int").filter("a > 1"))
    assert count == 0 and made.columns == ["a"]


def test_a_counted_table_needs_no_job(spark):
    made, _ = storage.settle_counted(spark.range(10))
    assert jobs_of(spark, lambda: storage.settle_counted(made)) == 0
    plain = storage.settle(spark.range(10))
    assert storage.settle_counted(plain) == (plain, 10)


def test_a_distribution_starts_no_counting_job(spark):
    counts = spark.range(0, 300, 1, 3).select(F.col("id").cast("double").alias("v"), F.lit(2).alias("w"))
    plain, (counted, _) = storage.settle(counts), storage.settle_counted(counts)
    with_count = jobs_of(spark, lambda: ranking.running_weights(plain, "v", "w", rows_per_bucket=100))
    without = jobs_of(spark, lambda: ranking.running_weights(counted, "v", "w", rows_per_bucket=100))
    assert without < with_count


# ---- bucketed stage tables -------------------------------------------------------

PRODUCTION = "iso3c string, genus_cat string, scientific_name string, tonnes double"
EXPORTS = "iso3c string, genus_cat string, year int, tonnes double"


def producers(table):
    made = [("CHL", f"g{i % 5}", f"s{i}", float(i)) for i in range(60)]
    made += [("PER", "g1", None, None), ("PER", "g1", "s", 2.0), (None, "g1", "s", 3.0), ("PER", None, "s", 4.0)]
    sold = [("CHL", f"g{i % 5}", 2000 + i, float(10 * i)) for i in range(8)]
    sold += [(None, "g1", 2000, 9.0), ("PER", "g1", None, 5.0), ("ECU", "g1", 1, 1.0)]
    return table(PRODUCTION, made), table(EXPORTS, sold)


@pytest.mark.parametrize("rows_per_slot", [colocated.ROWS_PER_SLOT, 3])
def test_allocation_in_place_equals_the_plain_one(table, rows_per_slot):
    made, sold = producers(table)
    mine = colocated.allocation_in_place(made, sold, buckets=3, rows_per_slot=rows_per_slot)
    plain = trade.proportional_allocation(made, sold)
    assert mine.columns == plain.columns and rows(mine) == rows(plain)


def test_allocation_in_place_of_nothing(table):
    made, sold = producers(table)
    assert colocated.allocation_in_place(made.limit(0), sold).count() == 0
    kept = colocated.allocation_in_place(made, sold.limit(0)).filter("pred_exp_catch <> 0 or tonnes <> pred_consumed_catch")
    assert kept.count() == 0


def test_allocation_in_place_exchanges_nothing(spark, table, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    made, sold = (storage.settle(df) for df in producers(table))
    mine = plan(colocated.allocation_in_place(made, sold, buckets=4))
    assert mine.count("Exchange") == 0 and mine.count("Bucketed: true") == 3
    assert plan(trade.proportional_allocation(made, sold)).count("Exchange hashpartitioning") >= 3


def test_unknown_keys_are_a_slot(spark, table):
    stored = storage.settle_by(table("a string, b int, v int", [("x", None, 1), (None, None, 2), ("x", 1, 3), ("x", None, 4), ("null", None, 5)]), ["a", "b"])
    sizes = sorted(r[0] for r in stored.groupBy(storage.SLOT).count().select("count").collect())
    assert sizes == [1, 1, 1, 2] and storage.heaviest_slot(stored) == 2
    assert rows(stored.drop(storage.SLOT).filter("v > 3")) == [("null", None, 5), ("x", None, 4)]


# ---- quantiles by narrowing ------------------------------------------------------

NAMES = {"lo": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "hi": 1.0}


def measures():
    random.seed(4)
    made = [("even", float(i)) for i in range(2000)]
    made += [("tied", float(i % 3)) for i in range(900)] + [("tied", None)] * 50
    made += [("far", random.choice([1e300, -1e300, 1e-300, 0.0, -0.0]) * random.random()) for _ in range(701)]
    made += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", math.nan)]
    made += [(None, float(i * i)) for i in range(333)] + [("inf", math.inf), ("inf", 1.0), ("inf", 1.0)]
    random.shuffle(made)
    return made


@pytest.mark.parametrize("ranges,rows_per_bucket", [(2, 1_000_000), (64, 1_000_000), (7, 50)])
def test_narrowing_equals_ranking_everything(table, ranges, rows_per_bucket):
    df = table("g string, v double", measures())
    quartered = {k: p for k, p in NAMES.items()}
    ours = selection.narrowed_quantiles(df, "v", ["g"], quartered, ranges, rows_per_bucket)
    theirs = ranking.exact_quantiles(df, "v", ["g"], quartered)
    shown = lambda made: rows(made.select("g", *[F.col(c).cast("string").alias(c) for c in NAMES]))
    assert shown(ours) == shown(theirs)


def test_narrowing_of_nothing_and_of_no_group(table):
    empty = table("g string, v double", [])
    assert selection.narrowed_quantiles(empty, "v", ["g"], NAMES).collect() == []
    with pytest.raises(ValueError):
        selection.narrowed_quantiles(empty, "v", [], NAMES)


def test_narrowing_ranks_few_rows(spark, monkeypatch):
    kept = []

    def counting(df, label="stage"):
        made = storage.settle_counted(df, label)
        kept.append(made[1])
        return made

    monkeypatch.setattr(selection, "settle_counted", counting)
    df = storage.settle(spark.range(0, 40_000, 1, 8).select((F.col("id") % 2).alias("g"), F.rand(3).alias("v")))
    made = selection.narrowed_quantiles(df, "v", ["g"], {"median": 0.5}, ranges=64)
    assert rows(made) == rows(ranking.exact_quantiles(df, "v", ["g"], {"median": 0.5}))
    # Two ranges a group at most, each about a 64th of its rows.
    assert kept[0] <= 2 * 2 * (40_000 / 2) / 64 * 1.5


# ---- facts by year ---------------------------------------------------------------


@pytest.fixture(scope="module")
def stored_facts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("facts") / "long")
    long = spark.range(0, 900, 1, 6).select(
        F.lpad(F.col("id").cast("string"), 4, "0").alias("code"),
        F.when(F.col("id") % 10 != 0, 2000 + F.col("id") % 7).cast("int").alias("year"),
    )
    facts.write_facts(long, path)
    return long, facts.read_facts(spark, path, long.schema)


def test_facts_come_back_whole(stored_facts):
    long, stored = stored_facts
    assert rows(stored.select(*long.columns)) == rows(long)


def test_base_years_are_folders(stored_facts):
    long, stored = stored_facts
    kept = facts.of_years(stored, [2001, 2003])
    assert rows(kept.select(*long.columns)) == rows(long.filter("year in (2001, 2003)"))
    text = plan(kept)
    assert "PartitionFilters: [year" in text and "PushedFilters: []" in text
    kept.collect()
    scan = kept._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 2 and len(stored.inputFiles()) == 8


def test_base_years_from_a_table_prune_while_running(spark, table, stored_facts, tmp_path):
    long, stored = stored_facts
    listed = [("trade", 2002), ("trade", 2002), ("trade", None), ("food", 2005), (None, 2006)]
    table("source string, year int", listed).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    kept = facts.of_base_years(stored, base, F.col("source") == "trade")
    assert "dynamicpruning" in plan(kept)
    assert rows(kept.select(*long.columns)) == rows(long.filter("year = 2002"))
    assert facts.of_base_years(stored, base, F.col("source") == "catch").count() == 0


def test_a_hot_year_is_written_by_several_tasks(spark, tmp_path, conf):
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    conf("spark.sql.shuffle.partitions", "64")  # the years lie apart
    hot = spark.range(0, 60_000, 1, 8).select(F.rand(1).alias("v"), F.when(F.col("id") % 20 == 0, 2001).otherwise(2000).alias("year"))
    facts.write_facts(hot, str(tmp_path / "hot"))
    assert len(list((tmp_path / "hot" / "year=2000").glob("*.parquet"))) > 2
    assert len(list((tmp_path / "hot" / "year=2001").glob("*.parquet"))) == 1


# ---- outlines --------------------------------------------------------------------

VERTEX = "place string, ring int, o int, x double, y double, hole boolean"


def ring(place, number, points, hole=False):
    return [(place, number, i, float(x), float(y), hole) for i, (x, y) in enumerate(points)]


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def measured(df, ranges=None):
    made = outlines.outline_measures(df, ["place"], "ring", "o", "x", "y", hole="hole", ranges=ranges)
    return {r.place: tuple(r)[1:] for r in made.collect()}


@pytest.mark.parametrize("ranges", [1, 2, 13])
def test_known_shapes(table, ranges):
    shapes = (
        ring("square", 1, SQUARE) + ring("turned", 1, SQUARE[::-1])
        + ring("frame", 1, SQUARE) + ring("frame", 2, [(2, 2), (4, 2), (4, 4), (2, 4)], True)
        + ring("islands", 1, SQUARE) + ring("islands", 2, [(10, 0), (10, 2), (12, 2), (12, 0)])
        + ring("closed", 1, [*SQUARE, SQUARE[0]]) + ring("triangle", 7, [(0, 0), (6, 0), (0, 3)])
        + ring("line", 1, [(0, 0), (5, 5)]) + ring("point", 1, [(1, 1)]) + ring(None, None, SQUARE, None)
    )
    got = measured(table(VERTEX, shapes), ranges)
    assert got["square"] == got["turned"] == got[None] == (16.0, 2.0, 2.0, 1, 4)
    assert got["closed"] == (16.0, 2.0, 2.0, 1, 5)
    assert got["frame"] == pytest.approx((12.0, 5 / 3, 5 / 3, 2, 8))
    assert got["islands"] == pytest.approx((20.0, (32 + 44) / 20, (32 + 4) / 20, 2, 8))
    assert got["triangle"] == pytest.approx((9.0, 2.0, 1.0, 1, 3))
    assert got["line"] == (0.0, None, None, 1, 2) and got["point"] == (0.0, None, None, 1, 1)


def test_unknown_vertices_are_left_out(table):
    spoilt = ring("p", 1, SQUARE) + [
        ("p", 1, 2, None, 9.0, False), ("p", 1, 2, 9.0, math.nan, False), ("p", 1, None, 9.0, 9.0, False),
        ("p", 1, 1, math.inf, 1.0, False), ("gone", 1, 0, None, None, False),
    ]
    assert measured(table(VERTEX, spoilt)) == {"p": (16.0, 2.0, 2.0, 1, 4)}
    assert measured(table(VERTEX, [])) == {}


def test_a_long_ring_is_many_tasks_work(spark):
    n = 20_000
    angle = 2 * math.pi * F.col("id") / n
    circle = spark.range(0, n, 1, 5).select(
        F.lit("c").alias("place"), F.lit(1).alias("ring"), F.col("id").alias("o"),
        (F.cos(angle) + 3).alias("x"), (F.sin(angle) - 2).alias("y"), F.lit(False).alias("hole"),
    )
    spread = circle.repartitionByRange(13, "place", "ring", "o").select(F.spark_partition_id().alias("p"))
    assert spread.distinct().count() > 5
    for ranges in (1, 13):
        area, x, y, _, count = measured(circle, ranges)["c"]
        assert (area, x, y) == pytest.approx((n / 2 * math.sin(2 * math.pi / n), 3, -2), abs=1e-9) and count == n


def test_equal_area_keeps_the_area_of_the_sphere(table):
    # An eighth of the sphere between the equator and a pole.
    corners = table("place string, ring int, o int, lon double, lat double", [
        ("e", 1, 0, 0.0, 0.0), ("e", 1, 1, 90.0, 0.0), ("e", 1, 2, 90.0, 90.0), ("e", 1, 3, 0.0, 90.0), ("e", 1, 4, None, 1.0),
    ])
    flat = outlines.equal_area(corners, "lon", "lat", radius=2.0)
    made = outlines.outline_measures(flat, ["place"], "ring", "o", "x", "y")
    found = outlines.geographic(made, "centroid_x", "centroid_y", "lon", "lat", radius=2.0).first()
    assert found.area == pytest.approx(4 * math.pi * 4 / 8)
    assert (found.lon, found.lat) == pytest.approx((45.0, 30.0))

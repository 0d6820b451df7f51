"""What the physical plans promise: pushdown, anti joins, splitting, single reads."""

import re

import pytest
from pyspark.sql import functions as F

from supplyloom.catalogue import frames as A
from supplyloom.catalogue.registry import Tables
from supplyloom.operators import cleaning, joins, ranking, reshape

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


@pytest.fixture
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture
def conf(spark):
    changed = []

    def put(key, value):
        changed.append((key, spark.conf.get(key, None)))
        spark.conf.set(key, value)

    yield put
    for key, old in reversed(changed):
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def scan_of(text, column):
    return next(line for line in text.splitlines() if "FileScan" in line and column in line)


def test_base_year_and_columns_reach_the_scan(tables, conf):
    conf("spark.sql.debug.maxToStringFields", "200")
    conf("spark.sql.maxMetadataStringLength", "2000")
    rows = A.flows(tables, [1998]).groupBy("iso3c").agg(F.sum("l_quantity"))
    scan = scan_of(plan(rows), "l_shipdate")
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    assert "l_extendedprice" not in scan and "l_returnflag" not in scan


def test_unpivot_reads_only_the_wanted_years(spark, tmp_path):
    spark.range(5).select("id", *[F.lit(1.0).alias(str(y)) for y in range(2000, 2020)]).write.parquet(str(tmp_path / "w"))
    long = reshape.unpivot_years(spark.read.parquet(str(tmp_path / "w")), 1, 1, years=[2019])
    assert "ReadSchema: struct<id:bigint,2019:double>" in plan(long)


def test_denylist_is_an_anti_join(tables):
    out = cleaning.denylist_filter(tables.lineitem, tables.supplier.limit(3), "l_suppkey", "s_suppkey")
    assert "LeftAnti" in plan(out)


def test_null_safe_join_stays_a_hash_join(tables):
    left = tables.lineitem.select(F.nullif("l_suppkey", F.lit(1)).alias("s_suppkey"), "l_quantity")
    text = plan(joins.natural_left_join(left, tables.supplier))
    assert "HashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_checked_pivot_is_one_aggregation(tables):
    long = tables.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    text = plan(reshape.pivot_checked(long, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "q"))
    assert "pivotfirst" not in text.lower() and text.count("FileScan") == 1


def test_two_tiers_read_the_facts_once(tables):
    facts = tables.lineitem.select(
        F.col("l_returnflag").alias("scientific_name"), F.col("l_linestatus").alias("genus_cat"), "l_quantity"
    )
    small = tables.nation.select(F.col("n_name").alias("scientific_name"), F.lit("Iron").alias("nutrient"), F.lit(1.0).alias("value"))
    out = joins.two_tier_join(facts, small, small.withColumnRenamed("scientific_name", "genus_cat"))
    assert sum("l_quantity" in line for line in plan(out).splitlines() if "FileScan" in line) == 1


def test_hot_key_of_a_shuffled_join_is_split(spark, conf, tmp_path):
    """A third of the facts share one (null) key; broadcasting is switched off."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    conf("spark.sql.shuffle.partitions", "16")
    facts = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), F.col("id") % 200)).alias("k"), "id"
    )
    dim = spark.range(200).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") * 2).alias("w"))
    dim = dim.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("k"), F.lit(-1).cast("long").alias("w")))
    out = joins.natural_left_join(facts, dim)
    text = final_plan(out)
    assert "SortMergeJoin(skew=true)" in text
    assert out.count() == 60000 and out.filter("w = -1").count() == 20000


def test_first_rows_merge_before_the_shuffle(tables):
    text = plan(joins.first_rows(tables.lineitem.select("l_suppkey", "l_orderkey"), ["l_suppkey"], ["l_orderkey"]))
    assert "partial_min" in text and "Window" not in text


def test_bucketed_ranks_have_no_unbounded_window(spark, tables):
    """With many buckets every window over values is partitioned by bucket."""
    out = ranking.ecdf_rank(
        tables.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "q", rows_per_bucket=20
    )
    windows = [line for line in plan(out).splitlines() if re.search(r"\bWindow \[", line)]
    assert windows and any("_bucket" in line for line in windows)
    assert out.filter("q is null").count() == 0
    value_windows = [line for line in windows if "_v#" in line.split("windowspecdefinition")[1]]
    assert value_windows and all("_bucket" in line.split("windowspecdefinition")[1] for line in value_windows)


def test_cleaning_filters_reach_the_scan(spark, tmp_path):
    from supplyloom.operators import cleaning

    path = str(tmp_path / "t")
    spark.createDataFrame([("A2019", 1.0, "x")], "year string, v double, k string").write.parquet(path)
    df = spark.read.parquet(path)
    text = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "In(k, [a,b])" in text(cleaning.membership_filter(df, keep={"k": ["a", "b"]}))
    assert "GreaterThan(v,0.0)" in text(cleaning.positive_only(df, "v"))
    assert "StringContains(year,2019)" in text(cleaning.year_slice(df, 2019, prefix="A"))
    assert "In(k, [a,b])" in text(cleaning.membership_filter(df, drop={"k": ["a", "b"]}))


def test_supply_reads_catch_once(spark):
    from supplyloom.catalogue import frames, registry, relational
    from supplyloom.plans import sweeps

    tables = registry.Tables(spark, "/root/testdata/sf0.001")
    src = frames.sources(tables)
    reads = []

    class Counting:
        def __getattr__(self, name):
            if name == "catch":
                reads.append(name)
            return getattr(src, name)

    sweeps.total_consumption(Counting(), years=relational.years(), summed=True)
    assert reads == ["catch"]

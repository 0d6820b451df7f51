import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from supplyloom.operators import aggregates, cleaning, joins, mapping, reshape, unions
from supplyloom.sources import delimited, literal, storage


# ---- sources -----------------------------------------------------------------

def test_csv_scan_reads_na_and_empty_as_missing(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name,,v\na,x,1.5\nNA,"",NA\n,"q",2\n')
    df = delimited.csv_scan(
        spark, str(tmp_path / "x.csv"), "name string, _c1 string, v double", positional=True
    )
    assert rows(df) == [(None, None, None), (None, "q", 2.0), ("a", "x", 1.5)]


def test_blank_header_gets_a_position_name_and_is_repaired(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,,v\nx,y,1\n")
    df = delimited.csv_scan(spark, str(tmp_path / "x.csv"))
    fixed = delimited.header_repair(df, {"_c1": "code"})
    assert fixed.columns == ["a", "code", "v"]
    with pytest.raises(ValueError):
        delimited.header_repair(df, {"absent": "x"})


def test_csv_sink_round_trip(spark, table, tmp_path):
    df = table("a string, v double", [("x", 1.25), (None, None)])
    path = delimited.csv_sink(df, str(tmp_path / "out"))
    assert rows(delimited.csv_scan(spark, path, "a string, v double")) == [(None, None), ("x", 1.25)]
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "NA,NA" in text and "a,v" in text


def test_settled_rows_are_read_from_the_shared_folder(spark, table):
    df = storage.settle(table("a string", [("x",), (None,)]))
    assert rows(df) == [(None,), ("x",)]
    assert storage.shared_dir(spark) in df.inputFiles()[0]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Settings:
        def get(self, key, default=None):
            return default

    class Context:
        getConf = staticmethod(Settings)
        getCheckpointDir = staticmethod(lambda: None)

        def __init__(self, master):
            self.master = master

    class Session:
        conf = Settings()

        def __init__(self, master):
            self.sparkContext = Context(master)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session("yarn"))
    assert "supplyloom-" in storage.shared_dir(Session("local[2]"))


def test_literal_table_quotes_text(spark):
    df = literal.literal_table(spark, {"it's": 1.5, "b\\c": 2.0}, "k", "v")
    assert rows(df) == [("b\\c", 2.0), ("it's", 1.5)]


# ---- cleaning ----------------------------------------------------------------

def test_placeholder_clean(table):
    df = table("k string, v string", [("a", "1.5"), ("a", "..."), ("b", None), (None, "2"), ("c", "x1")])
    assert rows(cleaning.placeholder_clean(df, "v", ["k"])) == [("a", 1.5)]


def test_positive_only_drops_null_nan_and_zero(table):
    df = table("v double", [(1.0,), (0.0,), (None,), (float("nan"),), (-1.0,)])
    assert rows(cleaning.positive_only(df, "v")) == [(1.0,)]


def test_year_slice_reads_text_years(table):
    df = table("year string", [("A2019",), ("A2018",), (None,), ("total",)])
    assert rows(cleaning.year_slice(df, 2019, prefix="A")) == [(2019,)]
    assert rows(cleaning.year_slice(table("year int", [(2019,), (2018,)]), 2019)) == [(2019,)]


def test_membership_filter_keeps_null_end_use(table):
    df = table("s string, u string", [("I", None), ("I", "Other"), (None, "Food"), ("R", "Food")])
    assert rows(cleaning.membership_filter(df, {"s": ["I"]}, {"u": ["Other"]})) == [("I", None)]
    assert rows(cleaning.membership_filter(df, None, {"s": ["I"]})) == [(None, "Food"), ("R", "Food")]


def test_denylist_keeps_rows_without_a_key(table):
    df = table("iso3c string", [("AFG",), (None,), ("CHL",)])
    denied = table("iso string", [("AFG",), (None,)])
    assert rows(cleaning.denylist_filter(df, denied, "iso3c", "iso")) == [(None,), ("CHL",)]


def test_scenario_tag(table):
    out = cleaning.scenario_tag(table("a int", [(1,)]), {"scenario": "base", "note": None})
    assert dict(out.dtypes)["note"] == "string" and rows(out) == [(1, "base", None)]


# ---- reshape -----------------------------------------------------------------

@pytest.fixture
def wide(table):
    return table(
        "id string, grp string, gap string, `2018` double, `2019` double",
        [("a", "x", "-", 1.0, None), ("b", None, "-", 3.0, 4.0)],
    )


def test_unpivot_years_by_position(wide):
    out = reshape.unpivot_years(wide, 2, 3)
    assert out.columns == ["id", "grp", "year", "tonnes"]
    assert {tuple(r) for r in out.collect()} == {
        ("a", "x", "2018", 1.0), ("a", "x", "2019", None), ("b", None, "2018", 3.0), ("b", None, "2019", 4.0),
    }
    assert rows(reshape.unpivot_years(wide, 2, 3, years=[2019]).select("id", "tonnes")) == [
        ("a", None), ("b", 4.0)
    ]
    with pytest.raises(ValueError):
        reshape.unpivot_years(wide, 2, 3, years=[1900])


def test_unpivot_mixed_types_as_text(table):
    df = table("id string, `2018` string, `2019` double", [("a", "...", 2.0)])
    with pytest.raises(PySparkException):
        reshape.unpivot_years(df, 1, 1).collect()
    assert rows(reshape.unpivot_years(df, 1, 1, as_text=True)) == [("a", "2018", "..."), ("a", "2019", "2.0")]


def test_unpivot_named_drops_missing(wide):
    assert rows(reshape.unpivot_named(wide, ["id"], ["2018", "2019"])) == [
        ("a", "2018", 1.0), ("b", "2018", 3.0), ("b", "2019", 4.0),
    ]


def test_pivot_round_trip_and_duplicate_key(table):
    long = table("k string, e string, v double", [("a", "p", 1.0), ("a", "q", 2.0), (None, "p", 3.0), ("a", "z", 9.0)])
    wide = reshape.pivot_checked(long, ["k"], "e", ["p", "q"], "v")
    assert rows(wide) == [(None, 3.0, None), ("a", 1.0, 2.0)]
    doubled = long.unionByName(long.filter("e = 'q'"))
    with pytest.raises(PySparkException, match="duplicate rows"):
        reshape.pivot_checked(doubled, ["k"], "e", ["p", "q"], "v").collect()


def test_sector_pivot_residual_key(table):
    long = table(
        "iso3c string, nutrient string, production_sector string, nut_supply double, consump double",
        [("A", "Iron", "Artisanal", 1.0, 5.0), ("A", "Iron", "Import", 3.0, 7.0)],
    )
    assert rows(reshape.sector_pivot(long, ["Artisanal", "Import"])) == [("A", "Iron", 1.0, 3.0)]
    sparse = reshape.sector_pivot(long, ["Artisanal", "Import"], residual=["consump"])
    assert rows(sparse) == [("A", "Iron", 5.0, 1.0, 0.0), ("A", "Iron", 7.0, 0.0, 3.0)]


def test_token_split_missing_and_surplus(table):
    df = table("t string", [("a[mg]",), ("b",), ("c[x][y][z]",), (None,)])
    out = reshape.token_split(df, "t", ["long", "units"], r"\[", strip={"units": "]"}).drop("t")
    assert rows(out) == [(None, None), ("a", "mg"), ("b", None), ("c", "x")]


def test_column_range(table):
    df = table("a int, b int, c int, d int", [(1, 2, 3, 4)])
    out = reshape.column_range(df, "b", "d", lead=["c"], drop=["d"], rename={"b": "bb"})
    assert out.columns == ["c", "bb"]


@pytest.mark.parametrize("seed", range(3))
def test_unpivot_undoes_pivot(table, seed):
    rng = random.Random(seed)
    cells = {(f"k{rng.randrange(9)}", rng.choice("pqr")): float(rng.randrange(50)) for _ in range(20)}
    long = table("k string, e string, v double", [(*key, v) for key, v in cells.items()])
    wide = reshape.pivot_checked(long, ["k"], "e", ["p", "q", "r"], "v")
    assert rows(reshape.unpivot_named(wide, ["k"], ["p", "q", "r"], "e", "v")) == rows(long)


# ---- mapping -----------------------------------------------------------------

def test_maps(table):
    df = table("c string", [("a",), ("z",), (None,)])
    assert rows(mapping.category_map(df, "c", "m", {"a": "A"})) == [(None, None), ("a", "A"), ("z", None)]
    assert rows(mapping.code_recode(df, "c", {"a": "A"})) == [(None,), ("A",), ("z",)]


def test_conditional_override_null_test(table):
    df = table("t string, c string", [("x", "old"), ("y", "old"), (None, "old")])
    assert rows(mapping.conditional_override(df, "c", "t", "x", "new")) == [
        (None, None), ("x", "new"), ("y", "old"),
    ]


def test_text_match_scale(table):
    df = table("n string, v double", [("Cod FILLETs", 1.0), ("Cod", 1.0), (None, 1.0)])
    assert rows(mapping.text_match_scale(df, "n", "fillet", "v", 2)) == [("Cod", 1.0), ("Cod FILLETs", 2.0)]


def test_per_group_cap_and_levels(table):
    df = table("g string, v double", [("Zinc", 30.0), ("Zinc", None), ("Protein", 30.0)])
    assert rows(mapping.per_group_cap(df, "g", "v", {"Zinc": 20.0})) == [
        ("Protein", 30.0), ("Zinc", None), ("Zinc", 20.0),
    ]
    assert rows(mapping.ordered_levels(df.select("g").distinct(), "g", ["Zinc"])) == [(None, None), ("Zinc", 1)]


# ---- joins -------------------------------------------------------------------

def test_natural_join_matches_null_keys(table):
    left = table("k string, c string, v int", [("a", None, 1), (None, None, 2), ("b", "x", 3)])
    right = table("k string, c string, w int", [("a", None, 10), (None, None, 20)])
    assert rows(joins.natural_left_join(left, right)) == [
        (None, None, 2, 20), ("a", None, 1, 10), ("b", "x", 3, None),
    ]


def test_dim_enrich_drops_unmatched(table):
    fact = table("f string, v int", [("a", 1), ("b", 2), (None, 3)])
    dim = table("name string, code string", [("a", "A"), ("c", "C")])
    assert rows(joins.dim_enrich(fact, dim, "f", "name", "code")) == [("a", 1, "A")]


def test_first_match_uses_declared_order(table):
    left = table("k string", [("a",), ("b",), (None,)])
    right = table("k string, o int, v double", [("a", 2, 5.0), ("a", 1, 7.0), ("a", None, 9.0), (None, 1, 1.0)])
    assert rows(joins.first_match_lookup(left, right, ["k"], ["o"], "v", "first")) == [
        (None, None), ("a", 7.0), ("b", None),
    ]


def test_first_rows_keeps_null_payload(table):
    df = table("k string, o int, v double", [("a", 1, None), ("a", 2, 5.0), ("b", None, 2.0)])
    assert rows(joins.distinct_first(df, ["k"], ["o"])) == [("a", 1, None), ("b", None, 2.0)]


def test_two_tier_join(table):
    fact = table(
        "scientific_name string, genus_cat string, w int",
        [("cod", "Fish", 1), ("eel", "Fish", 2), (None, "Fish", 3), (None, None, 4)],
    )
    species = table("scientific_name string, nutrient string, value double", [("cod", "Iron", 1.0), ("cod", "Zinc", 2.0), (None, "Iron", 99.0)])
    category = table("genus_cat string, nutrient string, value double", [("Fish", "Iron", 5.0), (None, "Iron", 6.0)])
    assert rows(joins.two_tier_join(fact, species, category).select("w", "nutrient", "value")) == [
        (1, "Iron", 1.0), (1, "Zinc", 2.0), (2, None, None), (3, "Iron", 5.0), (4, "Iron", 6.0),
    ]


# ---- aggregates and unions ---------------------------------------------------

def test_subset_share(table):
    df = table("k string, g string, v double", [("a", "f", 1.0), ("a", "x", 3.0), ("b", "x", 5.0), ("a", None, 4.0)])
    out = aggregates.subset_share(df, ["k"], "v", F.col("g") == "f", "part", "whole", "share")
    assert rows(out) == [("a", 1.0, 8.0, 12.5)]


def test_intake_summary_floor_and_strict(table):
    df = table("iso3 string, perc_deficient double", [("A", 0.0), ("A", 10.0), ("B", 5.0), ("C", None), ("C", 1.0)])
    out = {r[0]: r.asDict() for r in aggregates.intake_summary(df).collect()}
    assert out["A"]["intake"] == 5.0 and out["A"]["intake_low"] == 0.0
    assert out["B"]["intake_sd"] is None and out["B"]["intake_low"] is None
    assert out["C"]["intake"] is None


def test_uncertainty_band(table):
    df = table("iso3c string, perc_SSF double", [("A", 1.0), ("A", 3.0), ("B", 2.0)])
    out = {r[0]: r.asDict() for r in aggregates.uncertainty_band(df, df).collect()}
    assert out["A"]["perc_SSF_min"] == 1.0 and out["A"]["perc_SSF_max"] == 3.0
    assert out["A"]["perc_SSF_low"] == pytest.approx(2 - 2**0.5)
    assert out["B"]["perc_SSF_high"] is None


def test_region_rollup_null_region_is_a_group(table):
    df = table("iso3c string, perc_SSF double", [("A", 1.0), ("B", None), ("Z", 4.0)])
    dim = table("iso3 string, region string", [("A", "n"), ("B", "n")])
    assert rows(aggregates.region_rollup(df, dim, "iso3", "perc_SSF")) == [(None, 4.0), ("n", None)]


def test_unions_by_name_and_order(table):
    a = table("x int, y string", [(1, "p")])
    b = table("y string, x int", [("q", 2)])
    assert rows(unions.production_union(a, b)) == [(1, "p"), (2, "q")]
    df = table("v int", [(None,), (1,), (3,)])
    assert [r[0] for r in unions.ordered_output(df, [("v", True)]).collect()] == [3, 1, None]
    assert [r[0] for r in unions.ordered_output(df, [("v", False)]).collect()] == [1, 3, None]
    large = table("iso3 string, area_sqkm double", [("A", 5e5)])
    tiny = table("iso3 string, note string", [("T", "x")])
    assert rows(unions.dimension_union(large, tiny)) == [("A", 5e5, None), ("T", 10.0, "x")]


def test_csv_quotes_are_doubled_and_headers_checked(spark, tmp_path):
    (tmp_path / "q.csv").write_text('name,v\n"say ""hi"", you",1\nback\\slash,2\n')
    got = delimited.csv_scan(spark, str(tmp_path / "q.csv"), "name string, v int")
    assert rows(got) == [("back\\slash", 2), ('say "hi", you', 1)]
    again = delimited.csv_scan(spark, delimited.csv_sink(got, str(tmp_path / "out")), "name string, v int")
    assert rows(again) == rows(got)
    (tmp_path / "o.csv").write_text("v,name\n1,x\n")
    with pytest.raises(Exception):
        delimited.csv_scan(spark, str(tmp_path / "o.csv"), "name string, v int").collect()
    (tmp_path / "b.csv").write_text("name,v\nx,bad\n")
    with pytest.raises(Exception):
        delimited.csv_scan(spark, str(tmp_path / "b.csv"), "name string, v int").collect()
    (tmp_path / "m.csv").write_text('name,v\n"two\nlines",1\n')
    lines = delimited.csv_scan(spark, str(tmp_path / "m.csv"), "name string, v int", multi_line=True)
    assert rows(lines) == [("two\nlines", 1)]


def test_long_mappings_as_literal_and_as_table(spark, table):
    from supplyloom.operators import mapping

    pairs = {f"k{i}": f"v{i % 7}" for i in range(2_000)}
    limits = {k: float(i) for i, k in enumerate(pairs)}
    df = table("k string, x double", [("k3", 9.0), ("k1999", 5000.0), ("none", 1.0), (None, 2.0)])
    as_table = table("a string, b string", list(pairs.items()))
    limit_table = table("a string, b double", list(limits.items()))
    number_table = table("a string, n int", [(k, i) for i, k in enumerate(pairs, start=1)])
    assert rows(mapping.category_map(df, "k", "m", pairs)) == rows(mapping.category_map(df, "k", "m", as_table))
    assert rows(mapping.code_recode(df, "k", pairs)) == rows(mapping.code_recode(df, "k", as_table))
    assert rows(mapping.per_group_cap(df, "k", "x", limits)) == rows(mapping.per_group_cap(df, "k", "x", limit_table))
    assert rows(mapping.ordered_levels(df, "k", list(pairs))) == rows(mapping.ordered_levels(df, "k", number_table))


def test_stage_tables_are_stored_once_and_released(spark, table):
    from supplyloom.sources import storage

    stored = storage.settle(table("a int", [(1,)]))
    assert storage.settle(stored) is stored and stored.collect()[0].a == 1

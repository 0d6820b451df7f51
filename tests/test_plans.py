"""Jobs on small fixtures with hand-worked results."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from supplyloom import constants as C
from supplyloom.plans import nutrients as N, per_capita as P, production as R, reports, sweeps, trade as T
from supplyloom.sources.literal import literal_table


# ---- production --------------------------------------------------------------

@pytest.fixture
def aquaculture_wide(table):
    ids = "country string, iso3c string, FAOSTAT_group string, environment string, scientific_name string, common_name string"
    more = ", ".join(f"i{n} string" for n in range(7)) + ", " + ", ".join(f"g{n} string" for n in range(6))
    pad = ("",) * 13
    return table(
        f"{ids}, {more}, `2018` double, `2019` double",
        [
            ("Chile", "CHL", "Crustaceans", "Marine", "Penaeus", "shrimp", *pad, 9.0, 5.0),
            ("Chile", "CHL", "Crustaceans", "Marine", "Penaeus", "shrimp", *pad, None, 2.0),
            ("Chile", "CHL", "Crustaceans", "Freshwater", "Astacus", "crayfish", *pad, 1.0, 4.0),
            ("Chile", "CHL", "Sponges", "Marine", None, "sponge", *pad, None, 1.0),
            ("Chile", "CHL", "Marine Fish NEI", "Marine", "X", "x", *pad, 3.0, None),
        ],
    )


def test_aquaculture_aggregate(aquaculture_wide):
    out = R.aquaculture_aggregate(aquaculture_wide, 2019)
    assert rows(out.select("genus_cat", "scientific_name", "production_sector", "tonnes", "year")) == [
        (None, None, "aquaculture", 1.0, 2019), ("Crustaceans", "Penaeus", "aquaculture", 7.0, 2019),
    ]


@pytest.fixture
def trade_wide(table):
    ids = "country string, iso3c string, FAOSTAT_group string, ISSCAAP_group string, Trade_flow string, common_name string"
    pad = ("",) * 4
    rows_ = [
        ("Chile", "CHL", "Crustaceans, frozen", "Freshwater crustaceans", "Exports", "Crab", *pad, 10.0),
        ("Chile", "CHL", "Crustaceans", "Crabs", "Exports", "Crab Fillets", *pad, 15.0),
        ("Chile", "CHL", "Crustaceans", "Crabs", "Imports", "Crab", *pad, 20.0),
        ("Chile", "CHL", "Crustaceans", "Crabs", "Reexports", "Crab", *pad, 5.0),
        ("Chile", "CHL", "Crustaceans", "Crabs", "Processed production", "Crab", *pad, 99.0),
        ("Chile", "CHL", "Crustaceans", "Crabs", "Exports", None, *pad, 50.0),
        ("Peru", "PER", "Demersal", "Cod", "Imports", "Cod", *pad, 8.0),
        ("Peru", "PER", "Meals", "Cod", "Imports", "Cod", *pad, 8.0),
        ("Peru", "PER", "Demersal", "Cod", "Exports", "Cod", *pad, 0.0),
    ]
    return table(f"{ids}, i1 string, i2 string, i3 string, i4 string, `2019` double", rows_)


def test_reexports_and_freshwater_share(trade_wide):
    trade = R.trade_flows(trade_wide, 2019)
    assert trade.count() == 6
    ratios = R.reexport_ratios(trade).collect()
    assert [r["iso3c"] for r in ratios] == ["CHL", "PER"]  # unknown shares last
    assert (ratios[0]["Exports"], ratios[0]["perc_imp_reexport"], ratios[0]["perc_exports_reexport"]) == (40.0, 25.0, 12.5)
    assert (ratios[1]["Reexports"], ratios[1]["perc_exports_reexport"]) == (0.0, None)
    assert rows(R.freshwater_crustacean_share(trade)) == [("Chile", "CHL", 10.0, 40.0, 25.0)]


@pytest.fixture
def catch(table):
    return table(
        "fishing_entity string, year int, functional_group string, scientific_name string, common_name string, "
        "sector_type string, end_use_name string, catch double",
        [
            ("Chile", 2019, "shrimp", "Penaeus", "shrimp", "Artisanal", None, 3.0),
            ("Chile", 2019, "shrimp", "Penaeus", "shrimp", "Artisanal", "Food", 4.0),
            ("Chile", 2019, "shrimp", "Penaeus", "shrimp", "Industrial", "Food", None),
            ("Chile", 2019, "shrimp", "Penaeus", "shrimp", "Industrial", "Food", 4.0),
            ("Chile", 2019, "shrimp", C.UNIDENTIFIED_SPECIES, "fish", "Subsistence", "Food", 6.0),
            ("Chile", 2019, "shrimp", None, "fish", "Recreational", "Food", 1.0),
            ("Chile", 2019, "shrimp", "Penaeus", "shrimp", "Artisanal", "Other", 100.0),
            ("Atlantis", 2019, "shrimp", "Penaeus", "shrimp", "Artisanal", "Food", 100.0),
        ],
    )


@pytest.fixture
def countries(table):
    return table("missing_countries string, iso3c string", [("Chile", "CHL"), ("Peru", "PER")])


def test_catch_is_split_by_traded_sectors(catch, countries):
    coded = R.categorised_catch(catch, countries)
    traded = R.sector_catch_aggregate(coded).select("production_sector", "genus_cat", "tonnes")
    assert rows(traded) == [("Artisanal", "Crustaceans", 7.0), ("Industrial", "Crustaceans", None)]
    kept = R.direct_consumption(coded).select("production_sector", "genus_cat", "pred_consumption")
    assert rows(kept) == [("Recreational", None, 1.0), ("Subsistence", "Marine fish; Other", 6.0)]
    retained = R.direct_consumption(coded, C.TRADED_SECTORS_ALL_RETAINED)
    assert {r[0] for r in retained.select("production_sector").collect()} == {
        "Artisanal", "Recreational", "Subsistence",
    }


# ---- trade -------------------------------------------------------------------

def test_food_balance_from_text_cells(table):
    wide = table(
        "country string, iso3c string, FAOSTAT_group string, element string, unit string, `2016` string, `2017` string",
        [
            ("Chile", "CHL", "Crustaceans", "Production", "t", "1", "10"),
            ("Chile", "CHL", "Crustaceans", "Food imports", "t", "1", "..."),
            ("Chile", "CHL", "Crustaceans", "Food exports", "t", "1", "4"),
            ("Chile", "CHL", "Freshwater & diadromous fish", "Production", "t", "1", "7"),
            ("Chile", "CHL", "Meals", "Production", "t", "1", "2"),
            ("Nowhere", None, "Crustaceans", "Production", "t", "1", "2"),
        ],
    )
    out = T.food_balance(wide, 2017).select("genus_cat", *C.BALANCE_ELEMENTS)
    assert rows(out) == [(None, 2.0, None, None), ("Crustaceans", 10.0, None, 4.0)]


def test_trade_balance_adjust(table):
    balance = table(
        "iso3c string, genus_cat string, Production double, `Food imports` double, `Food exports` double",
        [
            ("A", "x", 10.0, 50.0, 30.0),   # surplus 20: imports 50-5-20, exports 30-5-20
            ("B", "x", 100.0, 50.0, 30.0),  # no reported re-exports: fall back
            ("C", "x", 0.0, 8.0, 30.0),     # negative prediction: 0
            ("D", "x", None, None, 0.0),    # nothing known: 0
        ],
    )
    reexports = table("iso3c string, genus_cat string, Reexports double", [("A", "x", 5.0), ("C", "x", 1.0)])
    out = {r["iso3c"]: r for r in T.trade_balance_adjust(balance, reexports).collect()}
    pick = lambda k: (out[k]["pred_reexports"], out[k]["imports"], out[k]["exports"], out[k]["perc_reexp"])
    assert pick("A") == (20.0, 25.0, 5.0, pytest.approx(200 / 3))
    assert pick("B") == (0.0, 50.0, 50.0, 0.0)  # exports fall back to reported imports
    assert pick("C") == (30.0, 0.0, 0.0, 100.0)
    assert pick("D") == (None, 0.0, 0.0, None)
    symmetric = T.trade_balance_adjust(balance, reexports, export_fallback="Food exports")
    assert {r["iso3c"]: r["exports"] for r in symmetric.collect()}["B"] == 30.0


def test_flow_split_and_totals(table):
    adjusted = table("iso3c string, imports double, exports double", [("A", 1.0, 2.0), ("A", 3.0, 0.0)])
    exports, imports = T.flow_split(adjusted, ["iso3c"])
    assert rows(exports) == [("A", "exports", 0.0), ("A", "exports", 2.0)]
    assert rows(T.flow_country_totals(exports.unionByName(imports))) == [("A", 2.0, 4.0)]


def test_proportional_allocation(table):
    production = table(
        "iso3c string, genus_cat string, s string, tonnes double",
        [
            ("A", "x", "p", 30.0), ("A", "x", "q", 10.0), ("A", "y", "p", 5.0), ("B", "x", "p", None),
            ("B", "x", "q", 4.0), ("A", None, "p", 1.0), ("C", "x", "p", 2.0),
        ],
    )
    exports = table(
        "iso3c string, genus_cat string, year int, tonnes double",
        [("A", "x", 2018, 99.0), ("A", "x", 2017, 20.0), ("B", "x", 2017, 3.0), ("C", "x", 2017, 8.0)],
    )
    out = T.allocated_consumption(production, exports)
    got = rows(out.select("iso3c", "genus_cat", "s", "prop_catch", "pred_exp_catch", "pred_consumption", "negative_values"))
    assert got == [
        ("A", "x", "p", 0.75, 15.0, 15.0, 0.0), ("A", "x", "q", 0.25, 5.0, 5.0, 0.0),
        ("A", "y", "p", 1.0, 0.0, 5.0, 0.0),
        ("B", "x", "p", None, 0.0, None, None), ("B", "x", "q", None, 0.0, 4.0, 0.0),
        ("C", "x", "p", 1.0, 8.0, 0.0, -6.0),
    ]


def test_allocation_shares_sum_to_one(spark):
    production = spark.range(500).select(
        F.concat(F.lit("c"), F.col("id") % 7).alias("iso3c"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("genus_cat"),
        (F.col("id") % 11 + 1).cast("double").alias("tonnes"),
    )
    exports = spark.createDataFrame([("c0", "hot", 5.0)], "iso3c string, genus_cat string, tonnes double")
    out = T.proportional_allocation(production, exports)
    sums = out.groupBy("iso3c", "genus_cat").agg(F.sum("prop_catch").alias("s")).collect()
    assert out.count() == 500 and all(r["s"] == pytest.approx(1.0) for r in sums)


# ---- nutrients ---------------------------------------------------------------

@pytest.fixture
def profile(table):
    return table(
        "species string, genus_cat string, nutrient string, value double",
        [
            ("cod", "Demersal Fish", "Iron", 2.0), ("hake", "Demersal Fish", "Iron", 4.0),
            ("sole", "Demersal Fish", "Iron", None), ("cod", "Demersal Fish", "Zinc", 1.0),
            ("x", "Marine Fish; Other", "Iron", 8.0), ("y", "Marine fish; Other", "Iron", 10.0),
        ],
    )


def test_category_median_profile_unifies_one_label(profile):
    assert rows(N.category_median_profile(profile)) == [
        ("Demersal Fish", "Iron", 3.0), ("Demersal Fish", "Zinc", 1.0), ("Marine fish; Other", "Iron", 9.0),
    ]


def test_nutrient_supply(spark, table, profile):
    consumption = table(
        "iso3c string, year int, genus_cat string, common_name string, scientific_name string, "
        "production_sector string, pred_consumption double",
        [
            ("A", 1, "Demersal Fish", "c", "COD", "Artisanal", 10.0),
            ("A", 2, "Demersal Fish", "c", "Cod", "Artisanal", 5.0),
            ("A", 1, "Demersal Fish", None, None, "Import", 10.0),
            ("A", 1, "Demersal Fish", "u", "unknown fish", "Artisanal", 50.0),
            ("A", 1, "Demersal Fish", "c", "cod", "Industrial", 0.0),
            ("A", 1, "Demersal Fish", "c", "cod", "Industrial", None),
            ("A", 1, None, None, None, "Import", 7.0),
        ],
    )
    edible = N.edible_portion_scale(consumption, literal_table(spark, C.EDIBLE_SHARE, "genus_cat", "edible"))
    assert edible.filter("scientific_name = 'cod'").count() == 4
    fanned = N.nutrient_fanout(edible, N.species_profile(profile), N.category_median_profile(profile))
    got = {tuple(r)[:3]: (r["nut_supply"], r["consump"]) for r in N.nutrient_supply(fanned).collect()}
    # 15 t of cod at 0.8 edible: 12 t; counted once for each of two nutrients
    assert got == {
        ("A", "Iron", "Artisanal"): (pytest.approx(2 * 12 * 10000), pytest.approx(24)),
        ("A", "Zinc", "Artisanal"): (pytest.approx(1 * 12 * 10000), pytest.approx(24)),
        ("A", "Iron", "Import"): (pytest.approx(3 * 8 * 10000), pytest.approx(16)),
        ("A", "Zinc", "Import"): (pytest.approx(1 * 8 * 10000), pytest.approx(16)),
    }
    assert rows(N.sector_consumption(fanned)) == [("A", "Artisanal", pytest.approx(24)), ("A", "Import", pytest.approx(16))]
    assert rows(N.sector_consumption(fanned, once=True)) == [("A", "Artisanal", pytest.approx(12)), ("A", "Import", pytest.approx(8))]


def test_fanout_keeps_the_sign_rule_per_row(table):
    edible = table(
        "iso3c string, genus_cat string, scientific_name string, production_sector string, pred_consumption double",
        [("A", "x", "s", "P", 4.0), ("A", "x", "s", "P", -1.0)],
    )
    species = table("scientific_name string, nutrient string, value double", [("s", "up", 2.0), ("s", "down", -3.0), ("s", "nil", 0.0)])
    none = table("genus_cat string, nutrient string, value double", [])
    out = N.nutrient_fanout(edible, species, none).select("nutrient", "pred_consumption", "nut_supply")
    assert rows(out) == [("down", -1.0, 30000.0), ("up", 4.0, 80000.0)]


# ---- per capita --------------------------------------------------------------

@pytest.fixture
def food_base(table):
    return table(
        "`OUTPUT,0` string, `_c1` string, `_c2` string, `_c3` string, countries string, products string, "
        "elements string, A2018 double, A2019 double",
        [
            ("o", "A", "f", "FE", "Aland", "Fish", "Iron supply[mg]", 1.0, 2.0),
            ("o", "A", "f", "FE", "Aland", "Rice", "Iron supply[mg]", 1.0, 3.0),
            ("o", "A", "f", "FE", "Aland", "#N/A", "Iron supply[mg]", 1.0, None),
            ("o", "A", "f", "FE", "Aland", "Total food", "Iron supply[mg]", 9.0, 9.0),
            ("o", "A", "f", "DES", "Aland", "Rice", "Energy[kcal]", 9.0, 9.0),
            ("o", "A", "f", "O3", "Aland", "Fish", "O3", 1.0, 0.5),
            ("o", "AFG", "f", "FE", "Bad", "Rice", "Iron supply[mg]", 9.0, 9.0),
            ("o", None, "f", "FE", "None", "Rice", "Iron supply[mg]", 9.0, 4.0),
        ],
    )


def test_food_base_and_groups(food_base, table):
    denied = table("countries string, iso string", [("Bad", "AFG")])
    long = P.food_base_long(food_base, denied)
    assert {r["nutrient"] for r in long.collect()} == {"Iron", "Omega-3 fatty acids"}
    assert {(r["nutrient_long"], r["units"]) for r in long.collect()} == {("Iron supply", "mg"), ("O3", None)}
    assert long.count() == 2 * 6
    assert P.food_base_long(food_base, denied, 2019).select("year").distinct().collect()[0][0] == "2019"
    assert rows(P.food_group_supply(long, 2019)) == [
        (None, "Other", "Iron", 4.0), ("A", "ASF", "Iron", 2.0),
        ("A", "ASF", "Omega-3 fatty acids", 0.5), ("A", "Other", "Iron", 3.0),
    ]
    assert rows(P.product_nutrient_total(long)) == [("Fish", 1.5)]


FOOD = "iso3c string, nutrient string, production_sector string, nut_supply double"


@pytest.fixture
def food(table):
    return table(FOOD, [
        ("A", "Iron", "Other", 10.0), ("A", "Iron", "ASF", 4.0),
        ("B", "Iron", "Other", 6.0), ("B", "Iron", "ASF", 2.0),
        ("EUN", "Iron", "Other", 20.0), ("EUN", "Iron", "ASF", 8.0),
    ])


@pytest.fixture
def seafood(table):
    return table(FOOD, [
        ("A", "Iron", "Artisanal", 730.0), ("A", "Iron", "Subsistence", 365.0), ("A", "Iron", None, 5.0),
        ("N", "Iron", "Artisanal", 365.0), ("E", "Iron", "Industrial", 1.0), ("L", "Iron", "Artisanal", 1.0),
    ])


@pytest.fixture
def groups(table):
    return table("iso3c string, group string", [("A", "north"), ("B", "north"), ("N", "north"), ("E", "EUN"), ("L", None)])


def test_gap_filling(food, seafood, groups):
    assert rows(P.missing_detect(food, seafood)) == [("E",), ("L",), ("N",)]
    filled = P.group_fallback_fill(food, seafood, groups)
    new = rows(filled.filter(F.col("iso3c").isin("N", "E", "L")))
    assert new == [
        ("E", "Iron", "ASF", 8.0), ("E", "Iron", "Other", 20.0),
        ("N", "Iron", "ASF", 6.0), ("N", "Iron", "Other", 16.0),
    ]


def test_group_member_and_group_code_clash_raises(food, seafood, groups, table):
    clash = groups.unionByName(table("iso3c string, group string", [("B", "EUN")]))
    population = table("iso3c string, pop double", [("E", 1.0)])
    with pytest.raises(PySparkException, match="duplicate rows"):
        P.per_capita_share(food, seafood, population, clash).collect()


def test_per_capita_share(food, seafood, groups, table):
    population = table("iso3c string, pop double", [("A", 1.0), ("N", 0.0), ("E", 10.0), ("B", None), ("EUN", 5.0)])
    out = {r["iso3c"]: r for r in P.per_capita_share(food, seafood, population, groups).collect()}
    assert set(out) == {"A", "E", "N", "EUN"}
    a = out["A"]
    assert (a["SSF"], a["SSF_per_capita"], a["total"], a["ASF"]) == (1095.0, 3.0, 17.0, 7.0)
    assert a["perc_SSF"] == pytest.approx(300 / 17) and a["perc_SSF_ASF"] == pytest.approx(300 / 7)
    assert out["E"]["perc_SSF"] == 0.0
    assert out["N"]["perc_SSF"] is None  # zero population


# ---- reports and sweeps ------------------------------------------------------

@pytest.fixture
def supply(table):
    schema = FOOD + ", consump double"
    return table(schema, [
        ("A", "Iron", "Artisanal", 1.0, 9.0), ("A", "Iron", "Import", 3.0, 8.0),
        ("A", "Omega-3 fatty acids", "Subsistence", 2.0, 7.0), ("A", "Protein", "Industrial", 5.0, 6.0),
        ("B", "Iron", "aquaculture", 0.0, 1.0),
    ])


def test_sector_profile_sums_to_100(supply):
    profile = reports.sector_percent_profile(supply, with_imports=True)
    sums = {tuple(r)[:2]: r["s"] for r in profile.groupBy("iso3c", "nutrient").agg(F.sum("percent_consump").alias("s")).collect()}
    assert sums == {("A", "Iron"): 100.0, ("A", "DHA+EPA"): 100.0, ("B", "Iron"): None}
    assert reports.sector_percent_profile(supply).filter("sector = 'Imports'").count() == 0
    assert profile.filter("sector_no is null").count() == 0


def test_residual_key_changes_country_means(supply):
    clean = reports.seafood_share(supply).filter("iso3c = 'A' and nutrient = 'Iron'")
    sparse = reports.seafood_share(supply, keep_residual=True).filter("iso3c = 'A' and nutrient = 'Iron'")
    assert rows(clean) == [("A", "Iron", 25.0)]
    assert rows(sparse) == [("A", "Iron", 0.0), ("A", "Iron", 100.0)]


def test_sector_contribution_mean(supply):
    out = {tuple(r)[:2]: r[2] for r in reports.sector_contribution_mean(supply).collect()}
    assert out[("A", "Artisanal")] == pytest.approx(25 / 3)
    assert out[("B", "Aquaculture")] is None and len(out) == 12


def test_splice_and_caps(table):
    seafood = table("iso3c string, nutrient string, perc_SSF double", [("A", "DHA+EPA", 80.0), ("A", "Iron", 1.0)])
    percent = table("iso3c string, nutrient string, perc_SSF double", [("A", "DHA+EPA", 5.0), ("A", "Iron", 30.0), ("A", None, 9.0)])
    spliced = reports.nutrient_splice(seafood, percent)
    assert rows(spliced) == [("A", "DHA+EPA", 80.0), ("A", "Iron", 30.0)]
    assert rows(reports.capped_shares(spliced)) == [("A", "DHA+EPA", 80.0), ("A", "Iron", 20.0)]
    assert rows(reports.country_mean_share(spliced)) == [("A", 55.0)]


@pytest.fixture
def shares(table):
    return table("iso3c string, perc_SSF double", [(f"C{i}", float(i)) for i in range(10)] + [("N", None)])


@pytest.fixture
def intake(table):
    known = [(f"C{i}", float(9 - i)) for i in range(9)]
    return table("iso3 string, intake double", known + [("X1", 50.0), ("X2", 60.0), ("N", 1.0)])


def test_vulnerability_class(shares, intake):
    out = {r["iso3c"]: r for r in reports.vulnerability_class(shares, intake).collect()}
    assert len(out) == 11
    assert out["C9"]["q_SSF"] == 1.0 and out["C9"]["category"] is None and out["C9"]["is_3"] is None
    assert out["C8"]["category"] == "Less vulnerable but reliant"
    # intake 9 ranks 10th of 12 because the whole intake table is the population
    assert out["C0"]["q_intake"] == pytest.approx(10 / 12) and out["C0"]["category"] == "Vulnerable but less reliant"
    assert out["C6"]["is_dep"] == 0  # 0.7 is not above the cut
    assert out["N"]["q_SSF"] is None and out["N"]["category"] is None


def test_sweep_at_the_cut_equals_the_single_run(shares, intake):
    single = reports.vulnerability_class(shares, intake).select("iso3c", "category")
    swept = sweeps.threshold_sweep(reports.reliance_scores(shares, intake))
    assert swept.count() == 6 * 11
    assert rows(swept.filter("threshold = 0.7").select("iso3c", "category")) == rows(single)


def test_cross_scenario_uses_the_baseline(shares, intake):
    doubled = shares.withColumn("perc_SSF", F.col("perc_SSF") * 2)
    out = sweeps.cross_scenario_score(doubled, intake, shares)
    q = {r["iso3c"]: r["q_SSF"] for r in out.collect()}
    assert q["C4"] == 0.9 and q["C9"] == 1.0


def test_map_feed(table):
    places = table(
        "iso3 string, country string, continent string, area_sqkm double",
        [("A", "a", "Asia", 100.0), ("B", "b", "Europe", 50.0), ("C", "c", "Asia", 10.0), ("D", "d", None, 5.0), ("E", "e", "Asia", 9e5)],
    )
    metric = table("iso3c string, m double", [("A", 1.0), ("B", 1.0), ("C", 2.0), ("D", 1.0), ("E", 1.0)])
    feed, small = reports.map_feed(metric, places, "m")
    assert feed.count() == 5 and [r["iso3"] for r in small.collect()] == ["C", "A"]


def test_population_sweep_equals_single_runs(food, seafood, groups, table):
    pops = table("iso3c string, km_10 double, km_20 double", [("A", 1.0, 2.0), ("N", None, 4.0)])
    omega = table("iso3c string, nutrient string, perc_SSF double", [("A", "DHA+EPA", 60.0)])
    swept = sweeps.population_sweep(food, seafood, pops, groups, omega, bands=["km_10", "km_20"])
    for band in ("km_10", "km_20"):
        single = P.per_capita_share(food, seafood, pops.select("iso3c", F.col(band).alias("pop")), groups)
        want = rows(reports.country_mean_share(reports.nutrient_splice(omega, single)))
        assert rows(swept.filter(F.col("band") == band).drop("band")) == want


def test_sector_contribution_vs_asf(food, seafood, groups, table):
    percent = P.per_capita_share(food, seafood, table("iso3c string, pop double", [("A", 1.0)]), groups)
    out = {r["sector"]: r["perc_cont"] for r in reports.sector_contribution_vs_asf(percent).collect()}
    assert out["Artisanal"] == pytest.approx(100 * 2 / 7) and out["Import"] == 0.0 and "Aquaculture" in out


def test_full_chain(spark, table, aquaculture_wide, trade_wide, catch, countries, profile, food_base):
    src = sweeps.Sources(
        aquaculture_wide=aquaculture_wide, trade_wide=trade_wide,
        balance_wide=table(
            "country string, iso3c string, FAOSTAT_group string, element string, unit string, `2017` string",
            [("Chile", "CHL", "Crustaceans", "Food exports", "t", "4"), ("Chile", "CHL", "Crustaceans", "Production", "t", "9"),
             ("Chile", "CHL", "Crustaceans", "Food imports", "t", "12")],
        ),
        catch=catch, countries=countries,
        species_nutrients=table(
            "species string, genus_cat string, nutrient string, value double",
            [("penaeus", "Crustaceans", "Iron", 2.0), ("krill", "Crustaceans", "Iron", 4.0)],
        ),
        edible=literal_table(spark, C.EDIBLE_SHARE, "genus_cat", "edible"),
        food_base=food_base.withColumn("_c1", F.lit("CHL")).limit(2),
        denied=table("countries string, iso string", []),
        groups=table("iso3c string, group string", [("CHL", "south")]),
        populations=table("iso3c string, km_20 double", [("CHL", 1000.0)]),
    )
    base = sweeps.percent_supply(src).collect()
    kept = sweeps.retention_scenario(src, years=sweeps.Years()).collect()
    assert len(base) == len(kept) == 1
    # Exports 0 after re-exports (4 - 5 < 0): all 7 t artisanal and 7 t farmed are eaten at home.
    assert base[0]["Artisanal"] == pytest.approx(7 * 0.8 * 2 * 10000)
    assert base[0]["aquaculture"] == pytest.approx(7 * 0.8 * 2 * 10000)
    assert base[0]["Import"] == pytest.approx(7 * 0.8 * 3 * 10000)
    assert kept[0]["Artisanal"] == pytest.approx(base[0]["Artisanal"])
    assert 0 < base[0]["perc_SSF"] <= 100


# ---- nutrients beside each other -------------------------------------------------


def wide_case(table):
    edible = table(
        "iso3c string, production_sector string, scientific_name string, genus_cat string, pred_consumption double",
        [("A", "x", "cod", "Fish", 2.0), ("A", "x", "cod", "Fish", -1.0), ("A", "x", None, "Fish", 3.0),
         ("A", "y", "eel", None, 0.5), ("A", "y", "unlisted", "Fish", 9.0), ("B", "x", None, None, 4.0),
         (None, None, "cod", None, 1.5), ("B", "y", "cod", "Fish", None), ("B", "y", "cod", "Fish", 0.0),
         ("B", "x", "eel", "Fish", -2.0), ("C", "x", "cod", "Fish", float("nan"))],
    )
    species = table(
        "scientific_name string, nutrient string, value double",
        [("cod", "iron", 1.0), ("cod", "iron", 3.0), ("cod", "zinc", -2.0), ("cod", None, 5.0),
         ("eel", "iron", None), ("eel", "zinc", 0.0), ("eel", "zinc", -0.5), (None, "iron", 70.0)],
    )
    categories = table(
        "genus_cat string, nutrient string, value double",
        [("Fish", "iron", 0.25), ("Fish", "zinc", None), (None, "zinc", 8.0)],
    )
    return edible, species, categories


def test_nutrients_beside_each_other_give_the_same_supply(table):
    edible, species, categories = wide_case(table)
    nutrients = N.profile_nutrients(species.unionByName(categories.withColumnRenamed("genus_cat", "scientific_name")))
    assert nutrients == ["iron", "zinc", None]
    long = N.nutrient_supply(N.nutrient_fanout(edible, species, categories))
    wide = N.nutrient_supply(N.nutrient_fanout(edible, species, categories, nutrients=nutrients), nutrients=nutrients)
    assert wide.columns == long.columns
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(wide) == shown(long) and wide.count() >= 6


def test_supply_beside_each_other_exchanges_only_sums_by_country(table):
    edible, species, categories = wide_case(table)
    nutrients = ["iron", "zinc", None]
    made = N.nutrient_supply(N.nutrient_fanout(edible, species, categories, nutrients=nutrients), nutrients=nutrients)
    plan = made._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(dealt) == 1 and "iso3c" in dealt[0] and "scientific_name" not in dealt[0]


def test_a_profile_of_many_nutrients_is_not_laid_out(table):
    profile = table("nutrient string", [(str(k),) for k in range(N.MOST_BESIDE + 1)])
    assert N.profile_nutrients(profile) is None
    assert N.profile_nutrients(profile.limit(0)) is None

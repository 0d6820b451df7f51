"""Registered queries: joins, aggregates, distributions, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.catalogue import ctes as S, frames as A
from supplyloom.catalogue.basics import known_balance
from supplyloom.catalogue.registry import Tables, query
from supplyloom.operators import aggregates, joins, ranking, unions
from supplyloom.operators.mapping import case_normalise
from supplyloom.plans import nutrients as N, per_capita as P, production as R, reports, trade as T
from supplyloom.operators.reshape import param_column
from supplyloom.plans import sweeps
from supplyloom.sources.storage import settle, settle_together


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Final measures to a fixed number of digits, for comparison across engines."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def giga(df: DataFrame, *cols: str) -> DataFrame:
    """Large supplies in 1e9 units, rounded."""
    return df.withColumns({c: F.round(F.col(c) / F.lit(1e9), 12) for c in cols})


def trade(t: Tables) -> DataFrame:
    return R.trade_flows(A.trade_wide(t), A.BASE_YEAR)


def catch(t: Tables) -> DataFrame:
    return R.categorised_catch(A.catch(t), A.countries(t))


def aquaculture(t: Tables) -> DataFrame:
    return R.aquaculture_aggregate(A.aquaculture_wide(t), A.BASE_YEAR)


def adjusted(t: Tables) -> DataFrame:
    balance = T.food_balance(A.balance_wide(t), A.BASE_YEAR)
    return T.trade_balance_adjust(balance, R.reexport_ratios(trade(t)))


FLOW_IDS = ["country", "iso3c", "species_group", "year", "genus_cat"]


def flow_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    return T.flow_split(settle(adjusted(t), "balance"), FLOW_IDS)


def percent(
    t: Tables, supply: DataFrame | None = None, stored_food: DataFrame | None = None
) -> DataFrame:
    supply = supply if supply is not None else A.supply(t)
    return P.per_capita_share(
        stored_food if stored_food is not None else food(t), supply, param_column(A.populations(t), C.DEFAULT_POPULATION_BAND, ["iso3c"]),
        A.groups(t), [A.ANCHOR],
    )


def food_long(t: Tables, base_year: int | None = A.BASE_YEAR) -> DataFrame:
    return P.food_base_long(A.food_base(t), A.denied(t), base_year)


def food(t: Tables) -> DataFrame:
    return P.food_group_supply(food_long(t), A.BASE_YEAR)


def spliced(t: Tables, drop_unknown: bool = True) -> DataFrame:
    supply = settle(A.supply(t), "supply")
    shares = reports.seafood_share(supply)
    return reports.nutrient_splice(shares, percent(t, supply), drop_unknown=drop_unknown)


def years(**kw) -> sweeps.Years:
    return sweeps.Years(**{**dict.fromkeys(["aquaculture", "trade", "balance", "food"], A.BASE_YEAR), **kw})


def fanned(t: Tables) -> DataFrame:
    src = A.sources(t)
    consumption = sweeps.total_consumption(src, years=years(), summed=True)
    profile = settle(src.species_nutrients, "profile")
    return N.nutrient_fanout(
        N.edible_portion_scale(consumption, src.edible),
        N.species_profile(profile),
        N.category_median_profile(profile),
    )


# ---- joins -------------------------------------------------------------------

@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, s_name
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <> 7""")
def dim_enrich(t: Tables) -> DataFrame:
    dim = t.supplier.select("s_suppkey", "s_name")
    known = F.when(F.col("l_linenumber") != 7, F.col("l_suppkey"))  # others find no supplier
    return joins.dim_enrich(
        t.lineitem.select("l_orderkey", "l_linenumber", known.alias("l_suppkey")),
        dim, "l_suppkey", "s_suppkey", "s_name",
    )


@query(S.sql("""
SELECT l.iso3c, l.genus_cat, l.tonnes, r.late
FROM (SELECT iso3c, genus_cat, sum(l_quantity) AS tonnes FROM flows GROUP BY 1, 2) l
LEFT JOIN (SELECT CASE WHEN l_linenumber > 3 THEN iso3c || '-' || year ELSE iso3c END AS iso3c,
                  genus_cat, sum(l_quantity) AS late FROM flows GROUP BY 1, 2) r
  ON l.iso3c IS NOT DISTINCT FROM r.iso3c AND l.genus_cat IS NOT DISTINCT FROM r.genus_cat""", "flows"))
def natural_left_join(t: Tables) -> DataFrame:
    rows = A.flows(t)
    left = rows.groupBy("iso3c", "genus_cat").agg(F.sum("l_quantity").alias("tonnes"))
    # Keys of later lines match nothing on the left.
    apart = F.concat_ws("-", "iso3c", F.col("year").cast("string"))
    moved = rows.withColumn("iso3c", F.when((F.col("l_linenumber") > 3) & F.col("iso3c").isNotNull(), apart).otherwise(F.col("iso3c")))
    right = moved.groupBy("iso3c", "genus_cat").agg(F.sum("l_quantity").alias("late"))
    return joins.natural_left_join(left, right)


SPECIES_FACTS = """
SELECT country, lower(scientific_name) AS scientific_name, genus_cat, sum(l_quantity) AS tonnes
FROM flows GROUP BY 1, 2, 3"""


def species_facts(t: Tables) -> DataFrame:
    rows = case_normalise(A.flows(t), "scientific_name")
    return rows.groupBy("country", "scientific_name", "genus_cat").agg(
        F.sum("l_quantity").alias("tonnes")
    )


@query(S.sql(f"""
SELECT f.*, p.nutrient, p.value FROM ({SPECIES_FACTS}) f
LEFT JOIN profile p ON f.scientific_name IS NOT DISTINCT FROM p.species""", "flows", "profile"))
def fanout_join(t: Tables) -> DataFrame:
    return joins.fanout_join(
        species_facts(t), N.species_profile(A.species_nutrients(t)), "scientific_name"
    )


@query(S.sql("""
SELECT l.iso3c, l.genus_cat, l.tonnes, r.tonnes AS first_export
FROM (SELECT iso3c, genus_cat, sum(l_quantity) AS tonnes FROM flows GROUP BY 1, 2) l
LEFT JOIN (SELECT * FROM (SELECT iso3c, genus_cat, year, sum(l_quantity) AS tonnes FROM flows
           WHERE l_returnflag = 'R' AND l_discount >= 0.09 AND l_linenumber = 1 GROUP BY 1, 2, 3)
           QUALIFY row_number() OVER (PARTITION BY iso3c, genus_cat ORDER BY year) = 1) r
  ON l.iso3c = r.iso3c AND l.genus_cat = r.genus_cat""", "flows"))
def first_match_lookup(t: Tables) -> DataFrame:
    rows = A.flows(t)
    left = rows.groupBy("iso3c", "genus_cat").agg(F.sum("l_quantity").alias("tonnes"))
    sold = rows.filter(
        (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09) & (F.col("l_linenumber") == 1)
    )
    right = sold.groupBy("iso3c", "genus_cat", "year").agg(F.sum("l_quantity").alias("tonnes"))
    return joins.first_match_lookup(
        left, right, ["iso3c", "genus_cat"], ["year"], "tonnes", "first_export"
    )


@query(S.sql(f"""
SELECT f.*, p.nutrient, round(p.value, 6) AS value FROM ({SPECIES_FACTS}) f
LEFT JOIN (SELECT 'species' AS tier, species AS key, nutrient, value FROM profile
           UNION ALL SELECT 'category', genus_cat, nutrient, value FROM medians) p
  ON p.tier = CASE WHEN scientific_name IS NULL THEN 'category' ELSE 'species' END
 AND p.key IS NOT DISTINCT FROM coalesce(scientific_name, genus_cat)""", "flows", "profile", "medians"))
def two_tier_join(t: Tables) -> DataFrame:
    profile = A.species_nutrients(t)
    joined = joins.two_tier_join(
        species_facts(t), N.species_profile(profile), N.category_median_profile(profile)
    )
    return rounded(joined, "value")


@query(S.sql("""
SELECT iso3c, lower(scientific_name) AS scientific_name, c.genus_cat, pred_consumption_whole,
       round(pred_consumption_whole * e.edible, 6) AS pred_consumption
FROM (SELECT iso3c, genus_cat, scientific_name, sum(l_quantity) AS pred_consumption_whole
      FROM flows GROUP BY 1, 2, 3) c
LEFT JOIN edible e ON c.genus_cat IS NOT DISTINCT FROM e.genus_cat""", "flows", "edible"))
def edible_portion_scale(t: Tables) -> DataFrame:
    eaten = A.flows(t).groupBy("iso3c", "genus_cat", "scientific_name").agg(
        F.sum("l_quantity").alias("pred_consumption")
    )
    return rounded(N.edible_portion_scale(eaten, A.edible(t)), "pred_consumption").drop("edible")


# ---- aggregates --------------------------------------------------------------

@query(S.sql("""
SELECT iso3c, genus_cat, isscaap_group AS "ISSCAAP_group", trade_flow AS "Trade_flow",
       sum(tonnes) AS tonnes
FROM trade GROUP BY ALL""", "trade"))
def category_totals(t: Tables) -> DataFrame:
    return R.category_totals(trade(t))


@query(S.sql(f"""
SELECT country, iso3c, genus_cat, exports AS "Exports", imports AS "Imports",
       reexports AS "Reexports", round({S.pct('reexports', 'imports')}, 6) AS perc_imp_reexport,
       round({S.pct('reexports', 'exports')}, 6) AS perc_exports_reexport
FROM reexports""", "reexports"))
def reexport_ratios(t: Tables) -> DataFrame:
    return rounded(R.reexport_ratios(trade(t)), "perc_imp_reexport", "perc_exports_reexport")


@query(S.sql(f"""
SELECT country, iso3c, tonnes_freshwater, tonnes,
       round({S.pct('tonnes_freshwater', 'tonnes')}, 6) AS prop_exports_freshwater
FROM (SELECT country, iso3c, sum(tonnes) AS tonnes,
             sum(tonnes) FILTER (WHERE isscaap_group = {S.lit(C.FRESHWATER_CRUSTACEANS)}) AS tonnes_freshwater
      FROM trade WHERE genus_cat = 'Crustaceans' AND trade_flow = 'Exports' GROUP BY 1, 2)
WHERE tonnes_freshwater IS NOT NULL""", "trade"))
def subset_share(t: Tables) -> DataFrame:
    return rounded(R.freshwater_crustacean_share(trade(t)), "prop_exports_freshwater")


@query(S.sql("SELECT * FROM traded", "traded"))
def sector_catch_aggregate(t: Tables) -> DataFrame:
    return R.sector_catch_aggregate(catch(t))


@query(S.sql("SELECT * FROM aquac", "aquac"))
def aquaculture_aggregate(t: Tables) -> DataFrame:
    return aquaculture(t)


@query(S.sql("""
SELECT iso3c, sum(exports) AS "exports_FB", sum(imports) AS "imports_FB"
FROM adjusted GROUP BY 1""", "adjusted"))
def flow_country_totals(t: Tables) -> DataFrame:
    exports, imports = flow_tables(t)
    return T.flow_country_totals(unions.production_union(exports, imports))


@query(f"""
SELECT {S.case('p_type', A.TYPE_CATEGORY)} AS genus_cat, p_brand AS nutrient,
       round(quantile_cont(CASE WHEN p_size > 5 THEN p_retailprice END, 0.5), 6) AS value
FROM part GROUP BY 1, 2""")
def category_median_profile(t: Tables) -> DataFrame:
    rows = t.part.select(
        A.lookup("p_type", A.TYPE_CATEGORY).alias("genus_cat"), F.col("p_brand").alias("nutrient"),
        F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("value"),
    )
    return rounded(N.category_median_profile(rows), "value")


@query(S.sql("""
SELECT iso3c, production_sector, round(sum(pred_consumption), 6) AS consump
FROM fanned GROUP BY 1, 2""", "fanned"))
def sector_consumption(t: Tables) -> DataFrame:
    return rounded(N.sector_consumption(fanned(t)), "consump")


@query(S.sql("""
SELECT iso3c, nutrient, production_sector, round(nut_supply / 1e9, 12) AS nut_supply,
       round(sum(weight) OVER (PARTITION BY iso3c, production_sector), 6) AS consump
FROM (SELECT iso3c, nutrient, production_sector, sum(nut_supply) AS nut_supply,
             sum(pred_consumption) AS weight
      FROM fanned GROUP BY 1, 2, 3)""", "fanned"))
def nutrient_supply(t: Tables) -> DataFrame:
    return rounded(giga(N.nutrient_supply(fanned(t)), "nut_supply"), "consump")


@query(S.sql(f"""
SELECT products, round(coalesce(sum(value), 0), 6) AS value FROM food_long
WHERE products <> {S.lit(C.TOTAL_PRODUCT)} AND nutrient = {S.lit(C.OMEGA3_LONG)}
GROUP BY 1""", "food_long"))
def product_nutrient_total(t: Tables) -> DataFrame:
    return rounded(P.product_nutrient_total(food_long(t, None)), "value")


@query(S.sql("""
SELECT iso3c, production_sector, nutrient, round(nut_supply, 6) AS nut_supply FROM food""", "food"))
def food_group_supply(t: Tables) -> DataFrame:
    return rounded(food(t), "nut_supply")


@query(S.sql("""
SELECT iso3c, round(avg("perc_SSF"), 6) AS "perc_SSF" FROM seafood_share GROUP BY 1""",
    "seafood_share"))
def country_mean_share(t: Tables) -> DataFrame:
    return rounded(reports.country_mean_share(reports.seafood_share(A.supply(t))), "perc_SSF")


@query(S.sql("""
SELECT iso3, round(intake, 6) AS intake, round(sd, 6) AS intake_sd,
       round(CASE WHEN intake - sd < 0 THEN 0 ELSE intake - sd END, 6) AS intake_low,
       round(intake + sd, 6) AS intake_high
FROM (SELECT iso3, CASE WHEN count(perc_deficient) = count(*) THEN avg(perc_deficient) END AS intake,
             CASE WHEN count(perc_deficient) = count(*) THEN stddev_samp(perc_deficient) END AS sd
      FROM deficiency GROUP BY 1)""", "deficiency"))
def intake_summary(t: Tables) -> DataFrame:
    return rounded(
        aggregates.intake_summary(A.deficiency(t)),
        "intake", "intake_sd", "intake_low", "intake_high",
    )


@query(S.sql(f"""
SELECT m.iso3c, round(m."perc_SSF", 6) AS "perc_SSF", round(lo, 6) AS "perc_SSF_min",
       round(hi, 6) AS "perc_SSF_max", round(sd, 6) AS "perc_SSF_sd",
       round(CASE WHEN m."perc_SSF" - sd < 0 THEN 0 ELSE m."perc_SSF" - sd END, 6) AS "perc_SSF_low",
       round(m."perc_SSF" + sd, 6) AS "perc_SSF_high"
FROM shares m LEFT JOIN (
  SELECT iso3c, min("perc_SSF") AS lo, max("perc_SSF") AS hi, stddev_samp("perc_SSF") AS sd
  FROM percent WHERE nutrient <> {S.lit(C.OMEGA3_SHORT)} GROUP BY 1) s ON m.iso3c = s.iso3c""",
    "shares", "percent"))
def uncertainty_band(t: Tables) -> DataFrame:
    supply = settle(A.supply(t), "supply")
    per_person = settle(percent(t, supply), "percent")
    means = reports.nutrient_splice(reports.seafood_share(supply), per_person)
    others = per_person.filter(F.col("nutrient") != C.OMEGA3_SHORT)
    band = aggregates.uncertainty_band(means, others)
    return rounded(band, *[c for c in band.columns if c != "iso3c"])


@query(S.sql(f"""
SELECT nutrient, round(max("perc_SSF_ASF"), 6) AS "max_perc_SSF_ASF",
       round(min("perc_SSF_ASF"), 6) AS "min_perc_SSF_ASF",
       round(avg("perc_SSF_ASF"), 6) AS "perc_SSF_ASF"
FROM percent WHERE nutrient <> {S.lit(C.OMEGA3_SHORT)} GROUP BY 1""", "percent"))
def nutrient_range_stats(t: Tables) -> DataFrame:
    rows = percent(t).filter(F.col("nutrient") != C.OMEGA3_SHORT)
    stats = aggregates.range_stats(rows, ["nutrient"], "perc_SSF_ASF")
    return rounded(stats, "max_perc_SSF_ASF", "min_perc_SSF_ASF", "perc_SSF_ASF")


@query(S.sql("""
SELECT round(avg("perc_SSF"), 6) AS "perc_SSF", round(avg("perc_SSF_ASF"), 6) AS "perc_SSF_ASF"
FROM percent""", "percent"))
def overall_means(t: Tables) -> DataFrame:
    means = aggregates.overall_means(percent(t), ["perc_SSF", "perc_SSF_ASF"])
    return rounded(means, "perc_SSF", "perc_SSF_ASF")


@query(S.sql("""
SELECT continent, nutrient, round(CASE WHEN count(s."perc_SSF") = count(*) THEN avg(s."perc_SSF") END, 6) AS "perc_SSF"
FROM seafood_share s
LEFT JOIN (SELECT iso3, continent FROM places WHERE area_sqkm IS NOT NULL) p ON s.iso3c = p.iso3
GROUP BY 1, 2""", "seafood_share", "places"))
def region_rollup(t: Tables) -> DataFrame:
    dim = A.places(t).dropna(subset=["area_sqkm"])
    return rounded(
        aggregates.region_rollup(
            reports.seafood_share(A.supply(t)), dim, "iso3", "perc_SSF", ["continent", "nutrient"]
        ),
        "perc_SSF",
    )


@query(S.sql("""
SELECT nutrient, coalesce(sum(ndeficient), 0) AS def, round(avg(perc_deficient), 6) AS intake
FROM deficiency GROUP BY 1""", "deficiency"))
def deficiency_by_nutrient(t: Tables) -> DataFrame:
    return rounded(aggregates.deficiency_by_nutrient(A.deficiency(t)), "intake")


@query("""
WITH rows AS (
  SELECT l_returnflag AS sector, p_type AS nutrient,
         CASE WHEN l_linenumber < 7
              THEN l_extendedprice / CASE WHEN l_quantity < 3 THEN 1 ELSE 40 END END AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT sector, nutrient, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
             quantile_cont(price, 0.75) AS q3
      FROM rows GROUP BY 1, 2),
placed AS (SELECT rows.*, q1, median, q3,
                  price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) AS outside
           FROM rows JOIN q USING (sector, nutrient) WHERE price IS NOT NULL)
SELECT sector, nutrient, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3,
       round(min(price) FILTER (WHERE NOT outside), 8) AS whisker_low,
       round(max(price) FILTER (WHERE NOT outside), 8) AS whisker_high,
       count(*) AS n, count(*) FILTER (WHERE outside) AS n_outliers
FROM placed GROUP BY sector, nutrient, placed.q1, placed.median, placed.q3""")
def boxplot_stats(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice") / F.when(F.col("l_quantity") < 3, F.lit(1.0)).otherwise(40.0)
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("sector"), F.col("p_type").alias("nutrient"),
        F.when(F.col("l_linenumber") < 7, price).alias("price"),
    )
    stats, _ = ranking.boxplot_stats(rows, "price", ["sector", "nutrient"])
    return rounded(stats, "q1", "median", "q3", "whisker_low", "whisker_high", digits=8)


@query("""
SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey
                           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) = 1""")
def distinct_first(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return joins.distinct_first(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])


@query(S.sql("SELECT DISTINCT iso3c, genus_cat FROM flows", "flows"))
def distinct_keys(t: Tables) -> DataFrame:
    return aggregates.distinct_keys(A.flows(t), ["iso3c", "genus_cat"])


# ---- windows and distributions -----------------------------------------------

ALLOCATED = """
SELECT iso3c, year, genus_cat, scientific_name, common_name, production_sector, tonnes,
       round(prop_catch, 9) AS prop_catch, round(exported, 6) AS pred_exp_catch,
       round(CASE WHEN consumed < 0 THEN 0 ELSE consumed END, 6) AS pred_consumption,
       round(CASE WHEN consumed < 0 THEN consumed WHEN consumed >= 0 THEN 0 END, 6) AS negative_values
FROM allocated"""


@query(S.sql(ALLOCATED, "allocated"))
def proportional_allocation(t: Tables) -> DataFrame:
    balance, produced = settle_together(
        (adjusted(t), "balance"),
        (R.commercial_production(catch(t), aquaculture(t)), "production"),
    )
    exports, _ = T.flow_split(balance, FLOW_IDS)
    shared = T.allocated_consumption(produced, exports)
    shared = rounded(shared, "prop_catch", digits=9)
    return rounded(shared, "pred_exp_catch", "pred_consumption", "negative_values").drop(
        "country", "pred_consumed_catch"
    )


@query("""
WITH reference AS (SELECT c_acctbal AS v FROM customer WHERE c_acctbal >= 0),
     n AS (SELECT count(*)::DOUBLE AS total FROM reference)
SELECT s_suppkey, balance,
       round(CASE WHEN balance IS NOT NULL
             THEN (SELECT count(*) FROM reference WHERE v <= balance)::DOUBLE / total END, 9) AS q
FROM (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance FROM supplier), n""")
def ecdf_rank(t: Tables) -> DataFrame:
    scored = t.supplier.select("s_suppkey", known_balance("s_acctbal").alias("balance"))
    reference = t.customer.select(known_balance("c_acctbal").alias("v"))
    return rounded(ranking.ecdf_rank(scored, "balance", "q", reference, "v"), "q", digits=9)


def classes(t: Tables) -> DataFrame:
    shares = reports.country_mean_share(spliced(t))
    intake = aggregates.intake_summary(A.deficiency(t), with_band=False)
    return reports.vulnerability_class(shares, intake)


@query(S.sql("""
SELECT continent, category, count(*) AS n,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY continent), 6) AS perc
FROM classes JOIN places ON classes.iso3c = places.iso3 GROUP BY 1, 2""", "classes", "places"))
def category_distribution(t: Tables) -> DataFrame:
    placed = joins.natural_left_join(
        classes(t), A.places(t).select(F.col("iso3").alias("iso3c"), "continent")
    )
    return rounded(ranking.category_distribution(placed, "category", ["continent"]), "perc")


@query(S.sql("""
SELECT category, count(*) AS n,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS perc
FROM classes WHERE intake > 45 GROUP BY 1""", "classes"))
def filtered_distribution(t: Tables) -> DataFrame:
    return rounded(
        ranking.filtered_distribution(classes(t), F.col("intake") > 45, "category"), "perc"
    )


@query("""
SELECT 1 AS id, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem
ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey LIMIT 1""")
def row_number_pick(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return ranking.row_number_pick(t.lineitem.select(*order), order)


# ---- unions and order --------------------------------------------------------

@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer
ORDER BY balance DESC NULLS LAST, c_custkey""")
def ordered_output(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", known_balance("c_acctbal").alias("balance"))
    return unions.ordered_output(rows, [("balance", True), ("c_custkey", False)])


@query(S.sql("SELECT * FROM production", "production"))
def production_union(t: Tables) -> DataFrame:
    return R.commercial_production(catch(t), aquaculture(t))


@query(S.sql("""
SELECT iso3c, year, genus_cat, common_name, scientific_name, production_sector,
       round(pred_consumption, 6) AS pred_consumption
FROM consumption""", "consumption"))
def consumption_union(t: Tables) -> DataFrame:
    return rounded(sweeps.total_consumption(A.sources(t), years=years()), "pred_consumption")


@query(S.sql("""
SELECT iso3, country, continent, coalesce(area_sqkm, 10) AS area_sqkm FROM places""", "places"))
def dimension_union(t: Tables) -> DataFrame:
    dim = A.places(t)
    return unions.dimension_union(
        dim.filter(F.col("area_sqkm").isNotNull()),
        dim.filter(F.col("area_sqkm").isNull()).drop("area_sqkm"),
    )

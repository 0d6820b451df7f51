"""Registered queries: several scenarios, ranks and summaries at once, and source order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from supplyloom.catalogue import ctes as S, frames as A, relational as Q
from supplyloom.catalogue.basics import known_balance
from supplyloom.catalogue.jobs import CLASS_COLUMNS, class_columns
from supplyloom.catalogue.registry import Tables, query
from supplyloom.functions.nulls import fixed_mean as mean, strict
from supplyloom.operators import aggregates, joins, ranking
from supplyloom.plans import scenarios
from supplyloom.sources import delimited
from supplyloom.sources.storage import fresh_path

# ---- scenario as a column ----------------------------------------------------

S.cte("supply_traded", """
SELECT iso3c, nutrient, production_sector, sum(nut_supply) AS nut_supply
FROM fanned GROUP BY 1, 2, 3""", "fanned")
S.cte("absent_traded", S.absent("supply_traded"), "food", "supply_traded")
S.cte("filled_traded", S.filled("absent_traded"), "absent_traded", "groups", "group_supply", "food")
S.cte("food_wide_traded", S.food_wide("filled_traded", "supply_traded"), "filled_traded", "supply_traded")
S.cte("percent_traded", S.per_person(S.with_pop("food_wide_traded")), "food_wide_traded", "populations")
S.cte("percent_scenarios", """
SELECT 'traded' AS scenario, * FROM percent_traded
UNION ALL BY NAME SELECT 'retained' AS scenario, * FROM percent_industrial""",
      "percent_traded", "percent_industrial")


def shares_of(t: Tables) -> DataFrame:
    return scenarios.scenario_shares(A.sources(t), years=Q.years(), group_codes=[A.ANCHOR])


@query(S.sql("""
SELECT scenario, iso3c, nutrient, pop, round("SSF" / 1e9, 12) AS "SSF",
       round("perc_SSF", 6) AS "perc_SSF", round("perc_SSF_ASF", 6) AS "perc_SSF_ASF"
FROM percent_scenarios""", "percent_scenarios"))
def scenario_shares(t: Tables) -> DataFrame:
    kept = shares_of(t).select("scenario", "iso3c", "nutrient", "pop", "SSF", "perc_SSF", "perc_SSF_ASF")
    return Q.rounded(Q.giga(kept, "SSF"), "perc_SSF", "perc_SSF_ASF")


def fixed_mean(measure: str) -> str:
    """Mean of known values in fixed point."""
    return f"CAST(sum(CAST({measure} AS DECIMAL(26, 12))) AS DOUBLE) / count({measure})"


for _name in ("traded", "retained"):
    S.cte(f"mean_{_name}", f"""
SELECT iso3c, {fixed_mean('"perc_SSF"')} AS "perc_SSF" FROM percent_scenarios
WHERE scenario = '{_name}' GROUP BY 1""", "percent_scenarios")
S.cte("scores_by_scenario", S.scored(S.ranked("mean_retained", "mean_traded")),
      "mean_retained", "mean_traded", "intake")


@query(S.sql(f"""
SELECT 'retained' AS scenario, {CLASS_COLUMNS} FROM ({S.classes('scores_by_scenario')})""",
    "scores_by_scenario"))
def scenario_score(t: Tables) -> DataFrame:
    intake = aggregates.intake_summary(A.deficiency(t), with_band=False)
    return class_columns(scenarios.scenario_score(shares_of(t), intake))


# ---- several distributions in one exchange -----------------------------------



@query("""
WITH reference AS (SELECT c_acctbal AS v FROM customer WHERE c_acctbal >= 0),
     scored AS (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance,
                       CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS place,
                       round(s_acctbal / 1000.0::DOUBLE) AS tied FROM supplier)
SELECT s_suppkey, balance, place, tied,
       round(CASE WHEN balance IS NOT NULL THEN (SELECT count(*) FROM reference WHERE v <= balance)::DOUBLE
             / (SELECT count(*) FROM reference) END, 9) AS q_balance,
       round(CASE WHEN place IS NOT NULL THEN (SELECT count(*) FROM scored b WHERE b.place <= a.place)::DOUBLE
             / (SELECT count(place) FROM scored) END, 9) AS q_place,
       round((SELECT count(*) FROM scored b WHERE b.tied <= a.tied)::DOUBLE
             / (SELECT count(tied) FROM scored), 9) AS q_tied
FROM scored a""")
def ecdf_ranks(t: Tables) -> DataFrame:
    scored = t.supplier.select(
        "s_suppkey", known_balance("s_acctbal").alias("balance"),
        F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey")).alias("place"),
        F.round(F.col("s_acctbal") / F.lit(1000.0)).alias("tied"),
    )
    reference = t.customer.select(known_balance("c_acctbal").alias("v"))
    ranked = ranking.ecdf_ranks(scored, [
        ranking.Rank("balance", "q_balance", reference, "v"),
        ranking.Rank("place", "q_place"),
        ranking.Rank("tied", "q_tied"),
    ])
    return Q.rounded(ranked, "q_balance", "q_place", "q_tied", digits=9)


# ---- sums in fixed point -----------------------------------------------------

@query(f"""
SELECT l_suppkey, {fixed_mean('l_discount * l_tax')} AS mean_charge,
       CASE WHEN count(nullif(l_tax, 0.08)) = count(*) THEN {fixed_mean('l_extendedprice / 7')} END AS strict_price
FROM lineitem GROUP BY 1""")
def fixed_means(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_suppkey", (F.col("l_discount") * F.col("l_tax")).alias("charge"),
        (F.col("l_extendedprice") / F.lit(7)).alias("price"), F.nullif("l_tax", F.lit(0.08)).alias("tax"),
    )
    return rows.groupBy("l_suppkey").agg(
        mean("charge").alias("mean_charge"), strict(mean("price"), "tax").alias("strict_price")
    )


# ---- grouping sets -----------------------------------------------------------

SUMMARY_SETS = [[], ["continent"], ["nutrient"], ["continent", "nutrient"]]


def summary(measure: str) -> str:
    strict = f"CASE WHEN count({measure}) = count(*) THEN {fixed_mean(measure)} END"
    name = measure.strip('"')
    return f"""
       round({fixed_mean(measure)}, 6) AS "{name}", round({strict}, 6) AS "strict_{name}",
       round(min({measure}), 6) AS "min_{name}", round(max({measure}), 6) AS "max_{name}\""""


@query(S.sql(f"""
SELECT CASE grouping(continent) * 2 + grouping(nutrient) WHEN 3 THEN 'overall' WHEN 2 THEN 'nutrient'
            WHEN 1 THEN 'continent' ELSE 'continent+nutrient' END AS level,
       continent, nutrient, count(*) AS n, {summary('"perc_SSF"')}, {summary('"perc_SSF_ASF"')}
FROM (SELECT p.*, continent FROM percent p
      LEFT JOIN (SELECT iso3, continent FROM places WHERE area_sqkm > 5000) d ON p.iso3c = d.iso3)
GROUP BY GROUPING SETS ((), (continent), (nutrient), (continent, nutrient))""", "percent", "places"))
def summary_sets(t: Tables) -> DataFrame:
    known = A.places(t).filter(F.col("area_sqkm") > 5000)
    placed = joins.natural_left_join(
        Q.percent(t), known.select(F.col("iso3").alias("iso3c"), "continent"), ["iso3c"]
    )
    made = aggregates.summary_sets(placed, SUMMARY_SETS, ["perc_SSF", "perc_SSF_ASF"])
    return Q.rounded(made, *[c for c in made.columns if "perc" in c])


# ---- source order ------------------------------------------------------------

@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey
                           ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""")
def first_in_source(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    path = fresh_path(t.spark, "source-order")
    # Files numbered by their place in the order, as a sorted export has them.
    delimited.csv_sink(rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"), path)
    schema = "l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_extendedprice double"
    return joins.first_in_source(delimited.csv_scan(t.spark, path, schema), ["l_suppkey"])

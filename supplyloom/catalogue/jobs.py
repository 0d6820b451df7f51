"""Registered queries: composite jobs and sensitivity sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.catalogue import ctes as S, frames as A, relational as Q
from supplyloom.catalogue.registry import Tables, query
from supplyloom.operators import aggregates, unions
from supplyloom.plans import per_capita as P, production as R, reports, sweeps
from supplyloom.sources.storage import settle

SHORT = S.lit(C.OMEGA3_SHORT)


@query(S.sql("SELECT * FROM direct", "direct"))
def direct_consumption(t: Tables) -> DataFrame:
    return R.direct_consumption(Q.catch(t))


@query(S.sql("""
SELECT iso3c, species_group, genus_cat, pred_reexports, imports, exports,
       round(perc_reexp, 6) AS perc_reexp
FROM adjusted""", "adjusted"))
def trade_balance_adjust(t: Tables) -> DataFrame:
    return Q.rounded(
        Q.adjusted(t).select(
            "iso3c", "species_group", "genus_cat", "pred_reexports", "imports", "exports", "perc_reexp"
        ),
        "perc_reexp",
    )


@query(S.sql("""
SELECT country, iso3c, species_group, year, genus_cat, 'exports' AS element, exports AS tonnes FROM adjusted
UNION ALL SELECT country, iso3c, species_group, year, genus_cat, 'imports', imports FROM adjusted""",
    "adjusted"))
def flow_split(t: Tables) -> DataFrame:
    return unions.production_union(*Q.flow_tables(t))


@query(S.sql("SELECT iso3c FROM absent", "absent"))
def missing_detect(t: Tables) -> DataFrame:
    return P.missing_detect(Q.food(t), A.supply(t))


@query(S.sql("""
SELECT iso3c, nutrient, production_sector, round(nut_supply, 6) AS nut_supply FROM filled""", "filled"))
def group_fallback_fill(t: Tables) -> DataFrame:
    filled = P.group_fallback_fill(
        settle(Q.food(t), "food"), A.supply(t), A.groups(t), [A.ANCHOR]
    )
    return Q.rounded(filled, "nut_supply")


PERCENT = """
SELECT iso3c, nutrient, pop, "SSF", round("ASF", 6) AS "ASF", round(ssf_pc, 9) AS "SSF_per_capita",
       round(total, 6) AS total, round("perc_SSF", 6) AS "perc_SSF",
       round("perc_SSF_ASF", 6) AS "perc_SSF_ASF"
FROM """


def percent_columns(df: DataFrame) -> DataFrame:
    kept = df.select(
        "iso3c", "nutrient", "pop", "SSF", "ASF", "SSF_per_capita", "total", "perc_SSF", "perc_SSF_ASF"
    )
    kept = Q.rounded(kept, "SSF_per_capita", digits=9)
    return Q.rounded(kept, "ASF", "total", "perc_SSF", "perc_SSF_ASF")


@query(S.sql(PERCENT + "percent", "percent"))
def per_capita_share(t: Tables) -> DataFrame:
    return percent_columns(Q.percent(t))


PROFILE_SQL = "\nUNION ALL ".join(
    f"SELECT iso3c, nutrient, {S.lit(C.SECTOR_SHARE_LABELS[name])} AS sector, "
    f"{S.pct(chr(34) + part + chr(34), 'total')} AS percent_consump FROM seafood"
    for part, name in [
        ("Artisanal", "perc_artisanal"), ("Subsistence", "perc_subsistence"),
        ("Industrial", "perc_industrial"), ("Import", "perc_import"),
        ("Recreational", "perc_Recreational"), ("aquaculture", "perc_aquaculture"),
    ]
)


def numbered(levels) -> dict:
    return {v: i for i, v in enumerate(levels, 1)}


@query(S.sql(f"""
SELECT iso3c, CASE WHEN nutrient IN {S.names(C.NUTRIENT_LEVELS)} THEN nutrient END AS nutrient, sector,
       round(percent_consump, 6) AS percent_consump,
       {S.case('sector', numbered(C.SECTOR_LEVELS_WITH_IMPORTS))} AS sector_no,
       {S.case('nutrient', numbered(C.NUTRIENT_LEVELS))} AS nutrient_no
FROM ({PROFILE_SQL}) WHERE nutrient <> 'Protein'""", "seafood"))
def sector_percent_profile(t: Tables) -> DataFrame:
    profile = reports.sector_percent_profile(A.supply(t), with_imports=True)
    return Q.rounded(profile, "percent_consump")


@query(S.sql(f"""
SELECT iso3c, CASE sector WHEN 'Imports' THEN 'Import' WHEN 'Mariculture' THEN 'Aquaculture' ELSE sector END AS sector,
       round(avg(percent_consump), 6) AS perc_cont
FROM ({PROFILE_SQL}) GROUP BY 1, 2""", "seafood"))
def sector_contribution_mean(t: Tables) -> DataFrame:
    return Q.rounded(reports.sector_contribution_mean(A.supply(t)), "perc_cont")


VS_ASF = "\nUNION ALL ".join(
    f"SELECT iso3c, {S.lit('Aquaculture' if s == 'aquaculture' else s)} AS sector, "
    f"{S.pct(f'({chr(34)}{s}{chr(34)} / nullif(pop, 0) / 365.0::DOUBLE)', 'asf2')} AS perc "
    f"FROM percent WHERE nutrient <> {SHORT}"
    for s in C.SEAFOOD_SECTORS
)


@query(S.sql(f"""
SELECT iso3c, sector, round(avg(CASE WHEN perc > 100 THEN 100 ELSE perc END), 6) AS perc_cont
FROM ({VS_ASF}) GROUP BY 1, 2""", "percent"))
def sector_contribution_vs_asf(t: Tables) -> DataFrame:
    return Q.rounded(reports.sector_contribution_vs_asf(Q.percent(t)), "perc_cont")


@query(S.sql("""
SELECT iso3c, nutrient, round("perc_SSF", 6) AS "perc_SSF" FROM spliced""", "spliced"))
def nutrient_splice(t: Tables) -> DataFrame:
    return Q.rounded(Q.spliced(t), "perc_SSF")


CLASS_COLUMNS = """iso3c, round("perc_SSF", 6) AS "perc_SSF", round(intake, 6) AS intake,
       round("q_SSF", 9) AS "q_SSF", round(q_intake, 9) AS q_intake, is_dep, is_def,
       combined_score, category, is_3"""


def class_columns(df: DataFrame) -> DataFrame:
    return Q.rounded(Q.rounded(df, "q_SSF", "q_intake", digits=9), "perc_SSF", "intake")


@query(S.sql(f"SELECT {CLASS_COLUMNS} FROM classes", "classes"))
def vulnerability_class(t: Tables) -> DataFrame:
    return class_columns(Q.classes(t))


FEED = """
SELECT iso3, country, continent, area_sqkm, round(s."perc_SSF", 6) AS "perc_SSF"
FROM places LEFT JOIN shares s ON places.iso3 = s.iso3c"""


@query(S.sql(f"""
SELECT *, 'all' AS layer FROM ({FEED})
UNION ALL
SELECT *, 'small' FROM ({FEED}) WHERE "perc_SSF" IS NOT NULL AND area_sqkm <= 25000
                                   AND continent <> 'EUROPE'""", "places", "shares"))
def map_feed(t: Tables) -> DataFrame:
    shares = settle(reports.country_mean_share(Q.spliced(t)), "shares")
    shares = Q.rounded(shares, "perc_SSF")
    feed, small = reports.map_feed(shares, A.places(t), "perc_SSF", excluded="EUROPE")
    return unions.production_union(
        feed.withColumn("layer", F.lit("all")), small.withColumn("layer", F.lit("small"))
    )


# ---- sweeps ------------------------------------------------------------------

THRESHOLDS = "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in C.SWEEP_THRESHOLDS) + ") AS h(threshold)"


@query(S.sql(
    "SELECT threshold, iso3c, is_dep, is_def, category FROM ("
    + S.classes(f"(SELECT * FROM scores, {THRESHOLDS})", "threshold", "threshold, ") + ")",
    "scores"))
def threshold_sweep(t: Tables) -> DataFrame:
    scores = reports.reliance_scores(
        reports.country_mean_share(Q.spliced(t, drop_unknown=False)),
        aggregates.intake_summary(A.deficiency(t), with_band=False),
    )
    return sweeps.threshold_sweep(scores).select(
        "threshold", "iso3c", "is_dep", "is_def", "category"
    )


def band_rows() -> str:
    return " UNION ALL ".join(
        f"""SELECT {S.lit(b)} AS band, iso3c, "perc_SSF" FROM ({S.per_person(S.with_pop('food_wide', b))})
        WHERE nutrient <> {SHORT}
        UNION ALL SELECT {S.lit(b)}, iso3c, "perc_SSF" FROM residual_share WHERE nutrient = {SHORT}"""
        for b in C.POPULATION_BANDS
    )


@query(S.sql(f"""
SELECT band, iso3c, round(avg("perc_SSF"), 6) AS "perc_SSF" FROM ({band_rows()}) GROUP BY 1, 2""",
    "food_wide", "populations", "residual_share"))
def population_sweep(t: Tables) -> DataFrame:
    supply = settle(A.supply(t), "supply")
    swept = sweeps.population_sweep(
        Q.food(t), supply, A.populations(t), A.groups(t),
        reports.seafood_share(supply, keep_residual=True), group_codes=[A.ANCHOR],
    )
    return Q.rounded(swept, "perc_SSF")


@query(S.sql("""
SELECT iso3c, nutrient, pop, round("SSF" / 1e9, 12) AS "SSF",
       round("perc_SSF", 6) AS "perc_SSF", round("perc_SSF_ASF", 6) AS "perc_SSF_ASF"
FROM percent_industrial""", "percent_industrial"))
def retention_scenario(t: Tables) -> DataFrame:
    shares = sweeps.retention_scenario(A.sources(t), years=Q.years(), group_codes=[A.ANCHOR])
    kept = shares.select("iso3c", "nutrient", "pop", "SSF", "perc_SSF", "perc_SSF_ASF")
    return Q.rounded(Q.giga(kept, "SSF"), "perc_SSF", "perc_SSF_ASF")


def scenario_rows(percent: str) -> str:
    """Mean shares with the supply of one nutrient from the residual-key pivot."""
    return f"""
SELECT iso3c, avg("perc_SSF") AS "perc_SSF" FROM (
  SELECT iso3c, "perc_SSF" FROM {percent} WHERE nutrient <> {SHORT}
  UNION ALL SELECT iso3c, "perc_SSF" FROM residual_share WHERE nutrient = {SHORT})
GROUP BY 1"""


S.cte("shares_traded", scenario_rows("percent"), "percent", "residual_share")
S.cte("shares_retained", scenario_rows("percent_industrial"), "percent_industrial", "residual_share")
S.cte("scores_retained", S.scored(S.ranked("shares_retained", "shares_traded")),
      "shares_retained", "shares_traded", "intake")


@query(S.sql(f"SELECT {CLASS_COLUMNS} FROM ({S.classes('scores_retained')})", "scores_retained"))
def cross_scenario_score(t: Tables) -> DataFrame:
    supply = settle(A.supply(t), "supply")
    residual = reports.seafood_share(supply, keep_residual=True)

    def mean(percent: DataFrame) -> DataFrame:
        return reports.country_mean_share(
            reports.nutrient_splice(residual, percent, drop_unknown=False)
        )

    # Both scenarios have the same food.
    food = settle(Q.food(t), "food")
    retained = sweeps.retention_scenario(
        A.sources(t), years=Q.years(), group_codes=[A.ANCHOR], food=food
    )
    intake = aggregates.intake_summary(A.deficiency(t), with_band=False)
    return class_columns(
        sweeps.cross_scenario_score(mean(retained), intake, mean(Q.percent(t, supply, food)))
    )

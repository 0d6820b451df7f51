"""Sensitivity runs: thresholds, populations, retention, scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.operators.aggregates import mean_share
from supplyloom.operators.joins import natural_left_join
from supplyloom.operators.mapping import code_recode
from supplyloom.operators.reshape import param_column, unpivot_named
from supplyloom.operators.unions import consumption_union, production_union
from supplyloom.plans import nutrients as N, per_capita as P, production as R, reports, trade as T
from supplyloom.sources.storage import settle, settle_together


def threshold_sweep(
    scores: DataFrame, thresholds: Sequence[float] = C.SWEEP_THRESHOLDS
) -> DataFrame:
    """Classes for several thresholds; ranks are computed once and rows expanded."""
    expanded = scores.withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    )
    return reports.with_classes(expanded, F.col("threshold"))


def population_sweep(
    food: DataFrame, seafood: DataFrame, populations: DataFrame, groups: DataFrame,
    omega3_share: DataFrame,
    bands: Sequence[str] = C.POPULATION_BANDS,
    group_codes: Sequence[str] = C.GROUP_AS_COUNTRY,
) -> DataFrame:
    """Country mean share for every population column in one pass.

    The supply table does not depend on population, so it is built once and
    joined to the unpivoted bands.
    """
    wide = P.complete_supply(food, seafood, groups, group_codes)
    people = unpivot_named(
        populations.select("iso3c", *bands), ["iso3c"], bands, "band", "pop"
    )
    peopled = natural_left_join(wide, people, ["iso3c"]).dropna(subset=["pop"])
    shares = code_recode(P.per_person(peopled), "nutrient", {C.OMEGA3_LONG: C.OMEGA3_SHORT})
    every_band = omega3_share.filter(F.col("nutrient") == C.OMEGA3_SHORT).select(
        F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"), "iso3c", "perc_SSF"
    )
    spliced = production_union(
        shares.filter(F.col("nutrient") != C.OMEGA3_SHORT).select("band", "iso3c", "perc_SSF"),
        every_band,
    )
    return mean_share(spliced, ["band", "iso3c"], "perc_SSF")


@dataclass(frozen=True)
class Sources:
    """The input tables of a full run."""

    aquaculture_wide: DataFrame
    trade_wide: DataFrame
    balance_wide: DataFrame
    catch: DataFrame
    countries: DataFrame
    species_nutrients: DataFrame
    edible: DataFrame
    food_base: DataFrame
    denied: DataFrame
    groups: DataFrame
    populations: DataFrame


@dataclass(frozen=True)
class Years:
    """Base year per source; the sources do not share one."""

    aquaculture: int = 2019
    trade: int = 2019
    balance: int = 2017
    food: int = 2019


ALL_RETAINED_YEARS = Years(food=2017)


def total_consumption(
    src: Sources, traded_sectors: Sequence[str] = C.TRADED_SECTORS, years: Years = Years(),
    summed: bool = False,
) -> DataFrame:
    """Production to consumption: harmonise, adjust for trade, allocate, stack.

    Retained catch is stacked row by row.  With ``summed`` it comes by production
    keys, which is all that supply needs, and catch is read once.  Production and
    the adjusted balance are each read twice and stored in between; catch by production
    keys is stored already.
    """
    catch = R.categorised_catch(src.catch, src.countries)
    if summed:
        traded, retained = R.traded_and_retained(catch, traded_sectors)
    else:
        traded = R.sector_catch_aggregate(catch, traded_sectors)
        retained = R.direct_consumption(catch, traded_sectors)
    aquaculture = R.aquaculture_aggregate(src.aquaculture_wide, years.aquaculture)
    reexports = R.reexport_ratios(R.trade_flows(src.trade_wide, years.trade))
    balance = T.food_balance(src.balance_wide, years.balance)
    ids = [c for c in balance.columns if c not in C.BALANCE_ELEMENTS]
    made = aquaculture if summed else production_union(traded, aquaculture)
    made, adjusted = settle_together(
        (made, "production"), (T.trade_balance_adjust(balance, reexports), "balance")
    )
    produced = production_union(traded, made) if summed else made
    exports, imports = T.flow_split(adjusted, ids)
    return consumption_union(
        T.allocated_consumption(produced, exports),
        retained,
        imports,
    )


def seafood_nutrient_supply(
    src: Sources, traded_sectors: Sequence[str] = C.TRADED_SECTORS, years: Years = Years()
) -> DataFrame:
    edible = N.edible_portion_scale(total_consumption(src, traded_sectors, years, summed=True), src.edible)
    profile = settle(src.species_nutrients, "profile")
    nutrients = N.profile_nutrients(profile)
    fanned = N.nutrient_fanout(
        edible, N.species_profile(profile), N.category_median_profile(profile), nutrients=nutrients
    )
    return N.nutrient_supply(fanned, nutrients=nutrients)


def base_year_food(src: Sources, years: Years) -> DataFrame:
    """Food supply of the base year by country, food group and nutrient."""
    long = P.food_base_long(src.food_base, src.denied, years.food)
    return P.food_group_supply(long, years.food)


def percent_supply(
    src: Sources,
    traded_sectors: Sequence[str] = C.TRADED_SECTORS,
    years: Years = Years(),
    band: str = C.DEFAULT_POPULATION_BAND,
    group_codes: Sequence[str] = C.GROUP_AS_COUNTRY,
    food: DataFrame | None = None,
) -> DataFrame:
    """The whole chain from raw tables to per-person shares.

    ``food`` may hand over the food supply of the base year, if it is stored already.
    """
    seafood = seafood_nutrient_supply(src, traded_sectors, years).drop("consump")
    return P.per_capita_share(
        food if food is not None else base_year_food(src, years),
        seafood,
        param_column(src.populations, band, ["iso3c"]),
        src.groups,
        group_codes,
    )


def retention_scenario(
    src: Sources,
    traded_sectors: Sequence[str] = C.TRADED_SECTORS_ALL_RETAINED,
    years: Years = ALL_RETAINED_YEARS,
    band: str = C.DEFAULT_POPULATION_BAND,
    group_codes: Sequence[str] = C.GROUP_AS_COUNTRY,
    food: DataFrame | None = None,
) -> DataFrame:
    """The same chain with artisanal catch kept in the country."""
    return percent_supply(src, traded_sectors, years, band, group_codes, food)


def cross_scenario_score(
    scenario: DataFrame, intake: DataFrame, baseline: DataFrame, **kw
) -> DataFrame:
    """Classes of a scenario's shares ranked within the baseline distribution."""
    return reports.vulnerability_class(scenario, intake, baseline=baseline, **kw)

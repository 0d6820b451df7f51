"""Several scenarios in one run: the scenario is a column.

Scenarios differ in one step, which sectors are traded and which are eaten where
they are landed.  Catch is summed by production key before it is tagged, so facts are
read and summed once however many scenarios there are; from there on every key
starts with the scenario, and the rest of the chain runs once for all of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.functions.nulls import in_set, strict_sum
from supplyloom.operators.aggregates import mean_share
from supplyloom.operators.cleaning import membership_filter
from supplyloom.operators.reshape import param_column
from supplyloom.operators.unions import consumption_union, production_union
from supplyloom.plans import nutrients as N, per_capita as P, production as R, reports, trade as T
from supplyloom.plans.per_capita import SCENARIO, tagged
from supplyloom.plans.sweeps import Sources, Years, base_year_food
from supplyloom.sources.storage import settle, settle_together

#: Traded sectors by scenario: the reported trade, and all artisanal catch kept.
RETENTION: dict[str, Sequence[str]] = {
    "traded": C.TRADED_SECTORS,
    "retained": C.TRADED_SECTORS_ALL_RETAINED,
}


def scenario_split(
    catch: DataFrame, scenarios: Mapping[str, Sequence[str]] = RETENTION,
    dropped_uses: Sequence[str] = C.NON_FOOD_END_USES,
) -> tuple[DataFrame, DataFrame]:
    """(traded catch, retained catch) of all scenarios by scenario and production key.

    An unknown catch makes a traded sum unknown and is left out of retained sums.
    Gains and losses are retained as rows of their own.
    """
    kept = membership_filter(catch, drop={"end_use_name": dropped_uses}).withColumnsRenamed(
        {"fishing_entity": "country", "sector_type": "production_sector"}
    )
    value = F.col("catch")
    summed = kept.groupBy(*R.PRODUCTION_KEYS).agg(
        strict_sum("catch").alias("tonnes"),
        F.sum(F.when(value >= 0, value)).alias("_gain"),
        F.sum(F.when(value < 0, value)).alias("_loss"),
    )
    sides = [
        F.struct(F.lit(name).alias(SCENARIO), in_set("production_sector", sectors).alias("traded"))
        for name, sectors in scenarios.items()
    ]
    summed = settle(summed, "catch").withColumn("_side", F.explode(F.array(*sides)))
    rows = summed.withColumn(SCENARIO, F.col(f"_side.{SCENARIO}"))
    retained = rows.filter(~F.col("_side.traded")).withColumn(
        "pred_consumption", F.explode(F.array("_gain", "_loss"))
    )
    keys = [SCENARIO, *R.PRODUCTION_KEYS]
    return (
        rows.filter("_side.traded").select(*keys, "tonnes"),
        retained.dropna(subset=["pred_consumption"]).select(*keys, "pred_consumption"),
    )


def scenario_consumption(
    src: Sources, scenarios: Mapping[str, Sequence[str]] = RETENTION, years: Years = Years()
) -> DataFrame:
    """Consumption of all scenarios: split, adjust for trade, allocate, stack.

    Aquaculture, the adjusted balance and imports do not differ between scenarios;
    their few rows are repeated.
    """
    names = list(scenarios)
    catch = R.categorised_catch(src.catch, src.countries)
    traded, retained = scenario_split(catch, scenarios)
    aquaculture = R.aquaculture_aggregate(src.aquaculture_wide, years.aquaculture)
    reexports = R.reexport_ratios(R.trade_flows(src.trade_wide, years.trade))
    balance = T.food_balance(src.balance_wide, years.balance)
    ids = [c for c in balance.columns if c not in C.BALANCE_ELEMENTS]
    # Catch is stored already.
    farmed, adjusted = settle_together(
        (aquaculture, "production"), (T.trade_balance_adjust(balance, reexports), "balance")
    )
    produced = production_union(traded, tagged(farmed, names))
    exports, imports = T.flow_split(adjusted, ids)
    order = [c for c in exports.columns if c not in ("iso3c", "genus_cat", "tonnes")]
    allocated = T.allocated_consumption(
        produced, tagged(exports, names), pair=(SCENARIO, "iso3c", "genus_cat"), export_order=order
    )
    return consumption_union(allocated, retained, tagged(imports, names), by=[SCENARIO])


def scenario_supply(
    src: Sources, scenarios: Mapping[str, Sequence[str]] = RETENTION, years: Years = Years()
) -> DataFrame:
    """Nutrient supply by scenario, country, nutrient and sector."""
    edible = N.edible_portion_scale(scenario_consumption(src, scenarios, years), src.edible)
    profile = settle(src.species_nutrients, "profile")
    nutrients = N.profile_nutrients(profile)
    fanned = N.nutrient_fanout(
        edible, N.species_profile(profile), N.category_median_profile(profile), [SCENARIO], nutrients
    )
    return N.nutrient_supply(fanned, [SCENARIO], nutrients)


def scenario_shares(
    src: Sources, scenarios: Mapping[str, Sequence[str]] = RETENTION, years: Years = Years(),
    band: str = C.DEFAULT_POPULATION_BAND, group_codes: Sequence[str] = C.GROUP_AS_COUNTRY,
) -> DataFrame:
    """Per-person shares of every scenario; the base years are the same for all."""
    return P.per_capita_share(
        base_year_food(src, years),
        scenario_supply(src, scenarios, years).drop("consump"),
        param_column(src.populations, band, ["iso3c"]),
        src.groups,
        group_codes,
        list(scenarios),
    )


def scenario_score(
    shares: DataFrame, intake: DataFrame, baseline: str = "traded", measure: str = "perc_SSF"
) -> DataFrame:
    """Classes of every other scenario's mean shares within the baseline's distribution."""
    means = settle(mean_share(shares, [SCENARIO, "iso3c"], measure), "scenario-means")
    return reports.vulnerability_class(
        means.filter(F.col(SCENARIO) != baseline), intake,
        baseline=means.filter(F.col(SCENARIO) == baseline).drop(SCENARIO),
    )

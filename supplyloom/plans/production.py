"""Harmonise aquaculture, trade and catch sources to one category system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.functions.nulls import in_set, pct, strict_sum
from supplyloom.operators.aggregates import subset_share, total_by
from supplyloom.operators.cleaning import membership_filter, positive_only, year_slice
from supplyloom.operators.joins import dim_enrich
from supplyloom.operators.mapping import category_map, conditional_override, text_match_scale
from supplyloom.operators.reshape import flow_pivot, token_split, unpivot_years
from supplyloom.operators.unions import ordered_output, production_union
from supplyloom.sources.storage import settle

PRODUCTION_KEYS = [
    "country", "iso3c", "year", "genus_cat", "scientific_name", "common_name", "production_sector",
]


def aquaculture_aggregate(
    wide: DataFrame, base_year: int, n_ids: int = 13, first_measure: int = 19,
    environment: str = "Marine",
) -> DataFrame:
    """Marine aquaculture of one year by country, category and species."""
    long = unpivot_years(wide, n_ids, first_measure, years=[base_year])
    marine = positive_only(long.filter(F.col("environment") == environment), "tonnes")
    labelled = category_map(marine, "FAOSTAT_group", "genus_cat", C.AQUACULTURE_CATEGORIES)
    labelled = year_slice(labelled, base_year).withColumn("production_sector", F.lit("aquaculture"))
    return total_by(labelled, PRODUCTION_KEYS, "tonnes", "tonnes")


def trade_flows(wide: DataFrame, base_year: int, n_ids: int = 10) -> DataFrame:
    """Trade of one year by mapped category, in live weight."""
    long = positive_only(unpivot_years(wide, n_ids, n_ids, years=[base_year]), "tonnes")
    tokens = token_split(long, "FAOSTAT_group", ["FAOSTAT_group_clean", "processing"], ",")
    mapped = category_map(tokens, "FAOSTAT_group_clean", "genus_cat", C.TRADE_CATEGORIES)
    return text_match_scale(
        mapped.dropna(subset=["genus_cat"]),
        "common_name", C.FILLET_MARK, "tonnes", C.FILLET_LIVE_WEIGHT_FACTOR,
    )


def category_totals(
    trade: DataFrame,
    keys: Sequence[str] = ("iso3c", "genus_cat", "ISSCAAP_group", "Trade_flow"),
    measure: str = "tonnes",
) -> DataFrame:
    return total_by(trade, keys, measure, measure)


def reexport_ratios(
    trade: DataFrame, keys: Sequence[str] = ("country", "iso3c", "genus_cat")
) -> DataFrame:
    """Re-exports as a percentage of imports and of exports, largest share first."""
    flows = total_by(trade, [*keys, "Trade_flow"], "tonnes", "tonnes")
    wide = flow_pivot(flows, keys, C.TRADE_FLOWS, C.PROCESSED_FLOW, "Reexports").withColumns(
        {
            "perc_imp_reexport": pct("Reexports", "Imports"),
            "perc_exports_reexport": pct("Reexports", "Exports"),
        }
    )
    return ordered_output(wide, [("perc_exports_reexport", True)])


def freshwater_crustacean_share(trade: DataFrame) -> DataFrame:
    """Freshwater part of crustacean exports per country, largest share first."""
    exports = trade.filter(
        (F.col("genus_cat") == "Crustaceans") & (F.col("Trade_flow") == "Exports")
    )
    share = subset_share(
        exports, ["country", "iso3c"], "tonnes",
        F.col("ISSCAAP_group") == C.FRESHWATER_CRUSTACEANS,
        "tonnes_freshwater", "tonnes", "prop_exports_freshwater",
    )
    return ordered_output(share, [("prop_exports_freshwater", True)])


def categorised_catch(catch: DataFrame, countries: DataFrame) -> DataFrame:
    """Catch with country codes and categories; unidentified fish get their own."""
    coded = dim_enrich(catch, countries, "fishing_entity", "missing_countries", "iso3c")
    mapped = category_map(coded, "functional_group", "genus_cat", C.CATCH_CATEGORIES)
    return conditional_override(
        mapped, "genus_cat", "scientific_name", C.UNIDENTIFIED_SPECIES, C.OVERRIDE_CATEGORY
    )


def sector_catch_aggregate(
    catch: DataFrame,
    traded_sectors: Sequence[str] = C.TRADED_SECTORS,
    dropped_uses: Sequence[str] = C.NON_FOOD_END_USES,
) -> DataFrame:
    """Catch of the traded sectors for food use, by the production keys."""
    kept = membership_filter(
        catch, keep={"sector_type": traded_sectors}, drop={"end_use_name": dropped_uses}
    ).withColumnsRenamed({"fishing_entity": "country", "sector_type": "production_sector"})
    return total_by(kept, PRODUCTION_KEYS, "catch", "tonnes")


def direct_consumption(
    catch: DataFrame,
    traded_sectors: Sequence[str] = C.TRADED_SECTORS,
    dropped_uses: Sequence[str] = C.NON_FOOD_END_USES,
) -> DataFrame:
    """Catch that never enters trade is consumed as it is."""
    kept = membership_filter(
        catch, drop={"sector_type": traded_sectors, "end_use_name": dropped_uses}
    ).withColumnsRenamed(
        {
            "fishing_entity": "country",
            "sector_type": "production_sector",
            "catch": "pred_consumption",
        }
    )
    return kept.select(*PRODUCTION_KEYS, "pred_consumption")


def traded_and_retained(
    catch: DataFrame,
    traded_sectors: Sequence[str] = C.TRADED_SECTORS,
    dropped_uses: Sequence[str] = C.NON_FOOD_END_USES,
) -> tuple[DataFrame, DataFrame]:
    """(traded catch, retained catch) by the production keys, from one pass over the catch.

    The same as ``sector_catch_aggregate`` and the sums of ``direct_consumption``:
    an unknown catch makes a traded sum unknown, while retained sums leave it out,
    as supply does later.  Retained gains and losses are summed apart.
    """
    kept = membership_filter(catch, drop={"end_use_name": dropped_uses}).withColumnsRenamed(
        {"fishing_entity": "country", "sector_type": "production_sector"}
    )
    traded = in_set("production_sector", traded_sectors)
    summed = settle(
        kept.withColumns({"_traded": traded, "_loss": ~traded & (F.col("catch") < 0)})
        .groupBy(*PRODUCTION_KEYS, "_traded", "_loss")
        .agg(strict_sum("catch").alias("tonnes"), F.sum("catch").alias("pred_consumption")),
        "catch",
    )
    return (
        summed.filter("_traded").select(*PRODUCTION_KEYS, "tonnes"),
        summed.filter(~F.col("_traded")).select(*PRODUCTION_KEYS, "pred_consumption"),
    )


def commercial_production(
    catch: DataFrame, aquaculture: DataFrame, traded_sectors: Sequence[str] = C.TRADED_SECTORS
) -> DataFrame:
    """Traded catch and aquaculture in one table."""
    return production_union(sector_catch_aggregate(catch, traded_sectors), aquaculture)

"""Adjust food balances for re-exports and allocate exports to producers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.functions.nulls import (
    floor_zero, if_else, not_in, pct, ratio, strict_sum,
)
from supplyloom.operators.aggregates import split_totals
from supplyloom.operators.cleaning import placeholder_clean, year_slice
from supplyloom.operators.joins import first_rows, natural_join, natural_left_join
from supplyloom.operators.mapping import category_map, clamp_negative
from supplyloom.operators.reshape import balance_pivot, unpivot_named, unpivot_years


def food_balance(wide: DataFrame, base_year: int, n_ids: int = 5) -> DataFrame:
    """Food balance of one year, one column per element, without freshwater fish."""
    long = unpivot_years(wide, n_ids, n_ids, years=[base_year], as_text=True)
    long = placeholder_clean(long, "tonnes", ["iso3c"])
    long = long.withColumnRenamed("FAOSTAT_group", "species_group")
    mapped = category_map(long, "species_group", "genus_cat", C.BALANCE_CATEGORIES)
    kept = year_slice(mapped.filter(not_in("genus_cat", [C.FRESHWATER_CATEGORY])), base_year)
    ids = [c for c in kept.columns if c not in ("element", "tonnes")]
    return balance_pivot(kept, ids, C.BALANCE_ELEMENTS)


def trade_balance_adjust(
    balance: DataFrame, reexports: DataFrame, export_fallback: str = "Food imports"
) -> DataFrame:
    """Take reported and predicted re-exports out of imports and exports.

    Unknown predictions fall back to a reported flow, then to 0.  The default
    fallback of exports is the reported *imports*; pass ``"Food exports"`` for
    the symmetric rule.
    """
    reported = reexports.select("iso3c", "genus_cat", "Reexports")
    bought, sold = F.col("Food imports"), F.col("Food exports")
    surplus = F.col("delta_exports")

    def known_or(pred: str, fallback):
        return floor_zero(F.coalesce(F.col(pred), fallback, F.lit(0).cast("double")))

    return (
        natural_left_join(balance, reported)
        .withColumn("delta_exports", sold - F.col("Production"))
        .withColumn("pred_reexports", if_else(surplus > 0, surplus, F.lit(0).cast("double")))
        .withColumns(
            {
                "pred_imports": bought - F.col("Reexports") - F.col("pred_reexports"),
                "pred_exports": sold - F.col("Reexports") - F.col("pred_reexports"),
            }
        )
        .withColumns(
            {
                "imports": known_or("pred_imports", bought),
                "exports": known_or("pred_exports", F.col(export_fallback)),
                "perc_reexp": pct("pred_reexports", sold),
            }
        )
    )


def flow_split(adjusted: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(exports, imports) as long tables with the given id columns."""
    flows = unpivot_named(adjusted, ids, ["imports", "exports"])
    return flows.filter(F.col("element") == "exports"), flows.filter(F.col("element") == "imports")


def flow_country_totals(flows: DataFrame, key: str = "iso3c") -> DataFrame:
    """Total exports and imports per country in one pass."""
    return split_totals(
        flows, [key], "element", "tonnes", {"exports": "exports_FB", "imports": "imports_FB"}
    )


def proportional_allocation(
    production: DataFrame,
    exports: DataFrame,
    pair: Sequence[str] = ("iso3c", "genus_cat"),
    export_order: Sequence[str] | None = None,
    measure: str = "tonnes",
) -> DataFrame:
    """Share out each pair's exports over its producers in proportion to tonnage.

    Totals are aggregated per pair and joined back rather than windowed, so a
    hot pair is pre-aggregated and its rows stay spread over many tasks.  Of
    several export rows of a pair the first in ``export_order`` counts (by
    default the remaining export columns in their order).  Rows without country
    or category belong to no pair and drop out.
    """
    pair = list(pair)
    if export_order is None:
        export_order = [c for c in exports.columns if c not in (*pair, measure)]
    producers = production.dropna(subset=pair)
    firsts = first_rows(
        exports.select(*pair, *export_order, F.col(measure).alias("_exports")), pair, export_order
    ).select(*pair, "_exports")
    totals = producers.groupBy(*pair).agg(strict_sum(measure).alias("_total"))
    per_pair = natural_join(totals, firsts, pair, "left", null_safe=False)
    placed = natural_join(producers, per_pair, pair, "left", null_safe=False)
    return (
        placed.withColumn("prop_catch", ratio(measure, "_total"))
        .withColumn(
            "pred_exp_catch",
            F.coalesce(F.col("prop_catch") * F.col("_exports"), F.lit(0).cast("double")),
        )
        .withColumn("pred_consumed_catch", F.col(measure) - F.col("pred_exp_catch"))
        .drop("_total", "_exports")
    )


def allocated_consumption(production: DataFrame, exports: DataFrame, **kw) -> DataFrame:
    """Allocation with the consumed part floored at 0 and the residue kept."""
    return clamp_negative(
        proportional_allocation(production, exports, **kw),
        "pred_consumed_catch", "pred_consumption", "negative_values",
    )

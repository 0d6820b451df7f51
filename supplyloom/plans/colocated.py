"""Jobs on stage tables that are stored by the key they are joined by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from supplyloom.plans.trade import proportional_allocation
from supplyloom.sources.storage import SLOT, heaviest_slot, settle_by

ROWS_PER_SLOT = 5_000_000


def allocation_in_place(
    production: DataFrame,
    exports: DataFrame,
    pair: Sequence[str] = ("iso3c", "genus_cat"),
    export_order: Sequence[str] | None = None,
    measure: str = "tonnes",
    buckets: int | None = None,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """``proportional_allocation`` on tables that are stored by pair.

    Production and exports cross the network once, when they are stored; the totals of
    a pair, its first export row and both joins then run where the rows lie.  A pair
    is one task's work there, so if one holds more than ``rows_per_slot`` rows the
    joins exchange by pair instead, which adaptive execution may split.
    """
    pair = list(pair)
    if export_order is None:
        export_order = [c for c in exports.columns if c not in (*pair, measure)]
    made = settle_by(production.dropna(subset=pair), pair, "production", buckets)
    if heaviest_slot(made) > rows_per_slot:
        return proportional_allocation(made.drop(SLOT), exports, pair, export_order, measure)
    sold = settle_by(exports.dropna(subset=pair), pair, "exports", buckets)
    sold = sold.select(SLOT, *export_order, measure)
    return proportional_allocation(made, sold, [SLOT], export_order, measure).drop(SLOT)

"""Country tables behind the figures: profiles, shares, classes, map feeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.functions.nulls import cap, if_else, not_in, pct, ratio
from supplyloom.operators.aggregates import mean_share
from supplyloom.operators.joins import natural_left_join
from supplyloom.operators.mapping import code_recode, lookup, ordered_levels, per_group_cap
from supplyloom.operators.ranking import Rank, ecdf_ranks
from supplyloom.operators.reshape import sector_pivot, unpivot_rest
from supplyloom.operators.unions import ordered_output, production_union
from supplyloom.sources.storage import settle_together


def _all_seafood() -> Column:
    total = F.col(C.SEAFOOD_SECTORS[0])
    for sector in C.SEAFOOD_SECTORS[1:]:
        total = total + F.col(sector)
    return total


def seafood_wide(supply: DataFrame, keep_residual: bool = False) -> DataFrame:
    """Seafood supply with a column per sector, their total and the small-scale sum.

    ``keep_residual`` leaves ``consump`` in the row key: one sparse row per
    sector, as in the sweeps' original tables.
    """
    wide = sector_pivot(
        supply, C.SEAFOOD_SECTORS, residual=["consump"] if keep_residual else []
    )
    wide = wide.withColumns(
        {"SSF": F.col("Artisanal") + F.col("Subsistence"), "total": _all_seafood()}
    )
    return code_recode(wide, "nutrient", {C.OMEGA3_LONG: C.OMEGA3_SHORT})


def seafood_share(supply: DataFrame, keep_residual: bool = False) -> DataFrame:
    """Small-scale percentage of seafood supply per country and nutrient."""
    return seafood_wide(supply, keep_residual).select(
        "iso3c", "nutrient", pct("SSF", "total").alias("perc_SSF")
    )


def sector_percent_profile(
    supply: DataFrame, with_imports: bool = False, dropped_nutrient: str = "Protein"
) -> DataFrame:
    """Percentage of seafood supply by sector, long, with ordered labels."""
    parts = ["SSF", "Artisanal", "Subsistence", "Industrial", "Import", "Recreational", "aquaculture"]
    shares = seafood_wide(supply).select(
        "iso3c",
        "nutrient",
        *[pct(p, "total").alias(name) for p, name in zip(parts, C.SECTOR_SHARE_LABELS)],
    )
    long = unpivot_rest(shares, ["iso3c", "nutrient"], "sector", "percent_consump")
    labelled = code_recode(long, "sector", C.SECTOR_SHARE_LABELS)
    dropped = ["Small-scale"] if with_imports else ["Imports", "Small-scale"]
    levels = C.SECTOR_LEVELS_WITH_IMPORTS if with_imports else C.SECTOR_LEVELS
    kept = labelled.filter((F.col("nutrient") != dropped_nutrient) & not_in("sector", dropped))
    kept = ordered_levels(kept, "sector", levels, "sector_no")
    return ordered_levels(kept, "nutrient", C.NUTRIENT_LEVELS, "nutrient_no")


def sector_contribution_mean(supply: DataFrame) -> DataFrame:
    """Mean over nutrients of each sector's percentage of seafood supply."""
    wide = seafood_wide(supply).drop("SSF").withColumnRenamed("aquaculture", "Aquaculture")
    long = unpivot_rest(wide, ["iso3c", "nutrient", "total"], "sector", "value")
    return mean_share(
        long.withColumn("perc_cont", pct("value", "total")), ["iso3c", "sector"], "perc_cont"
    )


def sector_contribution_vs_asf(percent: DataFrame) -> DataFrame:
    """Mean over nutrients of each sector's percentage of animal-source food."""
    kept = percent.filter(F.col("nutrient") != C.OMEGA3_SHORT).select(
        "iso3c", "nutrient", "ASF", F.col("pop").cast("double").alias("pop"),
        *[
            F.col(s).cast("double").alias("Aquaculture" if s == "aquaculture" else s)
            for s in C.SEAFOOD_SECTORS
        ],
    )
    long = unpivot_rest(kept, ["iso3c", "nutrient", "ASF", "pop"], "sector", "value")
    per_capita = ratio("value", "pop") / F.lit(float(C.DAYS_PER_YEAR))
    long = long.withColumn("per_capita", per_capita).withColumn(
        "perc_cont", cap(pct("per_capita", "ASF"), 100.0)
    )
    return mean_share(long, ["iso3c", "sector"], "perc_cont")


def nutrient_splice(
    seafood: DataFrame, percent: DataFrame, measure: str = "perc_SSF",
    nutrient: str = C.OMEGA3_SHORT, drop_unknown: bool = True,
) -> DataFrame:
    """One nutrient from the seafood shares, all others from the per-person shares.

    The classification leaves unknown shares out before it averages, so a country
    without any known share has no row; the sweeps keep them (``drop_unknown=False``).
    """
    cols = ["iso3c", "nutrient", measure]
    spliced = production_union(
        percent.filter(F.col("nutrient") != nutrient).select(*cols),
        seafood.filter(F.col("nutrient") == nutrient).select(*cols),
    )
    return spliced.dropna(subset=[measure]) if drop_unknown else spliced


def country_mean_share(spliced: DataFrame, measure: str = "perc_SSF") -> DataFrame:
    return mean_share(spliced, ["iso3c"], measure)


def capped_shares(
    spliced: DataFrame, measure: str = "perc_SSF", caps: Mapping[str, float] = C.CAPS_ALL_FOOD
) -> DataFrame:
    return per_group_cap(spliced, "nutrient", measure, caps)


def reliance_scores(
    shares: DataFrame, intake: DataFrame, baseline: DataFrame | None = None,
    key: str = "iso3c", intake_key: str = "iso3", rows_per_bucket: int | None = None,
) -> DataFrame:
    """Distribution ranks of reliance and of inadequate intake per country.

    Reliance is ranked within ``baseline`` shares (default: the shares
    themselves), intake within the whole intake table, not just the joined rows.
    All inputs are settled first: ranks are joined back by value.
    """
    inputs = [(shares, "shares"), (intake, "intake")]
    if baseline is not None:
        inputs.append((baseline, "baseline"))
    shares, intake, *rest = settle_together(*inputs)
    reference = rest[0] if rest else shares
    joined = natural_left_join(shares, intake.withColumnRenamed(intake_key, key), [key])
    ranks = [
        Rank("perc_SSF", "q_SSF", reference),
        Rank("intake", "q_intake", intake),
    ]
    return ecdf_ranks(joined, ranks, rows_per_bucket)


def with_classes(scores: DataFrame, threshold: Column | float = C.CLASS_THRESHOLD) -> DataFrame:
    """Threshold both ranks, add them to a code 0-3 and label it; unknown stays null."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    code = F.col("combined_score")
    return (
        scores.withColumn("is_dep", if_else(F.col("q_SSF") > limit, F.lit(1), F.lit(0)))
        .withColumn("is_def", if_else(F.col("q_intake") > limit, F.lit(2), F.lit(0)))
        .withColumn("combined_score", F.col("is_def") + F.col("is_dep"))
        .withColumn("category", lookup(code, dict(enumerate(C.CLASS_LEVELS))))
        .withColumn(
            "is_3",
            if_else(code == len(C.CLASS_LEVELS) - 1, F.lit(C.EMPHASIS_FULL), F.lit(C.EMPHASIS_MUTED)),
        )
    )


def vulnerability_class(
    shares: DataFrame, intake: DataFrame, threshold: float = C.CLASS_THRESHOLD,
    baseline: DataFrame | None = None, key: str = "iso3c", intake_key: str = "iso3",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Reliance and vulnerability class per country."""
    scores = reliance_scores(shares, intake, baseline, key, intake_key, rows_per_bucket)
    return with_classes(scores, threshold)


def map_feed(
    metric: DataFrame, places: DataFrame, measure: str,
    key: str = "iso3c", place_key: str = "iso3", max_area: float = C.SMALL_PLACE_AREA,
    excluded: str = C.EXCLUDED_CONTINENT,
) -> tuple[DataFrame, DataFrame]:
    """(all places with their metric, small places with a known metric by area)."""
    feed = natural_left_join(places, metric.withColumnRenamed(key, place_key), [place_key])
    small = feed.filter(
        F.col(measure).isNotNull()
        & (F.col("area_sqkm") <= max_area)
        & (F.col("continent") != excluded)
    )
    return feed, ordered_output(small, [("area_sqkm", False)])

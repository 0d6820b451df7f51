"""Nutrient supply of consumed seafood."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from supplyloom import constants as C
from supplyloom.operators.joins import natural_left_join, two_tier_join
from supplyloom.operators.mapping import case_normalise, code_recode
from supplyloom.operators.ranking import ROWS_PER_BUCKET, exact_quantiles
from supplyloom.sources.storage import settle_together

#: Nutrients that a fan-out holds beside each other at most.
MOST_BESIDE = 32


def species_profile(profile: DataFrame) -> DataFrame:
    return profile.select(F.col("species").alias("scientific_name"), "nutrient", "value")


def category_median_profile(
    profile: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Exact median nutrient value per category, used where no species is named."""
    unified = code_recode(profile, "genus_cat", C.PROFILE_CATEGORY_RECODE)
    return exact_quantiles(
        unified, "value", ["genus_cat", "nutrient"], {"value": 0.5}, rows_per_bucket
    )


def edible_portion_scale(consumption: DataFrame, edible: DataFrame) -> DataFrame:
    """Edible weight by category; the whole weight is kept alongside."""
    lowered = case_normalise(consumption, "scientific_name")
    return (
        natural_left_join(lowered, edible)
        .withColumn("pred_consumption_whole", F.col("pred_consumption"))
        .withColumn("pred_consumption", F.col("pred_consumption") * F.col("edible"))
    )


def nutrient_fanout(
    edible: DataFrame, species: DataFrame, categories: DataFrame, by: Sequence[str] = (),
    nutrients: Sequence[str | None] | None = None,
) -> DataFrame:
    """Positive nutrient supply per country, sector, profile key and nutrient (and ``by``).

    Supply is linear in weight, so weights are summed per profile key *before*
    the one-to-many join; positive and negative weights are kept apart because
    the positive-supply rule acts on each row.  With ``nutrients``, all that the profile
    names, they are columns instead of rows (see :func:`wide_fanout`).
    """
    if nutrients is not None:
        return wide_fanout(edible, species, categories, nutrients, by)
    weight = F.col("pred_consumption")
    by_category = F.when(F.col("scientific_name").isNull(), F.col("genus_cat"))
    compact = (
        edible.select(
            *by, "iso3c", "production_sector", "scientific_name",
            by_category.alias("genus_cat"), "pred_consumption",
        )
        .filter(weight != 0)
        .groupBy(*by, "iso3c", "production_sector", "scientific_name", "genus_cat")
        .agg(
            F.sum(F.when(weight > 0, weight)).alias("_gain"),
            F.sum(F.when(weight < 0, weight)).alias("_loss"),
        )
    )
    value = F.col("value")
    return (
        two_tier_join(compact, species, categories)
        .withColumn(
            "pred_consumption",
            F.when(value > 0, F.col("_gain")).when(value < 0, F.col("_loss")),
        )
        .drop("_gain", "_loss")
        .withColumn("nut_supply", value * F.col("pred_consumption") * C.PORTIONS_PER_TONNE)
        .filter(F.col("nut_supply") > 0)
    )


def profile_nutrients(profile: DataFrame) -> list[str | None] | None:
    """The nutrients that a stored profile names; None if it names none or too many to
    be held beside each other."""
    names = profile.select("nutrient").distinct().limit(MOST_BESIDE + 1).collect()
    return sorted((r[0] for r in names), key=lambda n: (n is None, n)) if 0 < len(names) <= MOST_BESIDE else None


def wide_profile(profile: DataFrame, key: str, nutrients: Sequence[str | None]) -> DataFrame:
    """One row per key: sums and numbers of each nutrient's values by sign, a column each.

    ``up0`` and ``ups0`` are the sum and number of the first nutrient's positive values,
    ``down0`` and ``downs0`` those of its negative ones.
    """
    value = F.col("value")
    aggs = []
    for k, name in enumerate(nutrients):
        own = F.col("nutrient").eqNullSafe(F.lit(name))
        for side, sign in (("up", value > 0), ("down", value < 0)):
            held = F.when(own & sign, value)
            aggs += [F.sum(held).alias(f"{side}{k}"), F.count(held).alias(f"{side}s{k}")]
    return profile.groupBy(key).agg(*aggs)


def wide_fanout(
    edible: DataFrame, species: DataFrame, categories: DataFrame,
    nutrients: Sequence[str | None], by: Sequence[str] = (),
) -> DataFrame:
    """:func:`nutrient_fanout` with nutrients beside each other, one row per consumption row.

    ``supply0`` and ``weight0`` are the first nutrient's positive supply and the weight
    behind it, null where there is none.  Rows stay as many as they are, so they need not
    be summed per profile key first, which costs an exchange of nearly all of them
    where few share a key, and the sums by country merge before they are exchanged.
    """
    keyed = edible.select(
        *by, "iso3c", "production_sector", "scientific_name", "genus_cat", "pred_consumption"
    ).filter(F.col("pred_consumption") != 0)
    carried = [f"{c}{k}" for k in range(len(nutrients)) for c in ("up", "ups", "down", "downs")]
    # Stored, their size is known, so a profile that is small is broadcast.
    named, unnamed = settle_together(
        (wide_profile(species, "scientific_name", nutrients), "species-profile"),
        (wide_profile(categories, "genus_cat", nutrients), "category-profile"),
    )
    joined = two_tier_join(keyed, named, unnamed, carried=carried)
    weight = F.col("pred_consumption")
    columns = []
    for k in range(len(nutrients)):
        value = F.when(weight > 0, F.col(f"up{k}")).when(weight < 0, F.col(f"down{k}"))
        times = F.when(weight > 0, F.col(f"ups{k}")).when(weight < 0, F.col(f"downs{k}"))
        columns += [
            (value * weight * C.PORTIONS_PER_TONNE).alias(f"supply{k}"),
            F.when(times > 0, times * weight).alias(f"weight{k}"),
        ]
    return joined.select(*by, "iso3c", "production_sector", *columns)


def wide_nutrient_supply(
    fanned: DataFrame, nutrients: Sequence[str | None], by: Sequence[str] = ()
) -> DataFrame:
    """:func:`nutrient_supply` of a :func:`wide_fanout`: sums come before the nutrients' rows."""
    sums = [F.sum(f"{c}{k}").alias(f"{c}{k}") for k in range(len(nutrients)) for c in ("supply", "weight")]
    wide = fanned.groupBy(*by, "iso3c", "production_sector").agg(*sums)
    each = [
        F.struct(
            F.lit(name).cast("string").alias("nutrient"), F.col(f"supply{k}").alias("nut_supply"),
            F.col(f"weight{k}").alias("_weight"),
        )
        for k, name in enumerate(nutrients)
    ]
    weights = [F.coalesce(F.col(f"weight{k}"), F.lit(0.0)) for k in range(len(nutrients))]
    total = reduce(lambda a, b: a + b, weights, F.lit(0.0))
    long = wide.select(
        *by, "iso3c", "production_sector", total.alias("consump"), F.explode(F.array(*each)).alias("_n")
    )
    return long.select(
        *by, "iso3c", "_n.nutrient", "production_sector", "_n.nut_supply", "consump"
    ).filter(F.col("nut_supply").isNotNull())


def zero_sum_of(pick, condition) -> Column:
    """The one consumption value of a sign that all nutrients of a key repeat, else 0."""
    return F.coalesce(pick(F.when(condition, F.col("pred_consumption"))), F.lit(0))


def sector_consumption(fanned: DataFrame, once: bool = False) -> DataFrame:
    """Edible consumption per country and sector.

    Taken after the fan-out, so each weight counts once per nutrient; ``once``
    counts it a single time, gains and losses of a profile key together.
    """
    rows = fanned
    if once:
        rows = fanned.groupBy("iso3c", "production_sector", "scientific_name", "genus_cat").agg(
            (
                zero_sum_of(F.max, F.col("pred_consumption") > 0)
                + zero_sum_of(F.min, F.col("pred_consumption") < 0)
            ).alias("pred_consumption")
        )
    return rows.groupBy("iso3c", "production_sector").agg(
        F.sum("pred_consumption").alias("consump")
    )


def nutrient_supply(
    fanned: DataFrame, by: Sequence[str] = (), nutrients: Sequence[str | None] | None = None
) -> DataFrame:
    """Supply by country, nutrient and sector (and ``by``) with the sector's consumption.

    Consumption is summed over the aggregated rows, so the fan-out runs once; a
    window group there holds one row per nutrient.  ``nutrients`` is what the fan-out got.
    """
    if nutrients is not None:
        return wide_nutrient_supply(fanned, nutrients, by)
    supply = fanned.groupBy(*by, "iso3c", "nutrient", "production_sector").agg(
        F.sum("nut_supply").alias("nut_supply"), F.sum("pred_consumption").alias("_weight")
    )
    sector = Window.partitionBy(*by, "iso3c", "production_sector")
    return supply.withColumn("consump", F.sum("_weight").over(sector)).drop("_weight")

"""Per-person nutrient supply and the share small-scale fisheries hold in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from supplyloom import constants as C
from supplyloom.functions.nulls import cap, kept_by, pct, ratio, zero_sum
from supplyloom.operators.aggregates import known_total_by
from supplyloom.operators.cleaning import denylist_filter, scenario_tag, year_slice
from supplyloom.operators.joins import natural_join, natural_left_join
from supplyloom.operators.mapping import category_map, code_recode
from supplyloom.operators.reshape import sector_pivot, token_split, unpivot_rest
from supplyloom.operators.unions import production_union
from supplyloom.sources.delimited import header_repair
from supplyloom.sources.storage import settle_together

FOOD_IDS = [
    "output", "countries", "products", "elements", "nutrient_long", "units",
    "iso3c", "food_abrev", "nutrient", "scenario",
]
SUPPLY = ["iso3c", "nutrient", "production_sector", "nut_supply"]
SCENARIO = "scenario"


def tagged(df: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """The rows once per scenario, which names them; unchanged without scenarios."""
    if not scenarios:
        return df
    return df.withColumn(SCENARIO, F.explode(F.array(*[F.lit(s) for s in scenarios])))


def food_base_long(
    base: DataFrame, denied: DataFrame, base_year: int | None = None,
    headers: dict[str, str] = C.FOOD_BASE_BLANK_HEADERS,
) -> DataFrame:
    """Food nutrient base, long, kept nutrients only, without denied countries.

    With ``base_year`` only that year's column is read.
    """
    named = scenario_tag(header_repair(base, headers), {"scenario": "base"})
    split = token_split(named, "elements", ["nutrient_long", "units"], r"\[", strip={"units": "]"})
    coded = code_recode(split, "nutrient", C.NUTRIENT_CODES)
    measures = [
        c for c in coded.columns
        if c not in FOOD_IDS and (base_year is None or c.replace("A", "") == str(base_year))
    ]
    long = unpivot_rest(coded.select(*FOOD_IDS, *measures), FOOD_IDS, "year", "value")
    long = long.withColumn("year", F.replace(F.col("year"), F.lit("A"), F.lit("")))
    kept = long.filter(kept_by("nutrient", C.KEPT_NUTRIENTS))
    return denylist_filter(kept, denied, "iso3c", "iso")


def product_nutrient_total(long: DataFrame, nutrient: str = C.OMEGA3_LONG) -> DataFrame:
    """Supply of one nutrient by product, without the total row."""
    rows = long.filter((F.col("products") != C.TOTAL_PRODUCT) & (F.col("nutrient") == nutrient))
    return known_total_by(rows, ["products"], "value", "value")


def food_group_supply(
    long: DataFrame, base_year: int, groups: dict[str, str] = C.FOOD_GROUPS
) -> DataFrame:
    """Animal-source and other food supply by country and nutrient in one year."""
    rows = year_slice(long.filter(F.col("products") != C.TOTAL_PRODUCT), base_year)
    grouped = category_map(rows, "products", "production_sector", groups)
    return known_total_by(
        grouped, ["iso3c", "production_sector", "nutrient"], "value", "nut_supply"
    )


def missing_detect(food: DataFrame, seafood: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Countries (and ``by``) that lack other-food supply for some nutrient they appear with."""
    has_other = F.when(F.col("production_sector") == "Other", F.col("nut_supply"))
    return (
        production_union(food.select(*by, *SUPPLY), seafood.select(*by, *SUPPLY))
        .groupBy(*by, "iso3c", "nutrient")
        .agg(F.count(has_other).alias("_n"))
        .filter(F.col("_n") == 0)
        .select(*by, "iso3c")
        .distinct()
    )


def group_supply(
    food: DataFrame, groups: DataFrame, group_codes: Sequence[str] = C.GROUP_AS_COUNTRY
) -> DataFrame:
    """Supply summed over the members of each group, plus groups reported as countries."""
    keys = ["group", "production_sector", "nutrient"]
    members = natural_join(food, groups, ["iso3c"], "inner").dropna(subset=["group"])
    summed = members.groupBy(*keys).agg(zero_sum("nut_supply").alias("nut_supply"))
    own = food.filter(kept_by("iso3c", group_codes)).withColumnRenamed("iso3c", "group")
    return production_union(summed, own.select(*summed.columns))


def group_fallback_fill(
    food: DataFrame, seafood: DataFrame, groups: DataFrame,
    group_codes: Sequence[str] = C.GROUP_AS_COUNTRY, scenarios: Sequence[str] = (),
) -> DataFrame:
    """Food supply with absent countries given the supply of their group.

    With ``scenarios`` the seafood tells them apart, food does not, and every
    scenario gets its own absent countries and the food of all others.
    """
    by = [SCENARIO] if scenarios else []
    members, food = food, tagged(food, scenarios)
    absent = missing_detect(food, seafood, by)
    filled = natural_join(
        natural_join(absent, groups, ["iso3c"], "inner"),
        group_supply(members, groups, group_codes), ["group"], "inner",
    )
    return production_union(food.select(*by, *SUPPLY), filled.select(*by, *SUPPLY))


def food_and_seafood(food: DataFrame, seafood: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per country and nutrient with a column per food sector.

    Missing sectors are 0, but a row needs a known supply of other food.
    """
    rows = production_union(food.select(*by, *SUPPLY), seafood.select(*by, *SUPPLY))
    return sector_pivot(
        rows.dropna(subset=["production_sector"]), C.FOOD_SECTORS,
        ids=[*by, "iso3c", "nutrient"], required=["Other"],
    )


def complete_supply(
    food: DataFrame, seafood: DataFrame, groups: DataFrame,
    group_codes: Sequence[str] = C.GROUP_AS_COUNTRY, scenarios: Sequence[str] = (),
) -> DataFrame:
    """Gap-filled food and seafood supply, one row per country and nutrient (and scenario).

    Both inputs are country tables read several times, so they are stored first; a
    food table that is stored already, with these columns, is used as it is.
    """
    by = [SCENARIO] if scenarios else []
    if set(food.columns) != set(SUPPLY):
        food = food.select(*SUPPLY)
    seafood = code_recode(seafood, "nutrient", {C.OMEGA3_SHORT: C.OMEGA3_LONG})
    food, seafood = settle_together(
        (food, "food"), (seafood.select(*by, *SUPPLY), "seafood")
    )
    return food_and_seafood(
        group_fallback_fill(food, seafood, groups, group_codes, scenarios), seafood, by
    )


def per_person(wide: DataFrame) -> DataFrame:
    """Small-scale supply per person and day and its share of all and animal food.

    The share of all food uses animal food without the seafood part, the share
    of animal food includes it; both are capped at 100.
    """
    return (
        wide.withColumn("SSF", F.col("Artisanal") + F.col("Subsistence"))
        .withColumn("SSF_per_capita", ratio("SSF", "pop") / F.lit(float(C.DAYS_PER_YEAR)))
        .withColumn("total", F.col("Other") + F.col("ASF") + F.col("SSF_per_capita"))
        .withColumn("ASF", F.col("ASF") + F.col("SSF_per_capita"))
        .withColumn("perc_SSF", cap(pct("SSF_per_capita", "total"), 100.0))
        .withColumn("perc_SSF_ASF", cap(pct("SSF_per_capita", "ASF"), 100.0))
    )


def per_capita_share(
    food: DataFrame, seafood: DataFrame, population: DataFrame, groups: DataFrame,
    group_codes: Sequence[str] = C.GROUP_AS_COUNTRY, scenarios: Sequence[str] = (),
) -> DataFrame:
    """Percent of nutrient supply from small-scale fisheries per country and nutrient.

    ``population`` has columns iso3c and pop (see ``param_column``).  With
    ``scenarios`` the seafood has a scenario column, and so has the result.
    """
    wide = complete_supply(food, seafood, groups, group_codes, scenarios)
    peopled = natural_left_join(wide, population, ["iso3c"]).dropna(subset=["pop"])
    return code_recode(per_person(peopled), "nutrient", {C.OMEGA3_LONG: C.OMEGA3_SHORT})

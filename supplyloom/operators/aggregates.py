"""Grouped aggregates.  All are plain hash aggregates with map-side partials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from supplyloom.functions.nulls import (
    fixed_mean, floor_zero, mean_ok, no_nan, pct, strict, strict_sd, strict_sum, zero_sum,
    strict_mean,
)
from supplyloom.operators.joins import natural_join


def total_by(df: DataFrame, keys: Sequence[str], measure: str, out: str) -> DataFrame:
    """Contagious-null sum by keys."""
    return df.groupBy(*keys).agg(strict_sum(measure).alias(out))


def known_total_by(df: DataFrame, keys: Sequence[str], measure: str, out: str) -> DataFrame:
    """Sum of known values by keys, 0 where none is known."""
    return df.groupBy(*keys).agg(zero_sum(measure).alias(out))


def subset_share(
    df: DataFrame, keys: Sequence[str], measure: str, subset: Column,
    part: str, whole: str, share: str,
) -> DataFrame:
    """Total of a subset as a percentage of the total, for keys that have any.

    Both totals come from one pass over the data.
    """
    inside = F.coalesce(subset, F.lit(False))
    return (
        df.groupBy(*keys)
        .agg(
            F.sum(F.when(inside, F.col(measure))).alias(part),
            F.sum(measure).alias(whole),
            F.count(F.when(inside, F.lit(1))).alias("_n"),
        )
        .filter(F.col("_n") > 0)
        .drop("_n")
        .withColumn(share, pct(part, whole))
    )


def split_totals(
    df: DataFrame, keys: Sequence[str], split: str, measure: str, names: dict[str, str]
) -> DataFrame:
    """Totals of several values of ``split`` per key, in one pass."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(split) == v, F.col(measure))).alias(n) for v, n in names.items()]
    )


def mean_share(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Mean over known values per key, in fixed point.

    Such means are ranked later, so equal ones must be equal to the bit.
    """
    return df.groupBy(*keys).agg(fixed_mean(measure).alias(measure))


def intake_summary(
    df: DataFrame, key: str = "iso3", measure: str = "perc_deficient", with_band: bool = True
) -> DataFrame:
    """Contagious-null mean and spread per country with a band floored at 0.

    The mean is in fixed point, since it is ranked later.
    """
    aggs = [strict(fixed_mean(measure), measure).alias("intake")]
    if not with_band:
        return df.groupBy(key).agg(*aggs)
    return (
        df.groupBy(key)
        .agg(strict_sd(measure).alias("intake_sd"), *aggs)
        .withColumn("intake_low", floor_zero(F.col("intake") - F.col("intake_sd")))
        .withColumn("intake_high", F.col("intake") + F.col("intake_sd"))
    )


def uncertainty_band(
    means: DataFrame, spread: DataFrame, key: str = "iso3c", measure: str = "perc_SSF"
) -> DataFrame:
    """Join min, max and spread per country to its mean; band mean +/- sd, floor 0.

    ``means`` and ``spread`` may be different selections of nutrients.
    """
    known = no_nan(measure)
    stats = spread.groupBy(key).agg(
        F.min(known).alias(f"{measure}_min"),
        F.max(known).alias(f"{measure}_max"),
        F.stddev_samp(known).alias(f"{measure}_sd"),
    )
    sd = F.col(f"{measure}_sd")
    return natural_join(mean_share(means, [key], measure), stats, [key]).withColumns(
        {
            f"{measure}_low": floor_zero(F.col(measure) - sd),
            f"{measure}_high": F.col(measure) + sd,
        }
    )


def range_stats(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Min, max and mean of known values."""
    known = no_nan(measure)
    return df.groupBy(*keys).agg(
        F.max(known).alias(f"max_{measure}"),
        F.min(known).alias(f"min_{measure}"),
        F.avg(known).alias(measure),
    )


def overall_means(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    return df.agg(*[mean_ok(m).alias(m) for m in measures])


def summary_sets(
    df: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[str]
) -> DataFrame:
    """Summaries over several groupings of one table, from one scan and one aggregation.

    A set is a list of columns; an empty one is the whole table.  ``level`` names the
    set of a row by its columns (``overall`` for none), since a null key may also be a
    value of the column; columns outside the set are null.  For each measure there are
    the mean of known values, the contagious-null mean (``strict_``), the least and the
    greatest known value (``min_``, ``max_``); ``n`` counts rows.  Means are in fixed
    point, so a row's values do not depend on the order of the input.  An empty table has
    no groups, so it gives no rows.
    """
    keys = list(dict.fromkeys(c for s in sets for c in s))
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        known = no_nan(m)
        aggs += [
            fixed_mean(m).alias(m), strict(fixed_mean(m), known).alias(f"strict_{m}"),
            F.min(known).alias(f"min_{m}"), F.max(known).alias(f"max_{m}"),
        ]
    if not keys:
        return df.agg(*aggs).filter("n > 0").withColumn("level", F.lit("overall"))
    outside = [F.grouping(k).alias(f"_out_{k}") for k in keys]
    made = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*outside, *aggs)
    inside = F.concat_ws("+", *[F.when(F.col(f"_out_{k}") == 0, F.lit(k)) for k in keys])
    level = F.when(inside == "", F.lit("overall")).otherwise(inside)
    return made.select(level.alias("level"), *[c for c in made.columns if not c.startswith("_out_")])


def region_rollup(
    df: DataFrame, dim: DataFrame, dim_key: str, measure: str,
    by: Sequence[str] = ("region",), key: str = "iso3c",
) -> DataFrame:
    """Look up the region of each country, then the contagious-null mean.

    Countries without a region form their own group.  Other ``by`` columns may
    come from either table.
    """
    wanted = [c for c in dim.columns if c == dim_key or (c in by and c not in df.columns)]
    side = dim.select(*wanted).withColumnRenamed(dim_key, key)
    return natural_join(df, side, [key]).groupBy(*by).agg(strict_mean(measure).alias(measure))


def deficiency_by_nutrient(df: DataFrame) -> DataFrame:
    """People deficient and mean rate by nutrient, over known values."""
    return df.groupBy("nutrient").agg(
        zero_sum("ndeficient").alias("def"), mean_ok("perc_deficient").alias("intake")
    )


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()

"""Left equi-joins with the missing-key rules of the statistical sources.

No join is forced to broadcast: Catalyst (file sizes) and adaptive execution
(measured shuffle sizes) broadcast a side below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise run a shuffled join whose
hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from supplyloom.sources.delimited import SOURCE_ORDER, with_source_order
from supplyloom.sources.literal import literal_table


def _aligned(right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    names = {k: f"_right_{k}" for k in keys}
    return right.withColumnsRenamed(names), names


def natural_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | None = None,
    how: str = "left",
    null_safe: bool = True,
) -> DataFrame:
    """Join on all shared columns (or ``keys``), a null key matching a null key."""
    shared = list(keys) if keys is not None else [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared columns to join on")
    renamed, names = _aligned(right, shared)
    tests = [
        F.col(k).eqNullSafe(F.col(r)) if null_safe else F.col(k) == F.col(r)
        for k, r in names.items()
    ]
    return left.join(renamed, reduce(lambda a, b: a & b, tests), how).drop(*names.values())


def natural_left_join(left: DataFrame, right: DataFrame, keys=None) -> DataFrame:
    return natural_join(left, right, keys, "left")


def dim_enrich(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, required: str
) -> DataFrame:
    """Attach dimension columns by a differently named key, drop unmatched rows."""
    side = dim.withColumnRenamed(dim_key, "_dim_key")
    return (
        fact.join(side, F.col(fact_key).eqNullSafe(F.col("_dim_key")), "left")
        .drop("_dim_key")
        .dropna(subset=[required])
    )


def fanout_join(fact: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """One-to-many left join: each fact row to one row per profile entry."""
    return natural_join(fact, profile, [key], "left")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the declared order, nulls last.

    A minimum over a struct merges partial results before the shuffle; a ranked
    window would bring every row of a hot key to one task.
    """
    payload = [c for c in df.columns if c not in keys]
    rank = [x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"v_{c}"))]
    best = F.min(F.struct(*rank, F.struct(*payload).alias("row"))).alias("_best")
    return (
        df.groupBy(*keys)
        .agg(best)
        .select(*keys, *[F.col(f"_best.row.{c}").alias(c) for c in payload])
        .select(*df.columns)
    )


def first_in_source(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row per key as the files have it; ``df`` comes from a scan.

    See ``with_source_order``.  Partial minima are merged, so no group meets in one task.
    They sort a task's rows, so files go by their number among the source's names: a
    path in every row would be most of what a task holds.
    """
    payload = [c for c in df.columns if c not in keys]
    # The listing has the same names, but for the slashes behind the scheme.
    name = lambda path: F.regexp_replace(path, "^([^:/]+):/+", "$1:/")
    listed = {path: k for k, path in enumerate(sorted(df.inputFiles()))}
    source = literal_table(df.sparkSession, listed or {"": 0}, "_path", "_number")
    numbered = with_source_order(df).join(source, name("_file") == name("_path"), "left")
    number = F.coalesce("_number", F.raise_error(F.concat(F.lit("not a file of the source: "), F.col("_file"))).cast("long"))
    first = [F.col(c).alias(f"_{k}") for k, c in enumerate(["_number", *SOURCE_ORDER[1:]])]
    rest = [F.col(c).alias(f"c{k}") for k, c in enumerate(payload)]
    best = numbered.withColumn("_number", number).groupBy(*keys).agg(F.min(F.struct(*first, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.c{k}").alias(c) for k, c in enumerate(payload)]).select(*df.columns)


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct on some keys, keeping the other columns of the first row."""
    return first_rows(df, keys, order)


def first_match_lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str],
    take: str, name: str,
) -> DataFrame:
    """Attach ``take`` of the first matching right row; null keys never match."""
    firsts = first_rows(right, keys, order).select(*keys, F.col(take).alias(name))
    return natural_join(left, firsts, keys, "left", null_safe=False)


def two_tier_join(
    fact: DataFrame,
    by_species: DataFrame,
    by_category: DataFrame,
    species: str = "scientific_name",
    category: str = "genus_cat",
    carried: Sequence[str] = ("nutrient", "value"),
) -> DataFrame:
    """Profile rows by species where a species is named, else by category.

    A named species that the profile lacks is not rescued by its category.  Both
    tiers are matched in one join on (tier, key), so the facts are read once.
    """
    profile = (
        by_species.filter(F.col(species).isNotNull())
        .select(F.lit("species").alias("_tier"), F.col(species).alias("_key"), *carried)
        .unionByName(
            by_category.select(
                F.lit("category").alias("_tier"), F.col(category).alias("_key"), *carried
            )
        )
    )
    named = F.col(species).isNotNull()
    tiered = fact.withColumns(
        {
            "_tier": F.when(named, F.lit("species")).otherwise(F.lit("category")),
            "_key": F.when(named, F.col(species)).otherwise(F.col(category)),
        }
    )
    return natural_join(tiered, profile, ["_tier", "_key"], "left").drop("_tier", "_key")

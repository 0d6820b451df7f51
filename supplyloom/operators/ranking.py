"""Exact distributed distribution operators: ECDF, quantiles, box statistics.

A global window would sort a whole table in one task, and Spark's exact
``percentile`` keeps every distinct value of a group in one buffer.  Both are
replaced by running weights over (group, distinct value) counts, cut into value
buckets of bounded size, so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from supplyloom.functions.nulls import no_nan
from supplyloom.operators.joins import natural_join
from supplyloom.sources.storage import settle, settle_counted

ROWS_PER_BUCKET = 1_000_000


def bucketed(counts: DataFrame, value: str, rows_per_bucket: int) -> DataFrame:
    """The counts in value ranges of about ``rows_per_bucket`` rows each, stored.

    The range a row was dealt to is its bucket, whatever the number of buckets.
    Every bucket holds its share of the rows whatever the groups are, so one hot
    group is spread; the ranges balance the work and do not touch the result.
    """
    counts, n_rows = settle_counted(counts, "counts")
    ranged = counts.repartitionByRange(max(1, -(-n_rows // rows_per_bucket)), value)
    return settle(ranged.withColumn("_bucket", F.spark_partition_id()), "buckets")


def running_weights(
    counts: DataFrame,
    value: str,
    weight: str,
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``upto`` (weight of all rows <= value in the group) and ``total``.

    ``counts`` holds one row per group and distinct value and must be settled, with
    its rows counted as they were written if no job is to count them.
    """
    by = list(by)
    dealt = bucketed(counts, value, rows_per_bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = dealt.withColumn("_local", F.sum(weight).over(inside))
    # At most one row per bucket and group from here on.
    ladder = Window.partitionBy(*by).orderBy("_bucket")
    everything = Window.partitionBy(*by)
    offsets = (
        dealt.groupBy(*by, "_bucket")
        .agg(F.sum(weight).alias("_weight"))
        .withColumns(
            {
                "_before": F.sum("_weight").over(ladder) - F.col("_weight"),
                "total": F.sum("_weight").over(everything),
            }
        )
        .drop("_weight")
    )
    return (
        natural_join(local, offsets, [*by, "_bucket"], "inner")
        .withColumn("upto", F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_bucket")
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, distinct value); unknown values keep weight 0."""
    return (
        df.select(*by, no_nan(value).alias(value))
        .groupBy(*by, value)
        .agg(F.count(value).alias("weight"))
    )


@dataclass(frozen=True)
class Rank:
    """A rank to add: of ``value`` within ``population_value`` of a population.

    The population defaults to the scored rows, its column to ``value``.
    """

    value: str
    out: str
    population: DataFrame | None = None
    population_value: str | None = None


def _points(scored: DataFrame, rank: Rank) -> DataFrame:
    """(measure, v, w): rows of the population with weight 1, scored values with 0."""

    def side(df: DataFrame, column: str, weight: int) -> DataFrame:
        return df.select(F.lit(rank.out).alias("_m"), no_nan(column).alias("_v"), F.lit(weight).cast("long").alias("_w"))

    if rank.population is None:
        return side(scored, rank.value, 1)
    known = side(rank.population, rank.population_value or rank.value, 1)
    return known.unionByName(side(scored, rank.value, 0))


def distribution_ranks(points: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """(_m, _v, rank): share of each measure's weight at or below each of its values.

    The values of all measures are counted, dealt into ranges of (measure, value) and
    stored with their range in one write.  How many ranges is the session's choice,
    and adaptive execution merges small ones; the number does not touch the result.
    ``rows_per_bucket`` fixes their size instead, for which values are counted first.
    """
    counts = points.filter(F.col("_v").isNotNull()).groupBy("_m", "_v").agg(F.sum("_w").alias("_w"))
    if rows_per_bucket is None:
        ranged = counts.repartitionByRange("_m", "_v")
    else:
        counts, n_rows = settle_counted(counts, "counts")
        ranged = counts.repartitionByRange(max(1, -(-n_rows // rows_per_bucket)), "_m", "_v")
    dealt = settle(ranged.withColumn("_bucket", F.spark_partition_id()), "distribution")
    inside = Window.partitionBy("_m", "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # One row per measure and range from here on.
    ladder, everything = Window.partitionBy("_m").orderBy("_bucket"), Window.partitionBy("_m")
    offsets = (
        dealt.groupBy("_m", "_bucket")
        .agg(F.sum("_w").alias("_weight"))
        .withColumns(
            {
                "_before": F.sum("_weight").over(ladder) - F.col("_weight"),
                "_total": F.sum("_weight").over(everything),
            }
        )
        .drop("_weight")
    )
    local = dealt.withColumn("_local", F.sum("_w").over(inside))
    upto = (F.col("_local") + F.col("_before")).cast("double")
    return natural_join(local, offsets, ["_m", "_bucket"], "inner").select(
        "_m", "_v", F.try_divide(upto, F.col("_total").cast("double")).alias("rank")
    )


def ecdf_ranks(
    scored: DataFrame, ranks: Sequence[Rank], rows_per_bucket: int | None = None
) -> DataFrame:
    """Several ranks of the same rows, their distributions in one range exchange.

    Unknown values are left out of a population and get an unknown rank.  Values must
    be reproducible between reads (stored, or exact arithmetic).
    """
    points = reduce(DataFrame.unionByName, [_points(scored, r) for r in ranks])
    known = distribution_ranks(points, rows_per_bucket)
    for r in ranks:
        own = known.filter(F.col("_m") == r.out).select("_v", F.col("rank").alias(r.out))
        scored = scored.join(own, no_nan(r.value) == F.col("_v"), "left").drop("_v")
    return scored


def ecdf_rank(
    scored: DataFrame,
    value: str,
    out: str,
    population: DataFrame | None = None,
    population_value: str | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Share of a reference population at or below each scored value.

    The population defaults to the scored rows.  Unknown values are left out of
    it and get an unknown rank.  ``value`` must be reproducible between reads
    (stored, or exact arithmetic); settle a floating aggregate first.
    """
    return ecdf_ranks(scored, [Rank(value, out, population, population_value)], rows_per_bucket)


def quantiles_of(weighted: DataFrame, value: str, by: Sequence[str], names: dict[str, float]) -> DataFrame:
    """Linear interpolation between the two ranks around p * (n - 1)."""

    def at(rank):
        holds = (F.col("upto") - F.col("weight") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(holds, F.col(value)))

    parts = []
    for name, p in names.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        low = F.floor(pos)
        parts += [
            at(low).alias(f"_{name}_lo"),
            at(F.least(low + 1, F.col("total") - 1)).alias(f"_{name}_hi"),
            F.max(pos - low).alias(f"_{name}_w"),
        ]
    picked = weighted.groupBy(*by).agg(*parts)
    return picked.select(
        *by,
        *[
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")
            ).alias(n)
            for n in names
        ],
    )


def exact_quantiles(
    df: DataFrame, value: str, by: Sequence[str], names: dict[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact interpolated quantiles per group; a group of unknowns gives null."""
    counts, _ = settle_counted(value_counts(df, value, by), "counts")
    return quantiles_of(running_weights(counts, value, "weight", by, rows_per_bucket), value, by, names)


def boxplot_stats(
    df: DataFrame, value: str, by: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, DataFrame]:
    """(statistics per group, outlier values with their row counts).

    Hinges are interpolated quartiles; whiskers end at the last value within
    1.5 interquartile ranges of the hinges.
    """
    by = list(by)
    counts, _ = settle_counted(value_counts(df, value, by), "counts")
    weighted = running_weights(counts, value, "weight", by, rows_per_bucket)
    hinges = quantiles_of(weighted, value, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    placed = natural_join(counts.filter(F.col("weight") > 0), hinges, by, "inner").withColumn(
        "_out", (F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)
    )
    within = F.when(~F.col("_out"), F.col(value))
    stats = placed.groupBy(*by, "q1", "median", "q3").agg(
        F.min(within).alias("whisker_low"),
        F.max(within).alias("whisker_high"),
        F.sum("weight").alias("n"),
        F.sum(F.when(F.col("_out"), F.col("weight")).otherwise(0)).alias("n_outliers"),
    )
    outliers = placed.filter("_out").select(*by, value, F.col("weight").alias("n_rows"))
    return stats, outliers


def category_distribution(
    df: DataFrame, category: str, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per category and their percentage of the group; null is a category.

    The window runs over the counted rows, one per label and group.
    """
    counted = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*by))
    return counted.withColumn(
        "perc", F.lit(100.0) * F.col("n").cast("double") / whole.cast("double")
    )


def filtered_distribution(df: DataFrame, keep, category: str, by: Sequence[str] = ()) -> DataFrame:
    """Category distribution of a slice."""
    return category_distribution(df.filter(keep), category, by)


def row_number_pick(df: DataFrame, order: Sequence[str], number: str = "id") -> DataFrame:
    """Number the rows in a declared order and keep the first, as a top-1."""
    first = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(1)
    return first.withColumn(number, F.lit(1))


"""Exact quantiles by narrowing: only the value ranges that hold a wanted rank are ranked.

Ranking all distinct values of a group shuffles nearly every row of a measure that
seldom repeats.  Here a sketch proposes cut points, the rows between them are counted
exactly, and only the ranges in which a wanted rank falls are read again and ranked.
The sketch decides how much is read, never what comes out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from supplyloom.functions.nulls import no_nan
from supplyloom.operators.joins import natural_join
from supplyloom.operators.ranking import ROWS_PER_BUCKET, quantiles_of, running_weights
from supplyloom.sources.storage import settle, settle_counted

RANGES = 64


def wanted_ranks(p: float, total: Column) -> list[Column]:
    """The two ranks (from 0) around ``p * (total - 1)``."""
    low = F.floor(F.lit(float(p)) * (total - 1))
    return [low, F.least(low + 1, total - 1)]


def cut_points(known: DataFrame, value: str, by: Sequence[str], ranges: int) -> DataFrame:
    """One row per group: its cut points (``ranges`` - 1 at most) and known values."""
    shares = [i / ranges for i in range(1, ranges)]
    return known.groupBy(*by).agg(
        F.percentile_approx(value, shares, 20 * ranges).alias("_cuts"),
        F.count(value).alias("_total"),
    )


def wanted_ranges(
    placed: DataFrame, cuts: DataFrame, by: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """(group, _range, _before, _total) of the ranges that hold a wanted rank.

    A window group holds one row per range.
    """
    ladder = Window.partitionBy(*by).orderBy("_range")
    sized = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    sized = sized.withColumn("_before", F.sum("_n").over(ladder) - F.col("_n"))
    sized = natural_join(sized, cuts.select(*by, "_total"), by, "inner")
    holds = [
        (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        for p in probabilities
        for rank in wanted_ranks(p, F.col("_total"))
    ]
    return sized.filter(reduce(lambda a, b: a | b, holds)).drop("_n")


def narrowed_quantiles(
    df: DataFrame, value: str, by: Sequence[str], names: dict[str, float],
    ranges: int = RANGES, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact interpolated quantiles per group, as ``exact_quantiles`` gives them.

    ``df`` is read three times, so it should be a scan or a stage table.  About
    2 / ``ranges`` of a group's rows per quantile are shuffled; values that repeat are
    combined before.  Unknown values (null, NaN) are left out, a group of unknowns
    gives null, unknown group keys are a group, an empty table gives no row.
    """
    by = list(by)
    if not by:
        raise ValueError("name the columns of the groups")
    known = df.select(*by, no_nan(value).alias(value))
    # Stored: a second evaluation of the sketch could cut elsewhere.
    cuts = settle(cut_points(known, value, by, ranges), "cuts")
    below = F.filter("_cuts", lambda cut: cut < F.col(value))
    placed = (
        natural_join(known.filter(F.col(value).isNotNull()), cuts.select(*by, "_cuts"), by, "inner")
        .withColumn("_range", F.size(below))
        .drop("_cuts")
    )
    picked = settle(wanted_ranges(placed, cuts, by, list(names.values())), "ranges")
    inside = natural_join(placed, picked.select(*by, "_range"), [*by, "_range"], "left_semi")
    counts, _ = settle_counted(
        inside.groupBy(*by, "_range", value).agg(F.count(F.lit(1)).alias("weight")), "narrowed"
    )
    ranked = running_weights(counts, value, "weight", [*by, "_range"], rows_per_bucket).drop("total")
    ranked = natural_join(ranked, picked, [*by, "_range"], "inner").withColumns(
        {"upto": F.col("upto") + F.col("_before"), "total": F.col("_total")}
    )
    return natural_join(cuts.select(*by), quantiles_of(ranked, value, by, names), by, "left")

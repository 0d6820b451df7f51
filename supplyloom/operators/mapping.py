"""Label maps, code recodes, bounds and ordered categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from supplyloom.functions.nulls import cap, censor, floor_zero, if_else, negative_part
from supplyloom.sources.literal import sql_literal


def literal_map(mapping: Mapping) -> Column:
    entries = ", ".join(sql_literal(x) for x in chain.from_iterable(mapping.items()))
    return F.expr(f"map({entries})")


def lookup(col: Column | str, mapping: Mapping) -> Column:
    """Mapped label, null where the value is unmapped or null."""
    c = F.col(col) if isinstance(col, str) else col
    return literal_map(mapping)[c]


def with_lookup(df: DataFrame, source: str, target: str, mapping: Mapping | DataFrame) -> DataFrame:
    """Add the mapped value of a column.

    A Python mapping is a literal of any length and travels with the plan; a table
    of (key, value) columns, whose keys are unique, is left-joined.  Both give the
    same rows.
    """
    if isinstance(mapping, DataFrame):
        key, value = mapping.columns
        table = mapping.select(F.col(key).alias("_map_key"), F.col(value).alias("_map_value"))
        joined = df.join(table, F.col(source) == F.col("_map_key"), "left")
        return joined.withColumn(target, F.col("_map_value")).drop("_map_key", "_map_value")
    return df.withColumn(target, lookup(source, mapping))


def category_map(df: DataFrame, source: str, target: str, mapping: Mapping | DataFrame) -> DataFrame:
    """Many-to-one label map; unmatched values become null."""
    return with_lookup(df, source, target, mapping)


def code_recode(df: DataFrame, col: str, mapping: Mapping | DataFrame) -> DataFrame:
    """Replace listed codes; everything else passes through."""
    mapped = with_lookup(df, col, "_mapped", mapping)
    return mapped.withColumn(col, F.coalesce("_mapped", col)).drop("_mapped")


def conditional_override(
    df: DataFrame, target: str, test: str, equals: str, value: str
) -> DataFrame:
    """Overwrite ``target`` where ``test`` has a value; an unknown test gives null."""
    return df.withColumn(target, if_else(F.col(test) == equals, F.lit(value), F.col(target)))


def text_match_scale(
    df: DataFrame, text: str, fragment: str, measure: str, factor
) -> DataFrame:
    """Scale the measure of rows whose text contains a fragment, ignoring case.

    Rows without text match neither side of the split and are dropped.
    """
    hit = F.lower(F.col(text)).contains(fragment.lower())
    return df.filter(F.col(text).isNotNull()).withColumn(
        measure, F.when(hit, F.col(measure) * F.lit(factor)).otherwise(F.col(measure))
    )


def clamp_negative(df: DataFrame, measure: str, clamped: str, residue: str) -> DataFrame:
    """Split a measure into its non-negative part and its negative residue."""
    return df.withColumns({clamped: floor_zero(measure), residue: negative_part(measure)})


def cap_at(df: DataFrame, col: str, upper: float = 100.0) -> DataFrame:
    return df.withColumn(col, cap(col, upper))


def per_group_cap(
    df: DataFrame, group: str, col: str, caps: Mapping[str, float] | DataFrame
) -> DataFrame:
    """A different upper bound per group; groups without a bound are untouched."""
    limited = with_lookup(df, group, "_limit", caps)
    bounded = F.when(F.col(col) > F.col("_limit"), F.col("_limit")).otherwise(F.col(col))
    return limited.withColumn(col, bounded).drop("_limit")


def range_censor(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return df.withColumn(col, censor(col, low, high))


def ordered_levels(
    df: DataFrame, col: str, levels: Sequence[str] | DataFrame, number: str = "level_no"
) -> DataFrame:
    """Number the categories in the given order; unlisted values become null.

    A table of levels holds (level, number).
    """
    if not isinstance(levels, DataFrame):
        levels = {v: i for i, v in enumerate(levels, start=1)}
    return with_lookup(df, col, number, levels).withColumn(
        col, F.when(F.col(number).isNotNull(), F.col(col))
    )


def case_normalise(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.lower(F.col(col)))

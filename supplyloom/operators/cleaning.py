"""Row cleaning: marks, signs, years, tags and list filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from supplyloom.constants import MISSING_MARK
from supplyloom.functions.nulls import dropped_by, kept_by


def placeholder_clean(
    df: DataFrame, measure: str, required: Sequence[str] = (), mark: str = MISSING_MARK
) -> DataFrame:
    """Drop rows marked as missing, read the measure as a number, require the keys."""
    return (
        df.filter(F.col(measure) != mark)
        .withColumn(measure, F.col(measure).try_cast("double"))
        .dropna(subset=[measure, *required])
    )


def positive_only(df: DataFrame, measure: str) -> DataFrame:
    """Keep strictly positive, known measures."""
    kind = dict(df.dtypes)[measure]
    positive = F.col(measure) > 0
    return df.filter(positive & ~F.isnan(measure) if kind in ("double", "float") else positive)


def year_slice(df: DataFrame, year: int, col: str = "year", prefix: str = "") -> DataFrame:
    """Keep one base year.  Text years lose ``prefix`` and become integers."""
    if dict(df.dtypes)[col] == "string":
        text = F.regexp_replace(F.col(col), prefix, "") if prefix else F.col(col)
        # Any spelling of the year holds its digits; a scan can test for them.
        df = df.filter(F.col(col).contains(str(year))).withColumn(col, text.try_cast("int"))
    return df.filter(F.col(col) == year)


def scenario_tag(df: DataFrame, tags: dict[str, object]) -> DataFrame:
    """Add constant provenance columns; ``None`` becomes a typed null string."""
    return df.withColumns(
        {k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in tags.items()}
    )


def membership_filter(
    df: DataFrame, keep: dict[str, Sequence] | None = None, drop: dict[str, Sequence] | None = None
) -> DataFrame:
    """Keep rows whose value is listed; drop listed values but keep nulls."""
    for col, values in (keep or {}).items():
        df = df.filter(kept_by(col, values))
    for col, values in (drop or {}).items():
        df = df.filter(dropped_by(col, values))
    return df


def denylist_filter(df: DataFrame, denied: DataFrame, key: str, denied_key: str) -> DataFrame:
    """Drop rows whose key occurs in a table; rows without a key stay."""
    codes = denied.select(F.col(denied_key).alias("_denied"))
    return df.join(codes, F.col(key) == F.col("_denied"), "left_anti")

"""Long facts stored by year, so that base years are folders and not filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_facts(df: DataFrame, path: str, by: Sequence[str] = ("year",), mode: str = "errorifexists") -> str:
    """Write long facts with one folder per value of ``by``.

    Rows are rebalanced by these columns first: adaptive execution merges the small
    years of a task and splits a hot year over several, so a folder holds few files
    (a small year that hashes beside a hot one is split with it) and no year is one
    task's work.  Unknown values have a folder of their own.
    """
    dealt = df.hint("rebalance", *[F.col(c) for c in by])
    dealt.write.mode(mode).partitionBy(*by).parquet(path)
    return path


def read_facts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Facts from :func:`write_facts`; the schema keeps codes like ``007`` as text."""
    return spark.read.schema(schema).parquet(path)


def of_years(facts: DataFrame, years: Sequence[int], col: str = "year") -> DataFrame:
    """The facts of listed years: other years' folders are not opened."""
    return facts.filter(F.col(col).isin(list(years)))


def of_base_years(
    facts: DataFrame, base_years: DataFrame, condition, col: str = "year", base_col: str = "year"
) -> DataFrame:
    """The facts of the years that a table of base years holds under ``condition``.

    A semi join: a year that is listed twice counts once, unknown years match nothing.
    The condition is what lets Spark look up the years first and prune the folders
    while the query runs.
    """
    wanted = base_years.filter(condition).select(F.col(base_col).alias("_base"))
    return facts.join(wanted, F.col(col) == F.col("_base"), "left_semi")

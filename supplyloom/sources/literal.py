"""Small fixed lookups as tables the optimizer knows the size of."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def sql_literal(value) -> str:
    """A constant as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value) if isinstance(value, int) else f"{float(value)!r}D"


def literal_table(spark: SparkSession, mapping: Mapping, key: str, value: str) -> DataFrame:
    """A two-column table from a fixed mapping (an inline VALUES relation)."""
    rows = ", ".join(f"({sql_literal(k)}, {sql_literal(v)})" for k, v in mapping.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS fixed({key}, {value})")

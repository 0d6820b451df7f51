"""Query registry: key -> (Spark function of the tables, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# (application, path) -> schema: footers are read once per session and table.
_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


class Tables:
    """The parquet tables of one scale-factor folder, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[tuple, DataFrame] = {}

    def once(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        """The same lazy frame for repeated uses within one query."""
        if key not in self._frames:
            self._frames[key] = build()
        return self._frames[key]

    def __getattr__(self, name: str) -> DataFrame:
        return self.once(("table", name), lambda: self._read(name))

    def _read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        known = (self.spark.sparkContext.applicationId, path)
        if known not in _SCHEMAS:
            _SCHEMAS[known] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[known]).parquet(path)


def query(sql: str):
    """Register a function of :class:`Tables` under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        SQL[fn.__name__] = sql
        return fn

    return register

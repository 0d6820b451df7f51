"""Row stacking by column name, and output order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from supplyloom.constants import TINY_PLACE_AREA


def production_union(*frames: DataFrame) -> DataFrame:
    """Union all by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def consumption_union(
    allocated: DataFrame, direct: DataFrame, imports: DataFrame, import_label: str = "Import",
    by: Sequence[str] = (),
) -> DataFrame:
    """Allocated catch, direct catch and imports (which name no species).

    ``by`` names further columns of all three, such as a scenario.
    """
    cols = [
        *by,
        "iso3c", "year", "genus_cat", "common_name", "scientific_name",
        "production_sector", "pred_consumption",
    ]
    bought = imports.select(
        *by,
        "iso3c",
        "year",
        "genus_cat",
        F.lit(None).cast("string").alias("common_name"),
        F.lit(None).cast("string").alias("scientific_name"),
        F.lit(import_label).alias("production_sector"),
        F.col("tonnes").alias("pred_consumption"),
    )
    return production_union(allocated.select(*cols), direct.select(*cols), bought)


def dimension_union(large: DataFrame, tiny: DataFrame, area: float = TINY_PLACE_AREA) -> DataFrame:
    """Large places with their area and tiny places with a nominal one."""
    return large.unionByName(tiny.withColumn("area_sqkm", F.lit(area)), allowMissingColumns=True)


def ordered_output(df: DataFrame, by: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, descending) pairs, nulls last either way."""
    return df.orderBy(
        *[F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in by]
    )

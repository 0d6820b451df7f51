"""Running sums over groups of any size, with bounded windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 10_000
#: Half of the range of a signed 64-bit hash.
HALF = 2.0**63


def hash_buckets(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // rows_per_bucket))


def bucket_of(hashed: Column, buckets: int) -> Column:
    """Bucket number that rises with the hash, so buckets keep the hash order."""
    part = (hashed.cast("double") + F.lit(HALF)) / F.lit(2 * HALF)
    return F.least(F.floor(part * F.lit(float(buckets))), F.lit(buckets - 1)).cast("long")


def running_sum(
    df: DataFrame, by: str, hashed: str, ties: Sequence[str], value: str, out: str, buckets: int
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the group, in hash order.

    A group may hold any share of the rows: the hash cuts it into ``buckets``
    windows of bounded size, whose totals (one row per group and bucket) are
    summed separately.  ``df`` must be stored, since it is read twice; ``ties``
    order rows of equal hash.  A null group is a group.
    """
    cut = df.withColumn("_bucket", bucket_of(F.col(hashed), buckets))
    inside = Window.partitionBy(by, "_bucket").orderBy(hashed, *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ladder = Window.partitionBy(by).orderBy("_bucket")
    before = (
        cut.groupBy(by, "_bucket")
        .agg(F.sum(value).alias("_sum"))
        .select(
            F.col(by).alias("_by"),
            F.col("_bucket").alias("_at"),
            (F.sum("_sum").over(ladder) - F.col("_sum")).alias("_before"),
        )
    )
    local = cut.withColumn("_local", F.sum(value).over(inside) - F.col(value))
    return (
        local.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_at")))
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_by", "_at", "_before", "_local", "_bucket")
    )

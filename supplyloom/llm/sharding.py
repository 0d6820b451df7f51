"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from supplyloom.llm.running import hash_buckets, running_sum
from supplyloom.sources.storage import settle


def rendezvous_shard(key: str | Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score for the key, numbered from 0.

    Shard i scores weight / -ln(u), with u a uniform hash of (key, i).  A shard's
    score depends on nothing but the key and itself, so an added shard only takes
    keys over and a removed one only gives its own away.  Equal scores go to the
    smaller number; a null key is a key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    key = F.col(key) if isinstance(key, str) else key
    shares = F.array(*[F.lit(float(w)) for w in weights])

    def scored(i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, i), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(2.0**53)
        return F.struct((F.get(shares, i) / -F.ln(u)).alias("score"), (-i).alias("rank"))

    numbers = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return -F.array_max(F.transform(numbers, scored))["rank"]


def shard_documents(
    df: DataFrame,
    weights: Sequence[float],
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    rows_per_bucket: int = 10_000,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 8 and ``text_crc32`` its
    unsigned checksum; a null text counts as empty.  ``slot`` numbers the rows of
    a shard from 0 without gaps, in the order of a hash of the row's key, size
    and checksum.  ``grown_shard`` is the shard if one more were added.  Repeated
    rows get the same shard and neighbouring slots; an empty table gives no rows.
    Only the two named columns are read, so further columns may have any name.

    Slots are counted in hash buckets of bounded size within each shard; rows
    that agree in key, size and checksum are counted before they are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    placed = settle(
        counted.select(
            "*",
            rendezvous_shard("_key", weights).alias("shard"),
            rendezvous_shard("_key", [*weights, grown_weight]).alias("grown_shard"),
            F.xxhash64("_key", "size", "text_crc32", F.lit("slot")).alias("_hash"),
        ),
        "shards",
    )
    buckets = hash_buckets(placed.count(), rows_per_bucket)
    slotted = running_sum(
        placed, "shard", "_hash", ["_key", "size", "text_crc32"], "_copies", "_first", buckets
    )
    each = slotted.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return each.select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_first") + F.col("_copy")).alias("slot"),
        "grown_shard",
    )

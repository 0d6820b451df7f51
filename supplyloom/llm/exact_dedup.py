"""Exact deduplication: local, salted and global combining of equal texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from supplyloom.sources.storage import settle


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def text_groups(
    df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int
) -> DataFrame:
    """(digest, text, keep_id, group_size) of every different text.

    Every stage groups by the whole text beside its digest, so texts of one
    digest never mix.  (1) Each task merges its own copies before it shuffles.
    (2) What tasks hold of a digest meets under one of ``salts`` salts, so a text
    held by every task is spread.  (3) The winners of the salts are merged.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    salted = (
        rows.select("*", digest(F.col("_text")).alias("_digest"), (F.spark_partition_id() % salts).alias("_salt"))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
    )
    return salted.groupBy("_digest", "_text").agg(
        F.max("_best").alias("keep_id"), F.sum("_n").alias("group_size")
    )


def duplicate_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> tuple[DataFrame, DataFrame | None]:
    """Stored (digest, keep_id, group_size), and the digests that several texts share.

    The second is None when every digest stands for one text, which with SHA-256
    is the rule; texts are compared whole either way.
    """
    groups = settle(text_groups(df, id_col, text_col, digest, salts).drop("_text"), "dedup")
    shared = groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1")
    shared = settle(shared.select("_digest"), "collisions")
    return groups, None if shared.isEmpty() else shared


def _matched(
    df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int, carry: list[Column]
) -> DataFrame:
    """``carry`` columns of every row beside keep_id and group_size of its text."""
    groups, shared = duplicate_groups(df, id_col, text_col, digest, salts)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*carry, digest(body).alias("_d"))
    if shared is None:
        return rows.join(groups, F.col("_d") == F.col("_digest")).drop("_d")
    shared = shared.withColumnRenamed("_digest", "_s")
    alone = rows.join(shared, F.col("_d") == F.col("_s"), "left_anti").join(
        groups, F.col("_d") == F.col("_digest")
    )
    keyed = df.select(*carry, digest(body).alias("_d"), body.alias("_body"))
    texts = text_groups(df, id_col, text_col, digest, salts).join(
        shared, F.col("_digest") == F.col("_s"), "left_semi"
    )
    together = keyed.join(shared, F.col("_d") == F.col("_s"), "left_semi").join(
        texts, (F.col("_d") == F.col("_digest")) & (F.col("_body") == F.col("_text"))
    )
    return alone.drop("_d").unionByName(together.drop("_d", "_body", "_text"))


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty.  The row with
    the largest id stays; a null id is smaller than any other.  Of rows that
    repeat the largest id exactly one is marked ``kept``.  An empty table gives
    no rows; columns beside the two named ones are not read.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    carry = [F.col(id_col).alias("_id"), sha256(body).alias("text_sha256")]
    matched = _matched(df, id_col, text_col, digest, salts, carry)
    # Rows that repeat an id with the same text are told apart by a count.
    repeated = matched.groupBy("text_sha256", "_id", "keep_id", "group_size").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    each = repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> DataFrame:
    """The rows that stay, with all their columns; exactly one for each text."""
    inner = [F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    packed = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id")]
    stays = _matched(df, id_col, text_col, digest, salts, packed).filter(F.col("_id").eqNullSafe(F.col("keep_id")))
    once = stays.select("_digest", "_id", "_row")
    body = F.coalesce(F.col(text_col), F.lit(""))
    ids = df.groupBy(F.col(id_col).alias("_again"), digest(body).alias("_da")).agg(F.count(F.lit(1)).alias("_n"))
    ids = settle(ids.filter("_n > 1").select("_again", "_da"), "repeated")
    if ids.isEmpty():
        return once.select(*inner)
    same = F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_digest") == F.col("_da"))
    single = once.join(ids, same, "left_anti").select(*inner)
    several = once.join(ids, same, "left_semi").withColumn("_t", F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")))
    # Rows may differ in their other columns: the least of them, whatever order they come in.
    least = F.min_by("_row", F.to_json("_row")).alias("_row")
    picked = several.groupBy("_id", "_t").agg(least).select(*inner)
    return single.unionByName(picked)

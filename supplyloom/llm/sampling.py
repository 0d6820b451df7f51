"""Bounded samples of labelled documents for fitting small models."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from supplyloom.sources.storage import settle


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is fold 0."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)).cast("int")


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int,
    held_out_fold: int | None = 1,
    longest: int = 32_768,
) -> pd.DataFrame:
    """At most ``rows`` rows (doc_id, text, label), in the order of a hash of the id.

    Rows of the held-out fold, without text or label, and texts of more than
    ``longest`` characters are not drawn, so the driver gets a bounded sample.
    Both classes are drawn alike, up to half of the rows each, from the labels whose
    texts are in ``docs``, however few of all labels these are.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.filter(F.col("_y").isin(0, 1)).withColumn("doc_id", F.col("_id"))
    if held_out_fold is not None:
        known = known.filter(fold() != held_out_fold)
    picked = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_text")).filter(
        F.col("_text").isNotNull() & (F.length("_text") <= longest)
    )
    # Only ids meet here; labels of documents that are not at hand take no place in the sample.
    found = settle(known.join(picked.select("_d"), F.col("_id") == F.col("_d"), "left_semi"), "labelled")
    half = -(-rows // 2)
    # Top rows by hash: one bounded list per task and class.
    sides = [found.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(half) for y in (0, 1)]
    keys = sides[0].unionByName(sides[1])
    drawn = (
        picked.join(F.broadcast(keys.select("_id", "_y")), F.col("_d") == F.col("_id"))
        .select(F.col("_d").alias("doc_id"), F.col("_text").alias("text"), F.col("_y").alias("label"))
        .withColumn("_h", F.xxhash64("doc_id"))
    )
    parts = [
        drawn.filter(F.col("label") == y).orderBy("_h", "doc_id", "text").limit(half).drop("_h") for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1]).toPandas()


def slices(batch: pa.RecordBatch, text_column: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``chars`` bytes of text, or one longer text, each."""
    lengths = [n or 0 for n in pa.compute.binary_length(batch.column(text_column)).to_pylist()]
    start = held = 0
    for k, n in enumerate(lengths):
        if held and held + n > chars:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)

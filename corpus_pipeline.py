"""A training corpus from raw documents: five stages, each stored before the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from supplyloom.llm import exact_dedup, mixture, ngram_join, packing, toxicity
from supplyloom.llm.shipping import share_code
from supplyloom.llm.tokens import tokenizer_path
from supplyloom.sources.storage import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the toxicity chain rejects."""
    share_code(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.toxicity_model(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, the one with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each similarity class, the one with the smallest doc_id."""
    share_code(spark)
    return ngram_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until sources have their target words."""
    return mixture.mix_documents(docs, mixture.ranked_schedule(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences: one row per piece."""
    share_code(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixture", mix_sources),
    ("packing", pack),
]

#: Tokens, fitted models and similarity classes have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per piece of a document that stays.

    A null text counts as empty in every stage: it is not toxic, all such documents are
    copies of each other, and the mix reads no document without words.  A null source
    is a source of its own.  Without labels no document is rejected as toxic.  Rows that repeat an id and a text are copies too; of such
    rows with other columns the least stays, so reruns agree.  An empty table gives no
    rows, and columns beside those of ``documents`` are carried up to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

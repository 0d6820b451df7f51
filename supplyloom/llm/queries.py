"""The numbered operators on their whole tables, under the names the driver calls."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from supplyloom.llm import (
    ann,
    chat,
    exact_dedup,
    lexical,
    mixture,
    ngram_join,
    packing,
    quality,
    sharding,
    token_files,
    toxicity,
    va_clusters,
    warc,
)
from supplyloom.llm.shipping import share_code
from supplyloom.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHARDS = 24


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        share_code(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_file_digest(_table(spark, folder, "documents"), tokenizer_path())


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.score_quality(docs, quality.quality_model(docs, _table(spark, folder, "labels")))


@query
def op3_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    mixed = mixture.curriculum(docs, mixture.ranked_schedule(docs))
    each = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("passes")).alias("taken"),
        F.get("positions", F.lit(0)).alias("position"),
    )


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, _table(spark, folder, "labels")))


@query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


SQL["op5_exact_dedup"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
grouped AS (
  SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM grouped
"""


@query
def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.similarity_classes(_table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "links", "linked_texts", "class_size")


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path())


#: Fixed by the contract: both turns of conversation -1 say this.
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


@query
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    talks = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)], talks.schema)
    return chat.chat_digest(talks.unionByName(probe))


@query
def op9_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"), [1.0] * SHARDS)


@query
def op10_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"))


@query
def op11_max_sketch_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


#: A term in SQL: the letters of both cases, digits and all beyond ASCII.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms_sql(table: str, key: str) -> str:
    found = f"regexp_extract_all(coalesce(text, ''), '{_TERM}')"
    lower = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT r, {key}, {lower} AS term FROM (SELECT r, {key}, unnest({found}) AS t FROM (SELECT *, row_number() OVER () AS r FROM {table}))"


SQL["op11_max_sketch_search"] = f"""
WITH words AS ({_terms_sql("documents", "doc_id")}),
counted AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes),
holding AS (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM holding, whole),
lengths AS (SELECT r, 50 + (50 * n * docs) // words AS m FROM sizes, whole),
asked AS (SELECT DISTINCT r AS item, item_id, term FROM ({_terms_sql("benchmark", "item_id")})),
scored AS (
  SELECT item, item_id, c.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counted c USING (term) JOIN weighed USING (term) JOIN lengths ON c.r = lengths.r GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query
def op12_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_digest(_table(spark, folder, "pages"))


SQL["op12_warc_archives"] = """
WITH held AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
headed AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS head FROM held)
SELECT page_id, size::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM headed
"""


@query
def op13_va_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return va_clusters.va_clusters(_table(spark, folder, "embeddings")).drop("candidates")


def _rounds_sql() -> str:
    """Five rounds and the last assignment as one chain of common tables."""
    parts = ["""
kept AS (SELECT vec_id, embedding AS e FROM embeddings
         WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
v AS (SELECT vec_id, unnest(range(64)) AS dim, unnest([floor(256 * x::DOUBLE)::BIGINT FOR x IN e]) AS x FROM kept),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c
          FROM kept ORDER BY sha256('2:' || vec_id) LIMIT 40),
c0 AS (SELECT c, dim, x FROM seeds JOIN v USING (vec_id))"""]
    for k in range(6):
        parts.append(f"""
d{k} AS (SELECT vec_id, c, sum((v.x - c{k}.x) * (v.x - c{k}.x))::BIGINT AS d FROM v JOIN c{k} USING (dim) GROUP BY ALL),
a{k} AS (SELECT vec_id, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM d{k} GROUP BY vec_id)""")
        if k < 5:
            parts.append(f"""
m{k} AS (SELECT c, dim, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM v JOIN a{k} USING (vec_id) GROUP BY ALL),
c{k + 1} AS (SELECT c, dim, CASE WHEN s IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} LEFT JOIN m{k} USING (c, dim))""")
    return "WITH " + ",".join(parts)


SQL["op13_va_clusters"] = _rounds_sql() + """,
named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN named USING (c)
"""

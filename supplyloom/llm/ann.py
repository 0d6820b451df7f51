"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred, turned by a learned rotation that brings them close to their
signs (iterative quantisation), and coded as the signs.  A block of codes is
indexed by each of its substrings.  By the pigeonhole principle a code within
Hamming radius r of a query agrees with it in some substring up to r / substrings
bits, so probing all such substring values retrieves every code within r; what
lies within r is ranked by inner products of the original vectors.

The radius is calibrated: the true neighbours of a bounded number of queries are
found by brute force over all rows, in blocks, and the radius covers the wanted
share of them.  Recall is then measured on other queries, searched like any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from supplyloom.sources.storage import settle

#: Rows that the rotation is learned from, and queries that calibrate the radius.
FIT_ROWS = 10_000
CALIBRATION_QUERIES = 200
#: Queries, none of them among those, that recall is measured on.
CHECK_QUERIES = 200
#: Share of true neighbours that the radius must cover in the calibration.
TARGET = 0.97
ROTATIONS = 40
SUBSTRING_BITS = 8
#: Rows of a block of the index, and queries that search it together.
BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384


@dataclass
class Coder:
    """Signs of a rotated, centred vector, in bytes; a byte is a substring."""

    mean: np.ndarray
    rotation: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def learn_rotation(x: np.ndarray, seed: int = 11) -> Coder:
    """Iterative quantisation: alternate signs and the rotation that fits them best.

    The code length is the dimension, filled up to whole bytes.
    """
    d = x.shape[1]
    bits = -(-d // SUBSTRING_BITS) * SUBSTRING_BITS
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    centred = x - mean
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    turn = turn[:d]
    for _ in range(ROTATIONS if len(x) else 0):
        left, _, right = np.linalg.svd(centred.T @ np.sign(centred @ turn), full_matrices=False)
        turn = left @ right
    return Coder(mean, turn)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class SubstringIndex:
    """Rows of a block by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.m = codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(self.m)]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within the radius.

        With r = radius // m, a row within the radius agrees up to r bits in one of
        the first radius % m + 1 substrings or up to r - 1 bits in another one.
        """
        each, extra = divmod(radius, self.m)
        seen = np.zeros(len(self.codes), dtype=bool)
        for j in range(self.m):
            reach = each if j <= extra else each - 1
            if reach < 0:
                continue
            for value in np.flatnonzero(_DISTANCE[code[j]] <= reach):
                a, b = self.starts[j][value], self.starts[j][value + 1]
                if a < b:
                    seen[self.order[j][a:b]] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.codes[rows], code) <= radius]


def usable(vector: Column) -> Column:
    """Not null, not zero, no null and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pd.Series, d: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.array(column.tolist(), dtype=np.float64).reshape(len(column), d)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order."""
    return np.add.reduce(x * q, axis=1)


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:k]


FOUND = "query_id long, vec_id long, score double, distance int, seen long"


def _search_blocks(
    queries: DataFrame, base: DataFrame, coder: Coder, d: int, k: int, radius: int | None, block_rows: int, query_rows: int
) -> DataFrame:
    """The k best rows of every block for every query (all rows if no radius).

    Both sides are dealt into blocks of bounded size by hash and each pair of
    blocks is one task; a vector that many rows share is one row here.
    """
    n, q = base.count(), queries.count()
    n_blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))

    def search(rows_b: pd.DataFrame, rows_q: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score", "distance", "seen"]
        if rows_b.empty or rows_q.empty:
            return pd.DataFrame({c: [] for c in columns}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "distance": "int32", "seen": "int64"})
        x, ids = _matrix(rows_b["v"], d), rows_b["id"].to_numpy()
        y, own = _matrix(rows_q["v"], d), rows_q["id"].to_numpy()
        codes, asked = coder.codes(x), coder.codes(y)
        index = SubstringIndex(codes) if radius is not None else None
        out = []
        for i in range(len(own)):
            near = index.within(asked[i], radius) if index else np.arange(len(ids))
            score = products(x[near], y[i])
            top = best_rows(score, ids[near], k)
            out.append((np.full(len(top), own[i]), ids[near[top]], score[top], hamming(codes[near[top]], asked[i]), np.full(len(top), len(near))))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(columns)})

    b = base.select("id", "v", F.pmod(F.xxhash64("id", F.lit("base")), F.lit(n_blocks)).alias("block"))
    b = b.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    a = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(q_blocks)).cast("int").alias("group"))
    a = a.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return b.groupBy("block", "group").cogroup(a.groupBy("block", "group")).applyInPandas(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    df: DataFrame,
    query_step: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    target: float = TARGET,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k largest inner products of every query, found through the index.

    Queries are the rows whose id is divisible by ``query_step``; every row is
    indexed.  Returns query_id, rank, vec_id, score, radius and recall, the share
    of true neighbours that queries outside the calibration found; other rows stand
    in where queries run short, and without any recall is null.  Rows whose vector is
    null, zero, or holds null or non-finite components take no part, nor do rows
    with a null id.  Vectors are compared with those of their length; each length
    has a rotation, a radius and a recall of its own.  Rows that share a vector
    are searched once and stand for each other, smaller ids first; of rows that
    repeat an id one with the largest vector counts.  An empty table gives no rows.
    """
    spark = df.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = settle(rows.groupBy("id").agg(F.max("v").alias("v")), "vectors")
    out = "query_id long, rank int, vec_id long, score double, radius int, recall double"
    lengths = rows.groupBy(F.size("v").alias("d")).count().collect()
    # A vector that is alone with its length has no neighbours.
    parts = [
        _nearest_of_length(rows.filter(F.size("v") == d), d, query_step, k, target, block_rows, query_rows)
        for d, n in sorted(lengths)
        if n > 1
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], out)


def _nearest_of_length(
    rows: DataFrame, d: int, query_step: int, k: int, target: float, block_rows: int, query_rows: int
) -> DataFrame:
    """The answers among stored rows (id, v) whose vectors all have length ``d``."""
    # A class is a vector, named by the smallest id that has it.  An answer needs
    # at most k of its ids beside the query, so k + 1 of them are listed.
    classes = settle(rows.groupBy("v").agg(F.min("id").alias("class")), "classes")
    base = classes.select(F.col("class").alias("id"), "v")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    members = first.join(classes, "v").select(F.col("class").alias("of"), F.col("id").alias("member"))
    asks = settle(rows.filter(F.col("id") % query_step == 0).join(classes, "v").select("id", "class"), "asks")
    queries = settle(
        asks.select(F.col("class").alias("asked")).distinct().join(base, F.col("asked") == F.col("id")).select("id", "v"), "queries"
    )

    sample = base.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toPandas()
    coder = learn_rotation(_matrix(sample["v"], d))
    probe = settle(queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_QUERIES), "probe")
    others = base.join(probe.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    spare = F.col("_q").isNull()
    others = others.join(queries.select(F.col("id").alias("_q")), F.col("id") == F.col("_q"), "left")
    check = settle(others.orderBy(spare, F.xxhash64("id"), "id").limit(CHECK_QUERIES).select("id", "v"), "check")
    # One more than k, since a query finds itself.
    exact = _ranked(_search_blocks(probe.unionByName(check), base, coder, d, k + 1, None, block_rows, query_rows), k + 1)
    exact = settle(exact.filter("query_id != vec_id").select("query_id", "vec_id", "distance"), "exact")
    of_probe = exact.join(probe.select("id"), F.col("query_id") == F.col("id"), "left_semi")
    distances = np.array([r[0] for r in of_probe.select("distance").collect()], dtype=np.int64)
    radius = int(np.quantile(distances, target, method="higher")) if len(distances) else 0
    through = _ranked(_search_blocks(check, base, coder, d, k + 1, radius, block_rows, query_rows), k + 1)
    through = {(r.query_id, r.vec_id) for r in through.select("query_id", "vec_id").collect()}
    of_check = exact.join(check.select("id"), F.col("query_id") == F.col("id"), "left_semi")
    true = [(r.query_id, r.vec_id) for r in of_check.select("query_id", "vec_id").collect()]
    recall = sum(pair in through for pair in true) / len(true) if true else None

    found = _search_blocks(queries, base, coder, d, k + 1, radius, block_rows, query_rows)
    hits = _ranked(found, k + 1).select("query_id", F.col("vec_id").alias("hit"), "score")
    wide = hits.join(members, F.col("hit") == F.col("of")).select("query_id", F.col("member").alias("vec_id"), "score")
    wide = settle(_ranked(wide, k + 1).drop("rank"), "neighbours")
    # Every query of a class takes the class's list without itself.
    each = asks.select(F.col("id").alias("ask"), F.col("class").alias("asked")).join(wide, F.col("asked") == F.col("query_id"))
    each = each.filter(F.col("ask") != F.col("vec_id")).select(F.col("ask").alias("query_id"), "vec_id", "score")
    return _ranked(each, k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score", F.lit(radius).alias("radius"), F.lit(recall).cast("double").alias("recall")
    )

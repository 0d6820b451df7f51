"""Centroid clustering over a VA-file (vector approximation file).

Every component is an integer.  The approximation of a vector holds, dimension by
dimension, the number of the cell that the component lies in, in a few bits.  For a
centroid a lookup table has the least and the greatest squared distance of each cell
of each dimension, less the distance to the centroids' mean; sums over the dimensions
give an interval that holds the exact distance less that common shift.  Centroids whose interval begins above the least interval end are out, and a
full vector is looked at only where several intervals overlap.

Vectors and approximations are one stored table in buckets of the row's number.  The
first round reads both.  Later rounds read approximations with the cluster of the
round before; full vectors come by a join, whose vector side is stored in buckets and
never shuffled, for rows with several candidates and for rows that changed their
cluster.  Sums of clusters are kept and corrected by the rows that moved, in exact
integers; every task adds its share as one row per cluster.  The last pass needs each vector's distance, so it reads all vectors, but
compares them with their candidates only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from supplyloom.sources.storage import fresh_path, settle

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
SEED_PREFIX = "2:"
#: Bits of a cell's number, and vectors that the cells are laid out by, about, at most.
BITS, SAMPLE_ROWS = 6, 10_000
#: Components beyond this would not leave room for squared distances in 64 bits.
MOST = 1 << 27
#: Rows of a bucket, about, and rows that are compared at a time.
BUCKET_ROWS, ROWS_AT_ONCE = 200_000, 4_096


@dataclass
class Cells:
    """Least and greatest integer of every cell, by dimension."""

    low: np.ndarray
    high: np.ndarray
    bits: int

    @classmethod
    def laid_out(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int) -> Cells:
        """Cells of about equally many sampled values; the outer ones end at the extremes."""
        count = 1 << bits
        low, high = np.empty((len(least), count), np.int64), np.empty((len(least), count), np.int64)
        for d, (a, b) in enumerate(zip(least, most)):
            cut = np.quantile(sample[:, d], np.arange(1, count) / count, method="higher") if len(sample) else np.full(count - 1, b)
            # Cells begin at the cuts; cells that hold no integer are the last one again.
            begin = np.unique(np.clip(cut.astype(np.int64), a + 1, b)) if b > a else np.empty(0, np.int64)
            begin = np.concatenate([[a], begin])
            end = np.concatenate([begin[1:] - 1, [b]])
            pad = count - len(begin)
            low[d], high[d] = np.pad(begin, (0, pad), mode="edge"), np.pad(end, (0, pad), mode="edge")
        return cls(low, high, bits)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Approximations of vectors, in bytes: ``bits`` bits a dimension."""
        number = np.stack([np.searchsorted(self._begins(d), x[:, d], side="right") - 1 for d in range(x.shape[1])], axis=1)
        one_by_one = (number[:, :, None] >> np.arange(self.bits)) & 1
        return np.packbits(one_by_one.reshape(len(x), -1).astype(np.uint8), axis=1)

    def _begins(self, d: int) -> np.ndarray:
        return np.unique(self.low[d])

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        one_by_one = np.unpackbits(packed, axis=1)[:, : len(self.low) * self.bits].reshape(len(packed), -1, self.bits)
        return one_by_one @ (1 << np.arange(self.bits)).astype(np.uint8)


class Intervals:
    """Lookup tables of some centroids: squared distances of every cell, least and greatest.

    Distances are counted from the vector's squared distance to the mean of the
    centroids.  That shift is the same for all centroids, so which one is nearest does
    not change, but what remains is linear in a component and the intervals are narrow.
    """

    def __init__(self, cells: Cells, centroids: np.ndarray):
        middle = centroids.mean(axis=0).round().astype(np.int64)
        c, m = centroids.T[:, None, :], middle[:, None, None]
        begin, end = ((x[:, :, None] - c) ** 2 - (x[:, :, None] - m) ** 2 for x in (cells.low, cells.high))
        self.least, self.greatest = np.minimum(begin, end), np.maximum(begin, end)

    def candidates(self, number: np.ndarray) -> np.ndarray:
        """Rows by centroids: whether the centroid can be the nearest."""
        shape = (len(number), self.least.shape[2])
        begin, end = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for d in range(number.shape[1]):
            begin += self.least[d][number[:, d]]
            end += self.greatest[d][number[:, d]]
        return begin <= end.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, can: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest candidate; ties go to the smaller number."""
    row, of = np.nonzero(can)
    gap = np.empty(len(row), np.int64)
    for a in range(0, len(row), 65_536):
        gap[a : a + 65_536] = ((x[row[a : a + 65_536]] - centroids[of[a : a + 65_536]]) ** 2).sum(axis=1)
    full = np.full(can.shape, np.iinfo(np.int64).max)
    full[row, of] = gap
    best = full.argmin(axis=1)
    return best, full[np.arange(len(x)), best]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)


def _bytes(column: pa.Array) -> np.ndarray:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))


def whole_vectors(df: DataFrame, dimensions: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.coalesce((F.size("v") == dimensions) & fine, F.lit(False))
    )

    def whole(x: Column) -> Column:
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) < float(MOST), F.floor(y)).otherwise(F.raise_error(F.lit("component too large for 64-bit distances")).cast("long"))

    return taken.select("vec_id", F.transform("v", whole).alias("v"))


class _Table:
    """The stored table (row, vec_id, v, cells) in buckets of ``row``."""

    def __init__(self, made: DataFrame, buckets: int):
        spark = made.sparkSession
        self.spark, self.name = spark, f"va_{uuid.uuid4().hex}"
        (
            made.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").option("path", fresh_path(spark, "va-file")).format("parquet").saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


@dataclass
class Sums:
    """Components and rows of every cluster, in integers of any size."""

    components: list[list[int]]
    rows: list[int]

    def add(self, rows: list[int], sums: list[list[int]]) -> None:
        self.rows = [a + b for a, b in zip(self.rows, rows)]
        self.components = [[a + b for a, b in zip(*pair)] for pair in zip(self.components, sums)]

    def centroids(self, now: np.ndarray) -> np.ndarray:
        """Componentwise floors of the means; an empty cluster's centroid stays."""
        return np.array([[s // n for s in total] if n else old.tolist() for total, n, old in zip(self.components, self.rows, now)], dtype=np.int64)


STATE = "row long, cells binary, cluster int, rows long, sums array<bigint>"
STATE_NAMES = ["row", "cells", "cluster", "rows", "sums"]


class _Change:
    """By how much a task's rows change the sums of clusters; ends the task's output."""

    def __init__(self, k: int, d: int):
        self.rows, self.sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)

    def add(self, cluster: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        np.add.at(self.rows, cluster, sign)
        for c in np.unique(cluster).tolist():
            self.sums[c] += sign * x[cluster == c].sum(axis=0)

    def batch(self) -> pa.RecordBatch:
        live = np.flatnonzero((self.rows != 0) | self.sums.any(axis=1))
        none = [pa.nulls(len(live), t) for t in (pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays(
            [*none, pa.array(live, pa.int32()), pa.array(self.rows[live]), _list(self.sums[live])], names=STATE_NAMES
        )


def _state_batch(row: pa.Array, cells: pa.Array, cluster: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(row), t) for t in (pa.int64(), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([row, cells, pa.array(cluster, pa.int32()), *none], names=STATE_NAMES)


def _changes(stored: DataFrame, k: int, d: int) -> tuple[list[int], list[list[int]]]:
    """(rows, sums) of every cluster over all tasks."""
    ends = stored.filter("row IS NULL").select("cluster", "rows", F.posexplode("sums").alias("at", "part"))
    rows, sums = [0] * k, [[0] * d for _ in range(k)]
    for c, at, n, total in ends.groupBy("cluster", "at").agg(F.sum("rows"), F.sum("part")).collect():
        rows[c], sums[c][at] = n, total
    return rows, sums


def _extremes(kept: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, least, greatest) component of every dimension; a task adds one row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = 0, np.full(d, MOST), np.full(d, -MOST)
        for part in _parts(batches):
            x = _matrix(part.column(0), d)
            n, least, most = n + len(x), np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, n)), pa.array(np.arange(d, dtype=np.int32)), pa.array(least), pa.array(most)], names=["n", "at", "least", "most"]
        )

    tasks = kept.select("v").mapInArrow(look, "n long, at int, least long, most long")
    found = tasks.groupBy("at").agg(F.sum("n"), F.min("least"), F.max("most")).orderBy("at").collect()
    return (found[0][1] if found else 0), np.array([r[2] for r in found]), np.array([r[3] for r in found])


def va_clusters(
    df: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = BITS,
    scale: int = SCALE,
    seed_prefix: str = SEED_PREFIX,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, candidates.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite;
    a component x counts as the integer floor(scale * x), and one beyond 2**27 raises.
    Centroids begin as the kept vectors with the smallest hex sha256 of the prefix and
    the id; a null id has no hash and comes last, and of rows that share an id the
    smaller vector comes first.  Ties of distance go to the smaller number, an empty
    cluster keeps its centroid, and tables with fewer vectors than clusters have as many
    clusters as vectors.  Repeated rows are clustered one by one.  ``candidates`` counts
    the centroids whose intervals overlapped in the last pass.  An empty table gives no
    rows, and columns beside the two named are not read.
    """
    spark = df.sparkSession
    kept = settle(
        whole_vectors(df, dimensions, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "whole-vectors"
    )
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, candidates int"
    n, least, most = _extremes(kept, dimensions)
    if not n:
        return spark.createDataFrame([], out)
    named = F.sha2(F.concat(F.lit(seed_prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = kept.orderBy(named.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    centroids = np.array([r[0] for r in seeds], dtype=np.int64)
    k = len(centroids)
    drawn = kept.filter(F.pmod(F.xxhash64("row"), F.lit(-(-n // SAMPLE_ROWS))) == 0).select("v").collect()
    sample = np.array([r[0] for r in drawn], dtype=np.int64).reshape(-1, dimensions)
    cells = Cells.laid_out(sample, least, most, bits)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            packed = cells.pack(_matrix(part.column(2), dimensions))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.tobytes() for p in packed], pa.binary())], names=["row", "vec_id", "v", "cells"])

    table = _Table(
        kept.select("row", "vec_id", "v").mapInArrow(approximate, "row long, vec_id long, v array<bigint>, cells binary"),
        max(1, -(-n // bucket_rows)),
    )
    sums = Sums([[0] * dimensions for _ in range(k)], [0] * k)
    stored = settle(_first_round(table.read(), cells, centroids, dimensions), "va-round")
    state = stored.filter("row IS NOT NULL")
    for at in range(rounds):
        if at:
            marked = settle(_marked(state, cells, centroids), "va-marked")
            asked = marked.filter("fetch").join(table.read().select(F.col("row").alias("_row"), "v"), F.col("row") == F.col("_row"))
            stored = settle(_decided(asked, centroids, dimensions), "va-fetched")
            state = marked.filter(~F.col("fetch")).select("row", "cells", "cluster").unionByName(
                stored.filter("row IS NOT NULL").select("row", "cells", "cluster")
            )
        sums.add(*_changes(stored, k, dimensions))
        centroids = sums.centroids(centroids)
    final = settle(_last_pass(table.read(), cells, centroids, dimensions), "va-final")
    totals = {r[0]: r[1] for r in final.groupBy("cluster").agg(F.sum("distance")).collect()}
    inertia = sum(totals.values())
    known = [
        (c, totals[c], inertia, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(totals)
    ]
    of = spark.createDataFrame(known, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster.
    return final.join(F.broadcast(of), F.col("cluster") == F.col("_cluster")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "candidates"
    )


def _first_round(table: DataFrame, cells: Cells, centroids: np.ndarray, d: int) -> DataFrame:
    """The clusters of all rows, from approximations and vectors together, and their sums."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, change = Intervals(cells, centroids), _Change(len(centroids), d)
        for part in _parts(batches):
            x = _matrix(part.column(2), d)
            best, _ = nearest(x, centroids, tables.candidates(cells.unpack(_bytes(part.column(1)))))
            change.add(best, x)
            yield _state_batch(part.column(0), part.column(1), best)
        yield change.batch()

    return table.select("row", "cells", "v").mapInArrow(assign, STATE)


def _marked(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Add ``old`` and ``fetch``: whether the full vector is needed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Intervals(cells, centroids)
        for part in _parts(batches):
            can, old = tables.candidates(cells.unpack(_bytes(part.column(1)))), part.column(2).to_numpy()
            sure = can.argmax(axis=1)
            fetch = (can.sum(axis=1) > 1) | (sure != old)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(sure, pa.int32()), pa.array(fetch), pa.array([c.tobytes() for c in np.packbits(can, axis=1)], pa.binary())],
                names=["row", "cells", "old", "cluster", "fetch", "can"],
            )

    return state.select("row", "cells", "cluster").mapInArrow(
        mark, "row long, cells binary, old int, cluster int, fetch boolean, can binary"
    )


def _decided(asked: DataFrame, centroids: np.ndarray, d: int) -> DataFrame:
    """The nearest of the candidates, and what the rows that moved change in the sums."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = _Change(len(centroids), d)
        for part in _parts(batches):
            can = np.unpackbits(_bytes(part.column(3)), axis=1)[:, : len(centroids)].astype(bool)
            x, old = _matrix(part.column(4), d), part.column(2).to_numpy()
            best, _ = nearest(x, centroids, can)
            moved = best != old
            change.add(best[moved], x[moved])
            change.add(old[moved], x[moved], -1)
            yield _state_batch(part.column(0), part.column(1), best)
        yield change.batch()

    return asked.select("row", "cells", "old", "can", "v").mapInArrow(decide, STATE)


def _last_pass(table: DataFrame, cells: Cells, centroids: np.ndarray, d: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Intervals(cells, centroids)
        for part in _parts(batches):
            can = tables.candidates(cells.unpack(_bytes(part.column(1))))
            best, gap = nearest(_matrix(part.column(2), d), centroids, can)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(best, pa.int32()), pa.array(gap), pa.array(can.sum(axis=1), pa.int32())],
                names=["vec_id", "cluster", "distance", "candidates"],
            )

    return table.select("vec_id", "cells", "v").mapInArrow(assign, "vec_id long, cluster int, distance long, candidates int")

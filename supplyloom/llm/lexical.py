"""Ranked lexical search with hashed max-sketches.

Index, one pass over the documents: a row holds a document's different terms with
their occurrences, and a sketch.  A term is hashed to one coordinate of the sketch;
a coordinate keeps the largest impact of the terms that fall there.  In one document
an impact rises with the occurrences, whatever the statistics of the collection, so
occurrences are what is folded and the sketch needs no statistics.

Search, a block of items at a time.  A coordinate is never below the impact of any
term there, so the products of sketches and item weights bound all scores from
above, a matrix of documents by items at once.

1. Only sketches are read: the documents with the k highest bounds of each item are
   scored exactly, which gives each item a threshold.
2. Every task goes through its documents in descending bounds, scores them exactly
   and stops where bounds fall below the larger of that threshold and its own k-th
   best score.  What it found is ranked over all tasks.

A document below the threshold by its bound is below it by its score, so nothing is
lost.  All scores are 64-bit integers.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from supplyloom.llm.sampling import slices
from supplyloom.sources.storage import settle

K = 50
#: Coordinates for each different term of a document, and the bounds of a sketch's size.
PER_TERM, LEAST_SIZE, MOST_SIZE = 4, 64, 16_384
#: The largest count that a coordinate holds; it stands for any count from there.
FULL = 255
#: No impact exceeds this: the limit of many occurrences.
TOP_IMPACT = 1_000_000
#: Different (item, term) pairs in a block of items, about.
BLOCK_TERMS = 60_000
#: Cells of the matrix of impacts that are made at a time.
CELLS = 1 << 22
#: Bounds are rounded in single precision; this covers the error.
SLACK = np.float32(1.0002)


def _letters() -> bytes:
    """Bytes by byte: what may stand in a term, A-Z lower-cased, all else a space."""
    keep = [c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)]
    return bytes(keep).lower()


LETTERS = _letters()


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a UTF-8 text in order: runs of ASCII letters, digits and code points
    beyond ASCII, with A-Z lower-cased.  Null has none."""
    return text.translate(LETTERS).split() if text else []


class _Slots(dict):
    """Hashes of terms, remembered up to a bound."""

    def __missing__(self, term: bytes) -> int:
        made = zlib.crc32(term)
        if len(self) < 400_000:
            self[term] = made
        return made


def sketch_size(different: int) -> int:
    """The power of two from ``PER_TERM`` coordinates a term up, within the bounds."""
    return min(MOST_SIZE, max(LEAST_SIZE, 1 << (PER_TERM * different - 1).bit_length()))


def fold(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sketch of a document: the largest count of the terms of each coordinate."""
    made = np.zeros(sketch_size(len(slots)), dtype=np.uint8)
    np.maximum.at(made, slots & np.uint32(len(made) - 1), np.minimum(counts, FULL).astype(np.uint8))
    return made


INDEX = "doc_id long, n long, terms binary, counts binary, sketch binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: row, doc_id, n (terms with repeats), terms, counts, sketch.

    One row per document that has a term; ``row`` names it, since ids may repeat or
    be null.  ``terms`` are joined by spaces, ``counts`` 32-bit integers in their order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Slots()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, out = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1)):
                found = Counter(terms_of(text.as_py()))
                if found:
                    counts = np.fromiter(found.values(), np.uint32, len(found))
                    slots = np.fromiter(map(known.__getitem__, found), np.uint32, len(found))
                    out.append((doc, int(counts.sum(dtype=np.int64)), b" ".join(found), counts.tobytes(), fold(slots, counts).tobytes()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n", "terms", "counts", "sketch"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(read, INDEX).withColumn("row", F.monotonically_increasing_id())
    return settle(made, "lexical-index")


def length_factor(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of a document with n terms: 50 parts fixed, 50 in proportion to its length."""
    return 50 + (50 * n.astype(np.int64) * docs) // words


def impact(count: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What a term's occurrences are worth before its weight."""
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


@dataclass
class Block:
    """Items of a block: their numbers, the terms in use, weights by item and term."""

    items: list[int]
    terms: dict[bytes, int]
    weights: np.ndarray
    docs: int
    words: int
    _by_size: dict[int, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_by_size": {}}

    def columns(self, size: int) -> np.ndarray:
        """Weights by coordinate of a sketch of this size, and item."""
        if size not in self._by_size:
            slots = np.array([zlib.crc32(t) & (size - 1) for t in self.terms], dtype=np.int64)
            made = np.zeros((size, len(self.items)), dtype=np.float32)
            np.add.at(made, slots, self.weights.T.astype(np.float32))
            self._by_size[size] = made
        return self._by_size[size]

    def bounds(self, sketches: list[bytes], n: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of all documents (rows) for all items."""
        out = np.empty((len(sketches), len(self.items)), dtype=np.float32)
        m = length_factor(n, self.docs, self.words).astype(np.float32)
        sizes = np.array([len(s) for s in sketches])
        for size in np.unique(sizes).tolist():
            mine, step = np.flatnonzero(sizes == size), max(1, CELLS // size)
            for a in range(0, len(mine), step):
                at = mine[a : a + step]
                count = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), size).astype(np.float32)
                most = np.float32(1e9) * count / (1000 * count + 20 * m[at, None])
                most[count == FULL] = TOP_IMPACT
                out[at] = most @ self.columns(size)
        return out * SLACK

    def exact(self, terms: bytes, counts: bytes, n: int, items: np.ndarray) -> np.ndarray:
        """Scores of one document for some items."""
        place = list(map(self.terms.get, terms.split()))
        held = [k for k, p in enumerate(place) if p is not None]
        count = np.frombuffer(counts, np.uint32)[held].astype(np.int64)
        m = int(length_factor(np.array([n]), self.docs, self.words)[0])
        return self.weights[items[:, None], [place[k] for k in held]] @ impact(count, m)


BOUNDS = "item int, row long, bound float"
SCORED = "item int, doc_id long, score long"


def _highest_bounds(index: DataFrame, block: Block, k: int) -> DataFrame:
    """For every item the documents of each task with the k highest bounds."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_bound = np.empty((0, len(block.items)), np.float32)
        best_row = np.empty((0, len(block.items)), np.int64)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            bound = block.bounds(batch.column(2).to_pylist(), batch.column(1).to_numpy())
            row = np.broadcast_to(batch.column(0).to_numpy()[:, None], bound.shape)
            bound, row = np.concatenate([best_bound, bound]), np.concatenate([best_row, row])
            if len(bound) > k:
                top = np.argpartition(bound, len(bound) - k, axis=0)[-k:]
                bound, row = np.take_along_axis(bound, top, axis=0), np.take_along_axis(row, top, axis=0)
            best_bound, best_row = bound, row
        item = np.broadcast_to(np.arange(len(block.items), dtype=np.int32), best_bound.shape)
        live = best_bound > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(item[live]), pa.array(best_row[live]), pa.array(best_bound[live])], names=["item", "row", "bound"]
        )

    return index.select("row", "n", "sketch").mapInArrow(look, BOUNDS)


def _thresholds(index: DataFrame, block: Block, k: int) -> np.ndarray:
    """The k-th exact score among the k documents of the highest bounds, by item."""
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "row")
    first = _highest_bounds(index, block, k).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
    # At most k rows for each item of a block.
    first = settle(first.select("item", F.col("row").alias("_row")), "lexical-first")
    held = index.join(F.broadcast(first), F.col("row") == F.col("_row")).select("item", "doc_id", "n", "terms", "counts")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, doc, n, terms, counts = (c.to_pylist() for c in batch.columns)
            made = [int(block.exact(t, c, x, np.array([i]))[0]) for i, x, t, c in zip(item, n, terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], names=["item", "doc_id", "score"])

    out = np.zeros(len(block.items), dtype=np.int64)
    scores: dict[int, list[int]] = {}
    for r in held.mapInArrow(score, SCORED).select("item", "score").collect():
        scores.setdefault(r[0], []).append(r[1])
    for item, found in scores.items():
        if len(found) >= k:
            out[item] = sorted(found)[-k]
    return out


class _Best:
    """The k best (score, doc) of one item so far: higher scores, then smaller ids, null last."""

    def __init__(self, k: int, threshold: int):
        self.k, self.least, self.held = k, threshold, []

    def add(self, score: int, doc: int | None) -> None:
        if score > 0 and score >= self.least:
            self.held.append((-score, doc is None, doc or 0))
            if len(self.held) >= 4 * self.k:
                self.shrink()

    def shrink(self) -> None:
        if len(self.held) > self.k:
            self.held = sorted(self.held)[: self.k]
            self.least = max(self.least, -self.held[-1][0])


def _descend(index: DataFrame, block: Block, thresholds: np.ndarray, k: int, chunk: int = 64) -> DataFrame:
    """Exact scores in descending bounds, until the bounds fall below the threshold."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k, int(t)) for t in thresholds]
        for batch in (part for whole in batches for part in slices(whole, 2)):
            docs, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            terms, counts = batch.column(2), batch.column(3)
            bound = block.bounds(batch.column(4).to_pylist(), n)
            # A document is scored once for all items that may want it, best bound first.
            least = np.array([b.least for b in best], dtype=np.float32)
            hope = np.where(bound >= np.maximum(least, 1), bound, 0)
            top = hope.max(axis=1)
            order = np.argsort(-top, kind="stable")
            order = order[top[order] > 0]
            for a in range(0, len(order), chunk):
                for d in order[a : a + chunk].tolist():
                    items = np.flatnonzero(bound[d] >= np.maximum(least, 1))
                    if len(items):
                        made = block.exact(terms[d].as_py(), counts[d].as_py(), int(n[d]), items)
                        for i, s in zip(items.tolist(), made.tolist()):
                            best[i].add(s, docs[d])
                for b in best:
                    b.shrink()
                least = np.array([b.least for b in best], dtype=np.float32)
        found = [(i, None if null else doc, -s) for i, b in enumerate(best) for s, null, doc in sorted(b.held)[:k]]
        if found:
            kinds = [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["item", "doc_id", "score"])

    return index.select("doc_id", "n", "terms", "counts", "sketch").mapInArrow(search, SCORED)


ASKED = "item_row long, item_id long, term binary"


def _asked(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """The different terms of every item: item_row, item_id, term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            for row, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                terms = sorted(set(terms_of(text.as_py())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(terms), pa.int64()), pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())],
                    names=["item_row", "item_id", "term"],
                )

    rows = items.select(
        F.monotonically_increasing_id().alias("item_row"), F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")
    )
    return settle(rows.mapInArrow(read, ASKED), "lexical-items")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores rank by ascending doc_id, null last.
    Every row of ``docs`` is a document and every row of ``items`` an item, also if
    ids repeat or are null.  Null and empty texts have no terms: such documents are
    found by no item and such items find nothing.  Empty tables give no rows, and
    columns beside those named are not read.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    asked = _asked(items, item_col, item_text_col)
    n, words = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    pairs = asked.count()
    if not n or not pairs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    term = F.explode(F.split(F.col("terms").cast("string"), " "))
    holding = index.select(term.alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("holding"))
    blocks = -(-pairs // block_terms)
    weighed = asked.join(holding, F.col("term").cast("string") == F.col("_term"), "left")
    weighed = settle(
        weighed.select("item_row", "item_id", "term", F.coalesce("holding", F.lit(0)).alias("holding"), F.pmod(F.xxhash64("item_row"), F.lit(blocks)).alias("block")),
        "lexical-asked",
    )
    parts = []
    for b in range(blocks):
        block = _block(weighed.filter(F.col("block") == b), n, words)
        if block.items:
            found = _descend(index, block, _thresholds(index, block, k), k)
            numbered = spark.createDataFrame(list(enumerate(block.items)), "_item int, item_row long")
            parts.append(found.join(F.broadcast(numbered), F.col("item") == F.col("_item")).select("item_row", "doc_id", "score"))
    ids = weighed.select(F.col("item_row").alias("_row"), "item_id").distinct()
    order = Window.partitionBy("item_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(ids, F.col("item_row") == F.col("_row")).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _block(rows: DataFrame, docs: int, words: int) -> Block:
    """A block of about ``BLOCK_TERMS`` (item, term) pairs on the driver."""
    held = rows.select("item_row", "term", "holding").collect()
    items = sorted({r[0] for r in held})
    terms = {t: k for k, t in enumerate(sorted({bytes(r[1]) for r in held if r[2]}))}
    number = {i: k for k, i in enumerate(items)}
    weights = np.zeros((len(items), len(terms)), dtype=np.int64)
    for i, t, holding in held:
        if holding:
            weights[number[i], terms[bytes(t)]] = weight(docs, holding)
    return Block(items, terms, weights, docs, words)

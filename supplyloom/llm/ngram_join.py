"""Similarity join on word n-grams: a MinHash LSH forest and exact verification.

1. Every document's set of word shingles gets a signature: ``trees`` labels of
   ``depth`` MinHash values each.  Documents with equal sets are one class.
2. Each tree is a prefix trie of its labels, kept as sorted order: labels are
   range-sorted, and a class hangs on the head of the deepest trie node that it shares
   with the class before it.  Matched prefixes are shortened from whole labels until
   the hardest matches found meet the target recall: the agreement of whole signatures
   tells how similar each of the matches is, and the length is the longest at which
   the least similar of all of them would meet in some tree with the target probability.  It
   never falls below the length that pairs just at the threshold need (5 of 8 levels
   by default), which also holds where no match is found.  Classes below one node of
   that length are candidates of each other.
3. Candidates form components.  Within a component all pairs are verified on
   their whole shingle sets, in blocks of bounded size; a task returns the number
   of links of each member and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from supplyloom.llm.components import connected
from supplyloom.sources.storage import settle

WORDS_PER_SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 8
TARGET_RECALL = 0.9999
#: What a comparison of signatures may err by: two deviations of 192 values at a
#: similarity of 0.8.
MATCH_MARGIN = 0.06
#: Bytes of one MinHash value in a label.
LEVEL = 2
#: Members and bytes of shingles that one block of a component holds at most.
BLOCK_MEMBERS = 512
BLOCK_BYTES = 8_000_000
#: Hash slots that tell which texts are read again, and the most of them in use with
#: which they still keep enough out: a table of a few megabytes.
PRUNE_SLOTS = 1 << 22
MOST_SLOTS = 1 << 20
#: Columns of the membership matrix that are multiplied at a time.
COLUMNS = 8_192


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """Shorten the prefix until a pair at the threshold is met with the target recall.

    A level agrees with the pair's similarity as its probability.
    """
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= target:
            return length
    return 1


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        made = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = made
        return made


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: _WordHashes, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles of ``size`` words.

    Words are cut at white space and lower-cased.  A text of fewer words is one
    shingle of all of them; a text without words has none.
    """
    found = (text or "").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, np.uint64(span))
    for k in range(span):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return np.unique(out)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(sh: np.ndarray, multipliers: np.ndarray) -> bytes:
    """MinHash values of all trees, 16 bits each, big-endian so labels sort as bytes."""
    low = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(sh), 1024):
        part = (sh[a : a + 1024, None] * multipliers) >> np.uint64(32)
        low = np.minimum(low, part.astype(np.uint32).min(axis=0))
    short = (_mixed(low.astype(np.uint64) + multipliers) >> np.uint64(16)).astype(">u2")
    return short.tobytes()


def class_key(sh: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    made = hashlib.blake2b(sh.tobytes(), digest_size=16).digest()
    return int.from_bytes(made[:8], "big", signed=True), int.from_bytes(made[8:], "big", signed=True)


def sketches(df: DataFrame, trees: int, depth: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text hash, key (k1, k2), shingle count and signature of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, multipliers = _WordHashes(), _multipliers(trees * depth)
        for batch in batches:
            k1, k2, n, signs = [], [], [], []
            for text in batch.column(1):
                sh = shingles(text.as_py(), words, size)
                key = class_key(sh)
                k1.append(key[0]), k2.append(key[1]), n.append(len(sh))
                signs.append(signature(sh, multipliers) if len(sh) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(signs, pa.binary())],
                names=["doc_id", "text_hash", "k1", "k2", "n", "signature"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(sketch, "doc_id long, text_hash long, k1 long, k2 long, n long, signature binary")


def _common_levels(a: bytes, b: bytes) -> int:
    for k in range(0, len(a), LEVEL):
        if a[k : k + LEVEL] != b[k : k + LEVEL]:
            return k // LEVEL
    return len(a) // LEVEL


def forest_edges(classes: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """Edges (u, v, levels) between classes whose labels share that many levels.

    ``classes`` has (cid, signature).  The edges of at least L levels connect exactly
    the classes of each trie node of length L, for every L from ``floor`` up.  Labels are
    range-sorted with the class as the last key, so even equal labels spread over
    tasks.  A task walks its sorted labels and hangs each on the head of the deepest
    node that it shares with the one before; nodes that cross tasks are joined through
    the first and last label of every task.
    """
    labels = [F.substring("signature", t * depth * LEVEL + 1, depth * LEVEL) for t in range(trees)]
    rows = classes.filter("signature is not null").select(
        "cid", F.posexplode(F.array(*labels)).alias("tree", "label")
    )
    ordered = rows.repartitionByRange("tree", "label", "cid").sortWithinPartitions("tree", "label", "cid")
    schema = "u long, v long, levels int, part int, tree int, label binary, is_last boolean"
    names = ["u", "v", "levels", "part", "tree", "label", "is_last"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = 0
        # The first class of the node of each length that the walk is in.
        heads: list[int] | None = None
        before: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for cid, tree, label in zip(*(c.to_pylist() for c in batch.columns)):
                same = _common_levels(before[2], label) if before is not None and before[1] == tree else 0
                if before is None:
                    out.append((cid, cid, 0, part, tree, label, False))
                if same < floor:
                    first, heads = cid, None
                else:
                    if heads is None:
                        heads = [first] * (depth + 1)
                    out.append((cid, heads[same], same, None, None, None, None))
                    heads[same + 1 :] = [cid] * (depth - same)
                before = (cid, tree, label)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if before is not None:
            last = [(before[0], before[0], 0, part, before[1], before[2], True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last), kinds)], names=names)

    walked = settle(ordered.select("cid", "tree", "label").mapInArrow(walk, schema), "forest")
    # Two rows per task: the last label of one is compared with the first of the next.
    order = Window.orderBy("part", "is_last")
    seams = walked.filter("part is not null").withColumns(
        {"pu": F.lag("u").over(order), "pt": F.lag("tree").over(order), "pl": F.lag("label").over(order)}
    )
    shared = [
        (F.substring("pl", 1, k * LEVEL) == F.substring("label", 1, k * LEVEL)).cast("int") for k in range(1, depth + 1)
    ]
    seams = seams.filter(~F.col("is_last") & (F.col("pt") == F.col("tree"))).select(
        "u", F.col("pu").alias("v"), sum(shared, F.lit(0)).alias("levels")
    )
    return walked.filter("part is null").select("u", "v", "levels").unionByName(seams.filter(F.col("levels") >= floor))


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal MinHash values of two signatures (a, b)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(c.to_pylist()), f"u{LEVEL}").reshape(batch.num_rows, -1) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array((a == b).mean(axis=1))], names=["s"])


def matched_length(
    edges: DataFrame, classes: DataFrame, threshold: float, trees: int, depth: int, target: float
) -> int:
    """The prefix length that the matches found call for.

    The signatures of every edge are compared.  Edges whose signatures agree as pairs
    at the threshold may are matches; the least similar of all of them, less what the
    comparison may err by, sets the length.  Without matches the threshold sets it.
    """
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct()
    left = classes.select(F.col("cid").alias("u"), F.col("signature").alias("a"))
    right = classes.select(F.col("cid").alias("v"), F.col("signature").alias("b"))
    likeness = pairs.join(left, "u").join(right, "v").select("a", "b").mapInArrow(_agreement, "s double")
    least = likeness.filter(F.col("s") >= threshold - MATCH_MARGIN).agg(F.min("s")).first()[0]
    hardest = threshold if least is None else max(threshold, least - MATCH_MARGIN)
    return prefix_length(hardest, trees, depth, target)


def similar_pairs(
    sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) with a in ``rows``, b in ``columns`` and Jaccard similarity at
    or above the threshold, from products of membership matrices."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(joined, return_inverse=True, return_counts=True)
    # A shingle of one member belongs to no intersection.
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, owner = number[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(rows), len(columns)))
    in_rows, in_columns = np.full(len(sets), -1), np.full(len(sets), -1)
    in_rows[rows], in_columns[columns] = np.arange(len(rows)), np.arange(len(columns))
    total = int(shared.sum())
    for a in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        c, o = column[lo:hi] - a, owner[lo:hi]
        width = min(COLUMNS, total - a)
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(columns), width), np.float32)
        at = in_rows[o] >= 0
        left[in_rows[o[at]], c[at]] = 1
        at = in_columns[o] >= 0
        right[in_columns[o[at]], c[at]] = 1
        both += left @ right.T
    union = sizes[rows][:, None] + sizes[columns][None, :] - both
    hit = both / union >= threshold
    a, b = np.nonzero(hit)
    return rows[a], columns[b]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component under the links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


VERIFIED = "cid long, links long, linked_docs long, root long, whole boolean"


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """Exact links of candidates: cid, links, linked_docs, root, whole.

    ``members`` has cid, comp, copies, block, blocks and shingles (bytes).  Small
    components share a task; a large one is cut into blocks, and each pair of its
    blocks is a task.  There is a row per member, task and link found there; with
    ``whole`` the task saw the whole component, so the root is final.
    """
    small = F.col("blocks") == 1
    tasks = max(1, -(-members.filter(small).count() // BLOCK_MEMBERS))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select(
        F.when(small, F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.col("comp")).alias("g"),
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "blocks",
        "cid",
        "comp",
        "copies",
        "block",
        "shingles",
    )

    def check(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = keys[2], keys[3]
        out = []
        for _, own in rows.groupby("comp", sort=False):
            own = own.sort_values("cid")
            sets = [np.frombuffer(s, np.uint64) for s in own["shingles"]]
            block, cid, copies = own["block"].to_numpy(), own["cid"].to_numpy(), own["copies"].to_numpy()
            a, b = similar_pairs(sets, np.flatnonzero(block == i), np.flatnonzero(block == j), threshold)
            if i == j:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            n = len(own)
            links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            docs = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
            live = links > 0
            out.append(
                pd.DataFrame(
                    {"cid": cid[live], "links": links[live], "linked_docs": docs[live].astype(np.int64), "root": cid[_roots(n, a, b)][live], "whole": int(keys[1]) == 1}
                )
            )
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "links": [], "linked_docs": [], "root": [], "whole": []}).astype({"cid": "int64", "links": "int64", "linked_docs": "int64", "root": "int64", "whole": "bool"})

    return keyed.groupBy("g", "blocks", "i", "j").applyInPandas(check, VERIFIED)


def _with_shingles(df: DataFrame, members: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Shingle sets of the candidates, one row for each, read from a document of the class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            made = [shingles(t.as_py(), words, size) for t in batch.column(batch.num_columns - 1)]
            # Rows may share their id and even the hash of their text.
            right = [class_key(s) == (x, y) for s, x, y in zip(made, batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            part = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([s.tobytes() for s in made], pa.binary())], names=["cid", "comp", "copies", "shingles"]
            )
            yield part.filter(pa.array(right, pa.bool_()))

    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    # Most texts are no candidates: a stored table of hash slots, which Spark broadcasts
    # by its measured size, keeps them out of the shuffle.  Those it lets pass by chance
    # are left out by the join, as all are where too many slots are in use.
    slot = lambda c: F.pmod(F.col(c), F.lit(PRUNE_SLOTS))
    slots = settle(members.select(slot("text_hash").cast("int").alias("_slot")).distinct().coalesce(1), "slots")
    if slots.count() <= MOST_SLOTS:
        texts = texts.join(slots, slot("_hash").cast("int") == F.col("_slot"), "left_semi")
    held = texts.join(members, same).select("cid", "comp", "copies", "k1", "k2", "text")
    return held.mapInArrow(read, "cid long, comp long, copies long, shingles binary")


def similarity_classes(
    df: DataFrame,
    threshold: float = THRESHOLD,
    size: int = WORDS_PER_SHINGLE,
    trees: int = TREES,
    depth: int = DEPTH,
    target_recall: float = TARGET_RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_members: int = BLOCK_MEMBERS,
) -> DataFrame:
    """One row per document: doc_id, class_id, links, linked_texts, class_size, k1, k2, keeper.

    Two documents are linked when the Jaccard similarity of their shingle sets is
    at least the threshold; documents with equal sets always are, also those
    without words.  ``links`` counts the other documents a document is linked to,
    ``linked_texts`` those among them as different shingle sets.  ``class_id`` is
    the smallest doc_id of the documents that chains of links connect, and
    ``class_size`` their number.  k1 and k2 name the shingle set; ``keeper`` marks
    the documents of the set that stands for the class.  Null ids are read as any
    other; an empty table gives no rows; columns beside the two named are not read.
    """
    sketched = settle(sketches(df, trees, depth, size, id_col, text_col), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
    classes = sketched.groupBy("k1", "k2").agg(
        least.alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("signature").alias("signature")
    )
    classes = classes.select(
        "k1", "k2", F.col("least.d").alias("doc_id"), F.col("least.h").alias("text_hash"), "copies", "n", "signature", F.monotonically_increasing_id().alias("cid")
    )
    classes = settle(classes, "sets")
    edges = forest_edges(classes, trees, depth, prefix_length(threshold, trees, depth, target_recall))
    length = matched_length(edges, classes, threshold, trees, depth, target_recall)
    candidates = connected(edges.filter(F.col("levels") >= length).select("u", "v"))
    known = classes.select("cid", "k1", "k2", "doc_id", "text_hash", "copies", "n")
    joined = settle(known.join(candidates, F.col("cid") == F.col("node")).select("cid", F.col("root").alias("comp"), "k1", "k2", "doc_id", "text_hash", "copies", "n"), "members")
    weights = joined.groupBy(F.col("comp").alias("_comp")).agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_n"))
    blocks = F.greatest(F.ceil(F.col("_m") / block_members), F.ceil(F.col("_n") * 8 / BLOCK_BYTES)).cast("int")
    sized = weights.select("_comp", blocks.alias("blocks"))
    read = settle(_with_shingles(df, joined, size, id_col, text_col).dropDuplicates(["cid"]), "shingles")
    members = read.join(sized, F.col("comp") == F.col("_comp")).withColumn(
        "block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    )
    links = settle(verify(members.drop("_comp"), threshold), "links")

    counts = links.groupBy(F.col("cid").alias("_cid")).agg(F.sum("links").alias("linked_texts"), F.sum("linked_docs").alias("linked_docs"))
    final = links.filter("whole").select(F.col("cid").alias("node"), "root")
    pieces = links.filter("not whole").select(F.col("cid").alias("u"), F.col("root").alias("v"))
    if not pieces.isEmpty():
        final = final.unionByName(connected(pieces))
    final = final.withColumnRenamed("node", "_node")
    placed = (
        known.join(counts, F.col("cid") == F.col("_cid"), "left")
        .join(final, F.col("cid") == F.col("_node"), "left")
        .select(
            "k1", "k2", "doc_id", "cid", "copies", F.coalesce("root", "cid").alias("root"),
            F.coalesce("linked_texts", F.lit(0)).cast("long").alias("linked_texts"),
            (F.coalesce("linked_docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"),
        )
    )
    placed = settle(placed, "placed")
    # The set with the smallest doc_id stands for the class; null ids come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("cid").alias("c")))
    heads = placed.groupBy(F.col("root").alias("_root")).agg(first.alias("head"), F.sum("copies").alias("class_size"))
    named = placed.join(heads, F.col("root") == F.col("_root")).select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("head.d").alias("class_id"), "links", "linked_texts", "class_size",
        (F.col("head.c") == F.col("cid")).alias("keeper"),
    )
    rows = sketched.select("doc_id", "k1", "k2")
    return rows.join(named, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select(
        F.col("doc_id").alias(id_col), "class_id", "links", "linked_texts", "class_size", "k1", "k2", "keeper"
    )


def drop_similar(df: DataFrame, **options) -> DataFrame:
    """The rows that stand for their class, with all their columns; one of each class.

    Of the documents that share the standing set the one with the smallest id
    stays; of rows that repeat both, one.
    """
    found = settle(similarity_classes(df, **options), "classes")
    stays = found.filter(F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    repeats = stays.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("_n"))
    stays = settle(repeats.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_n"), "keepers")
    names = df.columns
    place = len(names)
    text_at = names.index(options.get("text_col", "text"))
    size = options.get("size", WORDS_PER_SHINGLE)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            keys = [class_key(shingles(t.as_py(), words, size)) for t in batch.column(text_at)]
            row = pa.StructArray.from_arrays(batch.columns, names=[f"c{k}" for k in range(place)])
            yield pa.RecordBatch.from_arrays(
                [row, batch.column(names.index(options.get("id_col", "doc_id"))).cast(pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())],
                names=["row", "id", "k1", "k2"],
            )

    inner = ", ".join(f"c{k}: {f.dataType.simpleString()}" for k, f in enumerate(df.schema.fields))
    rows = df.mapInArrow(keyed, f"row struct<{inner}>, id long, k1 long, k2 long")
    same = F.col("id").eqNullSafe(F.col("_d")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    kept = rows.join(stays, same)
    out = [F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)]
    if stays.filter("_n > 1").isEmpty():
        return kept.select(*out)
    # Rows may differ in their other columns: the least of them, whatever order they come in.
    once = kept.filter("_n > 1").groupBy("id", "k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.filter("_n = 1").select(*out).unionByName(once.select(*out))

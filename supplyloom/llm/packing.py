"""Packing token sequences: best fit first, then a search that swaps between bins.

Documents are hashed into groups of bounded size that are packed side by side.
Bins that stay underfull are dealt to new groups and packed again, until one
group is left or a round saves no bin, so waste does not grow with the groups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from supplyloom.llm.sampling import slices
from supplyloom.llm.tokens import CHARS_AT_ONCE, release_buffers, release_words, with_ends, word_encoder
from supplyloom.sources.storage import settle

CAPACITY = 2048
#: Pieces that one task packs together.
PIECES_PER_GROUP = 20_000


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, the first may be shorter."""
    head = total % capacity
    return ([head] if head else []) + [capacity] * (total // capacity)


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every text's ids with ``end_id`` behind them, cut where longer than a bin.

    ``row`` tells rows apart that repeat an id; a null text is the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in (part for whole in batches for part in slices(whole, 2, CHARS_AT_ONCE)):
            out: list[tuple] = []
            made, lengths = with_ends(*encoder.batch(batch.column(2)), end_id)
            raw, at = memoryview(made.tobytes()), 0
            for row, doc, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lengths.tolist()):
                start = 0
                for k, n in enumerate(cut_lengths(total, capacity)):
                    out.append((row, doc, k, start, n, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + n)])))
                    start += n
                at += total
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            del made, raw, columns, out
            release_buffers()

    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(cut, PIECES)


class Bins:
    """Bins of one group with their pieces, found by free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []
        self.fill: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def _file(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_room[room].append(b)
        self.rooms |= 1 << room

    def _tightest(self, size: int) -> int | None:
        """The bin with the least room that still takes ``size``."""
        mask = self.rooms >> size
        if not mask:
            return None
        room = size + (mask & -mask).bit_length() - 1
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        return b

    def best_fit(self, pieces: list[tuple[int, int]]) -> None:
        """Place (size, key) pieces, longest first."""
        for size, key in sorted(pieces, reverse=True):
            b = self._tightest(size)
            if b is None:
                b = len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append((size, key))
            self.fill[b] += size
            self._file(b)

    def improve(self) -> None:
        """Empty underfull bins by moves and exchanges that raise the squared fill.

        Works on the bins that are not full.  From the emptiest on, a bin gives a
        piece to another one with room (move), or trades it for a smaller piece
        (one for one) or for two that are smaller together (two for one).  Every
        underfull bin is a possible partner of every piece; the step that raises
        the sum of squared fills most is taken.  The sum rises with every step, so
        the search ends, and it ends where no step is left.
        """
        self.under = sorted((b for b in range(len(self.items)) if self.fill[b] < self.capacity), key=lambda b: self.fill[b])
        self.fills = np.array([self.fill[b] for b in self.under], dtype=np.int64)
        # rests[t, j]: the most tokens up to t that bin j holds when it gives nothing, a piece or two.
        kind = np.int16 if self.capacity < 2**15 - 1 else np.int32
        self.rests = np.empty((self.capacity + 1, len(self.under)), dtype=kind)
        for j in range(len(self.under)):
            self.rests[:, j] = self._rests(j)
        # A bin is asked again after any step since it was found to have none.
        steps, asked = 0, [-1] * len(self.under)
        moved = True
        while moved:
            moved = False
            for j in np.argsort(self.fills, kind="stable").tolist():
                while asked[j] < steps and self.items[self.under[j]]:
                    if self._give(j):
                        steps, moved = steps + 1, True
                    else:
                        asked[j] = steps

    def _rests(self, j: int) -> np.ndarray:
        b = self.under[j]
        if not self.items[b]:
            return np.full(self.capacity + 1, -self.capacity - 1)
        counts = Counter(size for size, _ in self.items[b])
        ones = pairs = 0
        for size, n in counts.items():
            pairs |= ones << size | (1 << 2 * size if n > 1 else 0)
            ones |= 1 << size
        gives = np.frombuffer((1 | ones | pairs).to_bytes(self.capacity // 8 + 1, "little"), dtype=np.uint8)
        can = np.unpackbits(gives, bitorder="little")[self.fill[b] :: -1]
        rests = np.full(self.capacity + 1, self.fill[b])
        rests[: len(can)] = np.maximum.accumulate(np.where(can, np.arange(len(can)), -self.capacity - 1))
        return rests

    def _give(self, j: int) -> bool:
        b = self.under[j]
        sizes = np.array(sorted({size for size, _ in self.items[b]}, reverse=True), dtype=np.int64)
        best, found = 0, None
        for size in sizes.tolist():
            after = self.rests[self.capacity - size].astype(np.int64) + size
            rise = np.maximum(after - self.fills, 0) * np.maximum(after - self.fills[j], 0)
            rise[j] = 0
            k = int(rise.argmax())
            if rise[k] > best:
                best, found = rise[k], (size, k, int(self.fills[k] + size - after[k]))
        if found is None:
            return False
        size, k, back = found
        item = next(x for x in self.items[b] if x[0] == size)
        self._trade(j, item, k, self._pieces(k, back))
        return True

    def _pieces(self, k: int, total: int) -> list[tuple[int, int]]:
        """No piece, one or two of bin ``k`` that hold ``total`` tokens together."""
        if not total:
            return []
        seen: dict[int, tuple[int, int]] = {}
        pair: list[tuple[int, int]] = []
        for x in self.items[self.under[k]]:
            if x[0] == total:
                return [x]
            if not pair and total - x[0] in seen:
                pair = [seen[total - x[0]], x]
            seen.setdefault(x[0], x)
        return pair

    def _trade(self, j: int, item: tuple[int, int], k: int, back: list[tuple[int, int]]) -> None:
        b, o = self.under[j], self.under[k]
        self.items[b].remove(item)
        self.items[o].append(item)
        for x in back:
            self.items[o].remove(x)
            self.items[b].append(x)
        moved = item[0] - sum(x[0] for x in back)
        self.fill[b] -= moved
        self.fill[o] += moved
        for i in (j, k):
            self.fills[i] = self.fill[self.under[i]]
            self.rests[:, i] = self._rests(i)


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of that bin) of every piece; full pieces get bins of their own."""
    bins = Bins(capacity)
    bins.best_fit([(int(s), k) for k, s in enumerate(sizes)])
    bins.improve()
    where, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
    number = 0
    for items, full in zip(bins.items, bins.fill):
        if not items:
            continue
        at = 0
        for size, key in items:
            where[key], offset[key], fill[key] = number, at, full
            at += size
        number += 1
    return where, offset, fill


PLACED = "row long, piece int, length long, sequence_id long, offset long, fill long"


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Sequence and offset of every piece: row, piece, sequence_id, offset.

    ``pieces`` must be stored and hold row, piece and length up to ``capacity``.
    Underfull bins are dealt anew and their pieces packed again; a group whose new
    bins are no better keeps its old ones, so no round adds a bin.  Rounds end
    when one group was left, or when a round in as many groups saved no bin.
    """
    whole = pieces.filter(F.col("length") == capacity)
    done = whole.select(
        "row", "piece", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity).select("row", "piece", "length")
    turn, groups, bins = 0, max(1, -(-rest.count() // per_group)), None
    while True:

        start = turn << 48

        def pack(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            release_words()
            rows = rows.sort_values(["length", "row", "piece"], ascending=False, ignore_index=True)
            where, offset, fill = pack_group(rows["length"].to_numpy(), capacity)
            first = start + (int(keys[0]) << 24)
            made = pd.DataFrame(
                {"row": rows["row"], "piece": rows["piece"], "length": rows["length"], "sequence_id": first + where, "offset": offset, "fill": fill}
            )
            if "sequence_id" in rows and packing_cost(rows) <= packing_cost(made):
                return rows[list(made.columns)]
            return made

        # Whole bins are dealt, so that a group can keep those it has.
        unit = ["sequence_id"] if turn else ["row", "piece"]
        dealt = rest.withColumn("_g", F.pmod(F.xxhash64(*unit, F.lit(turn)), F.lit(groups)))
        placed = settle(dealt.groupBy("_g").applyInPandas(pack, PLACED), "packed")
        rest = placed.filter(F.col("fill") < capacity)
        # Every bin has one piece at its start.
        left, n, full = placed.agg(
            F.count(F.when(F.col("fill") < capacity, 1)), F.count(F.when(F.col("offset") == 0, 1)),
            F.count(F.when((F.col("offset") == 0) & (F.col("fill") == capacity), 1)),
        ).first()
        fewer = min(groups, max(1, -(-left // per_group)))
        last = groups == 1 or (fewer == groups and bins is not None and n >= bins)
        keep = placed if last else placed.filter(F.col("fill") == capacity)
        done = done.unionByName(keep.drop("length", "fill"))
        if last:
            return done
        turn, groups, bins = turn + 1, fewer, n - full


def packing_cost(rows: pd.DataFrame) -> tuple[int, int]:
    """Bins, then how unevenly they are filled: less is better."""
    fill = rows.loc[rows["offset"] == 0, "fill"]
    return len(fill), -int((fill**2).sum())


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than a sequence are cut into full pieces of which the first
    may be shorter; every other document stays whole.  Null and empty texts are
    the end id alone; rows that repeat an id are packed each for itself; an empty
    table gives no rows.  Other columns are not read.
    """
    pieces = settle(token_pieces(df, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    packed = pack_pieces(pieces, capacity, per_group)
    keys = packed.select(F.col("row").alias("_row"), F.col("piece").alias("_piece"), "sequence_id", "offset")
    joined = pieces.join(keys, (F.col("row") == F.col("_row")) & (F.col("piece") == F.col("_piece")))
    return joined.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

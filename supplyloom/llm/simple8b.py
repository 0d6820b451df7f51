"""Simple-8b word-aligned coding of non-negative integers, vectorised over blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload.  Selector s from 1
to 14 stands for COUNTS[s] values of BITS[s] bits each, lowest first.  Selector 0
is an escape: one value that needs more than 60 bits and is kept whole in the
block's escape list, in order.  Values are cut into blocks of ``block`` values;
each block starts on a word of its own, and the offsets of words and escapes are
kept, so any block can be decoded alone and all can be decoded at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed values of the coding, by selector; 15 is unused.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], dtype=np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], dtype=np.int64)

U64 = np.uint64


@dataclass
class Coded:
    n: int
    block: int
    words: np.ndarray
    word_offsets: np.ndarray
    escapes: np.ndarray
    escape_offsets: np.ndarray


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each position the selector that packs most values from there.

    A value's rank is the number of selectors that are too narrow for it, so
    selector s fits where the highest rank of the next COUNTS[s] values is below
    s; maxima over longer runs are made from those over shorter ones.
    Places behind a block's end hold zeros, with which a word may be filled up.
    """
    n = len(values)
    blocks = -(-n // block)
    small = values.astype(np.uint32) if n and int(values.max()) < 1 << 32 else values
    rank = np.zeros(n, dtype=np.uint8)
    for bits in BITS[1:15].tolist():
        if bits < 8 * small.dtype.itemsize:
            rank += small >= small.dtype.type(1 << bits)
    width = block + int(COUNTS.max())
    run = np.zeros((blocks, width), dtype=np.uint8)
    whole = n // block
    run[:whole, :block] = rank[: whole * block].reshape(whole, block)
    if whole < blocks:
        run[whole, : n - whole * block] = rank[whole * block :]
    fitting = np.zeros((blocks, width), dtype=np.int8)
    held = 1
    for s in range(14, 0, -1):
        while held < COUNTS[s]:
            step = min(held, int(COUNTS[s]) - held)
            run[:, :-step] = np.maximum(run[:, :-step], run[:, step:])
            held += step
        # Where a selector fits all later ones do: they take fewer and wider values.
        fitting += run < s
    best = 15 - fitting[:, :block].reshape(-1)[:n]
    best[best == 15] = 0
    return best


#: Blocks that are coded at a time, which bounds the scratch memory.
BLOCKS_AT_ONCE = 512


def encode(values: np.ndarray, block: int = 1024) -> Coded:
    """Code the values; scratch memory is that of ``BLOCKS_AT_ONCE`` blocks."""
    step = block * BLOCKS_AT_ONCE
    parts = [_encode(values[a : a + step], block) for a in range(0, len(values), step)] or [_encode(values, block)]

    def offsets(pieces: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p) for p in pieces]))]).astype(np.int64)

    return Coded(
        len(values),
        block,
        np.concatenate([p.words for p in parts]),
        offsets([p.word_offsets for p in parts]),
        np.concatenate([p.escapes for p in parts]),
        offsets([p.escape_offsets for p in parts]),
    )


def _encode(values: np.ndarray, block: int) -> Coded:
    values = np.ascontiguousarray(values, dtype=U64)
    n = len(values)
    blocks = -(-n // block)
    starts = np.arange(blocks, dtype=np.int64) * block
    ends = np.minimum(starts + block, n)
    selector = _selectors(values, block)
    step = COUNTS[selector]
    # All blocks advance together, one word at a time.
    at, rows, places = starts.copy(), [], []
    live = np.arange(blocks)
    while len(live):
        rows.append(live)
        places.append(at[live])
        at[live] += step[at[live]]
        live = live[at[live] < ends[live]]
    if not rows:
        none = np.empty(0, dtype=U64)
        return Coded(0, block, none, np.zeros(1, np.int64), none, np.zeros(1, np.int64))
    row = np.concatenate(rows)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))])
    # The k-th word of a block was found in the k-th turn.
    slot = np.concatenate([offsets[r] + k for k, r in enumerate(rows)])
    place = np.empty(len(row), dtype=np.int64)
    place[slot] = np.concatenate(places)
    row = np.repeat(np.arange(blocks), np.diff(offsets))
    chosen = selector[place]
    words = chosen.astype(U64) << U64(60)
    padded = np.concatenate([values, np.zeros(COUNTS.max(), dtype=U64)])
    whole = place + COUNTS[chosen] <= ends[row]
    for s in range(1, 15):
        mine = chosen == s
        here = np.flatnonzero(mine & whole)
        if len(here):
            first = place[here]
            word = padded[first]
            for k in range(1, COUNTS[s]):
                word |= padded[first + k] << U64(k * BITS[s])
            words[here] |= word
        # At most one word per block reaches beyond its end.
        here = np.flatnonzero(mine & ~whole)
        for k in range(COUNTS[s] if len(here) else 0):
            inside = place[here] + k < ends[row[here]]
            words[here[inside]] |= values[place[here][inside] + k] << U64(k * BITS[s])
    escaped = chosen == 0
    escape_counts = np.bincount(row[escaped], minlength=blocks)
    return Coded(
        n,
        block,
        words,
        offsets.astype(np.int64),
        values[place[escaped]],
        np.concatenate([[0], np.cumsum(escape_counts)]).astype(np.int64),
    )


def decode(coded: Coded, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to ``last`` (exclusive), without a loop over words."""
    blocks = len(coded.word_offsets) - 1
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, dtype=U64)
    offsets = coded.word_offsets[first : last + 1]
    words = coded.words[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    selector = (words >> U64(60)).astype(np.int64)
    if (selector == 15).any():
        raise ValueError("not a Simple-8b word")
    counts = COUNTS[selector]
    # Where each word's values go: behind those of its block's earlier words.
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(last - first), np.diff(offsets))
    place = before - before[offsets[:-1]][row] + row * coded.block
    end = np.minimum((row + 1) * coded.block, coded.n - first * coded.block)
    out = np.empty(min(coded.n, last * coded.block) - first * coded.block, dtype=U64)
    for s in range(1, 15):
        here = np.flatnonzero(selector == s)
        if not len(here):
            continue
        mask = U64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            target = place[here] + k
            inside = target < end[here]
            out[target[inside]] = (words[here[inside]] >> U64(k * BITS[s])) & mask
    escaped = np.flatnonzero(selector == 0)
    if len(escaped):
        out[place[escaped]] = coded.escapes[coded.escape_offsets[first] : coded.escape_offsets[last]]
    return out


def decode_ids(coded: Coded, kind: str = "<u4") -> np.ndarray:
    """All values as small integers, decoded ``BLOCKS_AT_ONCE`` blocks at a time."""
    blocks = len(coded.word_offsets) - 1
    parts = [decode(coded, a, a + BLOCKS_AT_ONCE).astype(kind) for a in range(0, blocks, BLOCKS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind)

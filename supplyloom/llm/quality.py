"""Quality score of whole texts from a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and filtered by learned filters of 8 bytes with
stride 4.  Chunks of 256 bytes that overlap by half cover the whole text; a chunk
is described by each filter's mean and maximum in it and passed through a hidden
layer.  Every hidden unit is max-pooled over all chunks of the text and a logistic
unit combines the pooled values into one probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from supplyloom.llm.sampling import fold, labelled_sample, slices

STRIDE = 4
SEGMENT = 128
PER_SEGMENT = SEGMENT // STRIDE
EMBED, FILTERS, HIDDEN = 8, 24, 24
#: Labelled rows that the network is fitted on at most, and steps of the fit.
TRAIN_ROWS = 3_000
TRAIN_STEPS = 800
#: Segments of a tile, and tiles that are filtered at a time.
TILE, TILES_AT_ONCE = 8, 256

Params = dict[str, np.ndarray]


def segments(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts padded to whole segments, and each text's first segment.

    At least two strides of zeros end a text; its last window counts as zeros only.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = [max(2, -(-(len(r) + 2 * STRIDE) // SEGMENT)) for r in raw]
    joined = b"".join(r.ljust(c * SEGMENT, b"\0") for r, c in zip(raw, counts))
    return np.frombuffer(joined, dtype=np.uint8), np.cumsum([0, *counts])


def initial(seed: int) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    width = EMBED * STRIDE
    return {
        "embed": draw(256, EMBED, scale=0.5),
        "near": draw(width, FILTERS, scale=(1 / width) ** 0.5),
        "far": draw(width, FILTERS, scale=(1 / width) ** 0.5),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": draw(2 * FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": draw(HIDDEN, scale=0.2),
        "out_bias": np.zeros(1, np.float32),
    }


def tiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts padded to whole tiles, each text's first segment (and the end
    of the last tile), and each text's number of segments."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = [max(2, -(-(len(r) + 2 * STRIDE) // SEGMENT)) for r in raw]
    padded = [-(-c // TILE) * TILE for c in counts]
    joined = b"".join(r.ljust(c * SEGMENT, b"\0") for r, c in zip(raw, padded))
    return np.frombuffer(joined, dtype=np.uint8), np.cumsum([0, *padded]), np.array(counts)


def _pooled_segments(p: Params, data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum of every filter in every segment; ``last`` are the texts' last segments.

    All products have the shape of one tile, and a text begins a tile, so a text's
    values don't depend on the texts beside it, to the last bit.
    """
    n = len(data) // SEGMENT
    mean, top = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
    blank = np.tile(p["embed"][0], STRIDE)
    silent = np.maximum(blank @ p["near"] + blank @ p["far"] + p["bias"], 0)
    step, width = TILES_AT_ONCE * TILE, TILE * PER_SEGMENT
    far_ahead = None
    for a in range(n - (n % step or step), -1, -step):
        b = min(n, a + step)
        rows = p["embed"][data[a * SEGMENT : b * SEGMENT]].reshape(-1, width, EMBED * STRIDE)
        far = np.matmul(rows, p["far"]).reshape(-1, FILTERS)
        ahead = far[:1].copy()
        # From the last step to the first: what follows a step is known by then.
        far = np.concatenate([far[1:], far[:1] if far_ahead is None else far_ahead])
        far_ahead = ahead
        out = np.maximum(np.matmul(rows, p["near"]).reshape(-1, FILTERS) + far + p["bias"], 0).reshape(b - a, PER_SEGMENT, FILTERS)
        out[last[(last >= a) & (last < b)] - a, -1] = silent
        mean[a:b], top[a:b] = out.mean(axis=1), out.max(axis=1)
    return mean, top


def _chunk_features(mean: np.ndarray, top: np.ndarray) -> np.ndarray:
    """A chunk is a segment and the next one."""
    return np.concatenate([(mean[:-1] + mean[1:]) / 2, np.maximum(top[:-1], top[1:])], axis=1)


def scores(p: Params, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for every text, whatever other texts are scored with it."""
    if not len(texts):
        return np.empty(0)
    data, first, counts = tiles(texts)
    last = first[:-1] + counts - 1
    mean, top = _pooled_segments(p, data, last)
    ahead = np.concatenate([_chunk_features(mean, top), np.zeros((1, 2 * FILTERS), np.float32)])
    hidden = np.matmul(ahead.reshape(-1, TILE, 2 * FILTERS), p["hidden"]).reshape(-1, HIDDEN)
    hidden = np.maximum(hidden + p["hidden_bias"], 0)
    # A text has one chunk less than segments; what begins at its last segment or in
    # its padding is no chunk.
    place = np.arange(len(hidden)) - np.repeat(first[:-1], np.diff(first))
    hidden[place >= np.repeat(counts - 1, np.diff(first))] = 0
    pooled = np.maximum.reduceat(hidden, first[:-1], axis=0).astype(np.float64)
    logit = np.full(len(texts), float(p["out_bias"][0]))
    for unit in range(HIDDEN):  # one after the other, so sums don't depend on the shape
        logit += pooled[:, unit] * float(p["out"][unit])
    return np.array([1 / (1 + math.exp(-x)) for x in np.clip(logit, -30, 30).tolist()])


def _gradient(p: Params, texts: list[str], labels: np.ndarray) -> Params:
    data, first = segments(texts)
    n = len(data) // SEGMENT
    rows = p["embed"][np.concatenate([data, np.zeros(STRIDE, np.uint8)])].reshape(-1, EMBED * STRIDE)
    behind = rows[1:].copy()
    last_windows = first[1:] * PER_SEGMENT - 1
    behind[last_windows] = np.tile(p["embed"][0], STRIDE)
    out = np.maximum(rows[:-1] @ p["near"] + behind @ p["far"] + p["bias"], 0)
    cube = out.reshape(n, PER_SEGMENT, FILTERS)
    mean, where = cube.mean(axis=1), cube.argmax(axis=1)
    top = np.take_along_axis(cube, where[:, None, :], axis=1)[:, 0]
    features = _chunk_features(mean, top)
    hidden = np.maximum(features @ p["hidden"] + p["hidden_bias"], 0)
    hidden[first[1:-1] - 1] = 0
    pooled = np.maximum.reduceat(hidden, first[:-1], axis=0)
    logit = pooled @ p["out"] + p["out_bias"]
    wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels).astype(np.float32) / len(labels)

    # Back: each hidden unit learns from the chunk that won in its text.
    g_hidden = np.zeros_like(hidden)
    last = np.minimum(first[1:] - 1, len(hidden))
    units = np.arange(HIDDEN)
    for k in range(len(texts)):
        own = hidden[first[k] : last[k]]
        best = own.argmax(axis=0)
        live = own[best, units] > 0
        g_hidden[first[k] + best[live], units[live]] = (wrong[k] * p["out"])[live]
    g_features = g_hidden @ p["hidden"].T
    g_mean, g_top = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
    half = g_features[:, :FILTERS] / 2
    g_mean[:-1] += half
    g_mean[1:] += half
    left = top[:-1] >= top[1:]
    g_top[:-1] += g_features[:, FILTERS:] * left
    g_top[1:] += g_features[:, FILTERS:] * ~left
    g_cube = np.repeat(g_mean[:, None, :] / PER_SEGMENT, PER_SEGMENT, axis=1)
    np.put_along_axis(
        g_cube, where[:, None, :], np.take_along_axis(g_cube, where[:, None, :], axis=1) + g_top[:, None, :], axis=1
    )
    g_out = (g_cube.reshape(-1, FILTERS) * (out > 0)).astype(np.float32)
    g_rows = np.zeros_like(rows)
    g_rows[:-1] += g_out @ p["near"].T
    g_behind = g_out @ p["far"].T
    g_behind[last_windows] = 0
    g_rows[1:] += g_behind
    flat = g_rows.reshape(-1, EMBED)[: len(data)]
    g_embed = np.stack([np.bincount(data, weights=flat[:, j], minlength=256) for j in range(EMBED)], axis=1)
    return {
        "embed": g_embed.astype(np.float32),
        "near": rows[:-1].T @ g_out,
        "far": behind.T @ g_out,
        "bias": g_out.sum(axis=0),
        "hidden": features.T @ g_hidden,
        "hidden_bias": g_hidden.sum(axis=0),
        "out": pooled.T @ wrong,
        "out_bias": np.array([wrong.sum()], np.float32),
    }


def fit(texts: list[str], labels: np.ndarray, steps: int = TRAIN_STEPS, batch: int = 32, seed: int = 7) -> Params:
    """Adam with a falling rate; a batch holds both classes alike where both exist."""
    p = initial(seed)
    labels = np.asarray(labels, dtype=np.float32)
    classes = [c for c in (np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)) if len(c)]
    if not classes:
        return p
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        rate = 4e-3 * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        chosen = np.concatenate([rng.choice(c, batch // len(classes)) for c in classes])
        grad = _gradient(p, [texts[i] for i in chosen], labels[chosen])
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.002 * (g * g - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
    return p


def quality_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, steps: int = TRAIN_STEPS) -> Params:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    Both classes are drawn alike, so the bias is moved by the log odds of all
    usable labels, which one aggregation counts.
    """
    sample = labelled_sample(docs, labels, "quality", rows).sort_values(["doc_id", "text"], ignore_index=True)
    p = fit(sample["text"].tolist(), sample["label"].to_numpy(), steps)
    usable = labels.filter((fold() != 1) & F.col("quality").isin(0, 1))
    ones, n = usable.agg(F.sum("quality"), F.count("quality")).first()
    p["out_bias"] = p["out_bias"] + np.float32(np.log(((ones or 0) + 1) / (n - (ones or 0) + 1)))
    return p


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, model: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Whole texts are scored where they lie, without a shuffle.  Null and empty
    texts get the score of an empty text; equal texts score alike to the last bit; an empty
    table gives no rows; columns beside the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                score = scores(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCORED)

"""Toxicity from a chain of linear models over words and word beginnings.

The categories are predicted one after the other, and the probabilities of the
earlier ones are features of the later ones.  While fitting, these probabilities
come from models that have not seen the row (out of fold), so that later models
meet them as they will be on new texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from supplyloom.llm.sampling import fold, labelled_sample, slices
from supplyloom.llm.tokens import release_buffers, release_words

WORDS = re.compile(r"\w+")
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (3, 4, 5, 6)
#: Labelled rows that the chain is fitted on at most, and features it may use.
TRAIN_ROWS = 5_000
VOCABULARY = 2_048
#: Rows of the sample that a feature must occur in.
LEAST_ROWS = 4
FOLDS = 4
#: A toxic text is direct if it holds a word that so many toxic rows and no
#: clean row of the sample hold, otherwise veiled.
DIRECT_SHARE = 0.1
CATEGORIES = ("direct", "veiled", "toxic")


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings; words have even ones."""
    whole = xxhash.xxh64_intdigest(word) & ~1
    return [whole, *(xxhash.xxh64_intdigest(word[:n]) | 1 for n in PREFIXES if len(word) > n)]


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """Fitted models in order; model k sees the features and k probabilities."""

    vocabulary: dict[int, int]
    models: list[Linear] = field(default_factory=list)

    def probabilities(self, present: list[np.ndarray]) -> np.ndarray:
        """Rows of category probabilities for texts given as feature numbers."""
        n = len(self.vocabulary)
        out = np.zeros((len(present), len(self.models)))
        counts = [len(p) for p in present]
        joined = np.concatenate(present) if present else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(present)), counts)
        for k, m in enumerate(self.models):
            z = np.bincount(row, weights=m.weights[joined], minlength=len(present)) + m.bias
            z = z + out[:, :k] @ m.weights[n : n + k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 200, penalty: float = 1e-4) -> Linear:
    """Logistic regression with an L2 penalty by accelerated gradient steps.

    A label that no row has is never predicted, so without labels nothing is rejected.
    """
    n, d = x.shape
    if not y.any():
        return Linear(np.zeros(d), -30.0)
    # Largest curvature: a few power steps are enough for a safe step length.
    u = np.ones(d, np.float32) / max(1, d) ** 0.5
    top = 1.0
    for _ in range(8):
        u = x.T @ (x @ u)
        top = float(np.linalg.norm(u)) or 1.0
        u = u / top
    rate = 1 / (0.3 * top / n + 0.25 + penalty)
    w, b = np.zeros(d, np.float32), 0.0
    seen_w, seen_b, momentum = w, b, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ seen_w + seen_b, -30, 30))) - y).astype(np.float32)
        new_w = seen_w - rate * (x.T @ error / n + penalty * seen_w)
        new_b = seen_b - rate * float(error.mean())
        later = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        seen_w, seen_b = new_w + (momentum - 1) / later * (new_w - w), new_b + (momentum - 1) / later * (new_b - b)
        w, b, momentum = new_w, new_b, later
    return Linear(w.astype(np.float64), float(b))


def features_of(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's different features."""
    found = {f for w in set(WORDS.findall((text or "").lower())) for f in word_features(w)}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def counted(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the chosen rows and the number of these rows that hold each."""
    inside = [r for r, c in zip(rows, chosen) if c]
    return np.unique(np.concatenate(inside or [np.empty(0, np.uint64)]), return_counts=True)


def choose_vocabulary(rows: list[np.ndarray], y: np.ndarray, size: int = VOCABULARY) -> dict[int, int]:
    """Features that tell the classes apart best, by their chi-squared score."""
    y = y.astype(bool)
    every, both = counted(rows, np.ones(len(rows), bool))
    often = both >= LEAST_ROWS
    every, both = every[often], both[often]
    held, ones = counted(rows, y)
    a = np.zeros(len(every))
    at = np.searchsorted(every, held)
    known = at < len(every)
    known[known] = every[at[known]] == held[known]
    a[at[known]] = ones[known]
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    p = both / (n1 + n0)
    score = (a / n1 - (both - a) / n0) ** 2 / (p * (1 - p) + 1e-9)
    best = np.lexsort((every, -score))[:size]
    return {int(f): k for k, f in enumerate(every[best])}


def category_labels(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Columns direct, veiled and toxic of the labelled sample."""
    toxic = toxic.astype(bool)
    held, ones = counted(rows, toxic)
    plain = held[(ones >= DIRECT_SHARE * max(1, toxic.sum())) & (held % np.uint64(2) == 0)]
    plain = plain[~np.isin(plain, counted(rows, ~toxic)[0])]
    direct = np.array([bool(t) and bool(np.isin(plain, r).any()) for r, t in zip(rows, toxic)], dtype=bool)
    return np.stack([direct, toxic & ~direct, toxic], axis=1).astype(np.float32)


def fit_chain(x: np.ndarray, labels: np.ndarray, vocabulary: dict[int, int], folds: int = FOLDS) -> Chain:
    """Fit category after category, with out-of-fold probabilities in between."""
    chain = Chain(vocabulary)
    part = np.arange(len(x)) % folds
    for k in range(labels.shape[1]):
        y = labels[:, k]
        unseen = np.zeros(len(x), np.float32)
        for f in range(folds):
            inside = part != f
            unseen[~inside] = fit_linear(x[inside], y[inside]).probability(x[~inside])
        chain.models.append(fit_linear(x, y))
        x = np.concatenate([x, unseen[:, None]], axis=1)
    return chain


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    """Fit the chain on a bounded sample of labelled rows outside the held-out fold.

    The sample draws both classes alike, so 0.5 is the middle between them.
    """
    sample = labelled_sample(docs, labels, "toxic", rows).sort_values(["doc_id", "text"], ignore_index=True)
    toxic = sample["label"].to_numpy(dtype=np.float32)
    found = [features_of(t) for t in sample["text"]]
    vocabulary = choose_vocabulary(found, toxic)
    x = np.zeros((len(found), len(vocabulary)), np.float32)
    for k, r in enumerate(found):
        x[k, [vocabulary[f] for f in r.tolist() if f in vocabulary]] = 1
    return fit_chain(x, category_labels(found, toxic), vocabulary)


class Reader:
    """Feature numbers of texts; remembers those of frequent words."""

    def __init__(self, vocabulary: dict[int, int], kept_words: int = 500_000):
        self.vocabulary, self.kept_words = vocabulary, kept_words
        self.known: dict[str, tuple[int, ...]] = {}

    def numbers(self, text: str | None) -> np.ndarray:
        known, vocabulary = self.known, self.vocabulary
        if len(known) > self.kept_words:
            known.clear()
        found: set[int] = set()
        for w in set(WORDS.findall((text or "").lower())):
            own = known.get(w)
            if own is None:
                own = tuple(vocabulary[f] for f in word_features(w) if f in vocabulary)
                if len(w) <= 40:
                    known[w] = own
            if own:
                found.update(own)
        # Weights are added up in this order, so reruns agree to the bit.
        return np.sort(np.fromiter(found, dtype=np.int64, count=len(found)))


def chain_scores(model: Chain, reader: Reader, texts: list[str | None]) -> np.ndarray:
    """Category probabilities of texts; a text without words is of no category."""
    p = model.probabilities([reader.numbers(t) for t in texts])
    p[[WORDS.search(t or "") is None for t in texts]] = 0
    return p


SCORED = "doc_id long, held_out boolean, p_direct double, p_veiled double, p_toxic double, toxic int, kept boolean"


def score_toxicity(
    docs: DataFrame, model: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: category probabilities, toxic (0 or 1) and kept.

    Whole texts are scored where they lie, without a shuffle.  Null and empty
    texts get 0 for every category; repeated rows score alike; an empty table gives no
    rows; columns beside the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        reader = Reader(model.vocabulary)
        for batch in batches:
            for part in slices(batch, 2):
                p = chain_scores(model, reader, part.column(2).to_pylist())
                toxic = p[:, -1] >= threshold
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c) for c in p.T), pa.array(toxic.astype(np.int32)), pa.array(~toxic)],
                    names=["doc_id", "held_out", "p_direct", "p_veiled", "p_toxic", "toxic", "kept"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, model: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        reader = Reader(model.vocabulary)
        for batch in batches:
            for part in slices(batch, place):
                p = chain_scores(model, reader, part.column(place).to_pylist())
                yield part.filter(pa.array(p[:, -1] < threshold))
            release_buffers()

    return docs.mapInArrow(run, docs.schema)

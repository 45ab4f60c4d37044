"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are whether a word, a pair of neighbours or a pair with one word
between occurs in a text, each named by a 64-bit hash. Every coordinate has its
own learning rate, and the L1 term leaves most weights at exactly zero, so that
the rest is a small table that is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulesieve.llm.common import WordHashes, text_bytes
from rulesieve.llm.training import held_out, labelled_sample

#: Words looked at together; bounds the memory that a long text takes.
WORDS_AT_ONCE = 200_000
_FILTER_BITS = 1 << 20
_MARKS = b".,;:!?\"'()[]{}*#$%&|"
_PAIR, _SKIP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers that tell the kinds apart


@dataclass(frozen=True)
class Settings:
    """Rates and penalties of the fit. ``rows`` bounds the training sample."""

    rows: int = 12_000
    passes: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    least_documents: int = 3


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A to Z) without marks at their ends."""
    return [w for w in (x.strip(_MARKS) for x in text.lower().split()) if w]


def features_of(words: np.ndarray) -> np.ndarray:
    """Hashes of words, neighbours and pairs with one word between."""
    with np.errstate(over="ignore"):
        parts = [words]
        if len(words) > 1:
            parts.append((words[:-1] * np.uint64(_PAIR)) ^ (words[1:] >> np.uint64(7)))
        if len(words) > 2:
            parts.append((words[:-2] * np.uint64(_SKIP)) ^ (words[2:] >> np.uint64(9)))
    return np.concatenate(parts)


class Ftrl:
    """Weights by FTRL-proximal: ``z`` sums gradients, ``n`` their squares."""

    def __init__(self, size: int, settings: Settings):
        self.z, self.n, self.s = np.zeros(size), np.zeros(size), settings

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        shrunk = -np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
        return shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def fit(texts: list[bytes], y: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes in order, their weights, and the bias."""
    hashes = WordHashes()
    own = [np.unique(features_of(hashes.of(words_of(t)))) for t in texts]
    names, documents = np.unique(np.concatenate(own), return_counts=True) if own else (np.empty(0, np.uint64), None)
    if own:
        names = names[documents >= settings.least_documents]
    bias = len(names)  # the coordinate that every text has
    rows = []
    for features in own:
        at = np.searchsorted(names, features)
        at = at[(at < bias) & (names[np.minimum(at, bias - 1)] == features)] if bias else at[:0]
        rows.append(np.append(at, bias))
    model = Ftrl(bias + 1, settings)
    order = np.random.default_rng(0)
    for _ in range(settings.passes):
        for i in order.permutation(len(rows)):
            model.learn(rows[i], y[i])
    # The bias has no penalty that matters; what is left at zero is dropped.
    weights = model.weights()
    kept = np.flatnonzero(weights[:bias])
    return names[kept], weights[kept], float(weights[bias])


class Scorer:
    """Probabilities of texts under sparse weights."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias, self.hashes = names, weights, bias, WordHashes()
        self.maybe = np.zeros(_FILTER_BITS, bool)
        self.maybe[(names & np.uint64(_FILTER_BITS - 1)).astype(np.int64)] = True

    def __call__(self, text: bytes) -> float:
        words, found = self.hashes.of(words_of(text)), set()
        for start in range(0, len(words), WORDS_AT_ONCE):  # parts share two words, so no pair is lost
            h = features_of(words[start : start + WORDS_AT_ONCE + 2])
            h = h[self.maybe[(h & np.uint64(_FILTER_BITS - 1)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(self.names, h), max(0, len(self.names) - 1))
            found.update(at[self.names[at] == h].tolist() if len(h) else ())
        total = self.bias + sum(self.weights[i] for i in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(sample: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from ``sample(id, text, y)``, fitted in one task as the sample is bounded.

    Rows are sorted first, so the fit does not depend on their arrival. Without
    rows there are no weights, and every score is one half.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted(
            (i, t, y)
            for b in rows
            for i, t, y in zip(b.column("id").to_pylist(), text_bytes(b.column("text")), b.column("y").to_pylist())
        )
        names, weights, bias = fit([t for _, t, _ in table], np.array([y for *_, y in table], float), settings)
        yield pa.RecordBatch.from_pydict(
            {"names": [names.tobytes()], "weights": [weights.tobytes()], "bias": [bias]},
            pa.schema([("names", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64())]),
        )

    row = sample.repartition(1).mapInArrow(run, "names binary, weights binary, bias double").first()
    if row is None:
        return np.empty(0, np.uint64), np.empty(0), 0.0
    return np.frombuffer(row.names, np.uint64), np.frombuffer(row.weights), row.bias


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    settings: Settings = Settings(),
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; every row stays.

    Scores depend on the text alone: a null or empty text has the score of the
    bias, equal texts have equal scores. Other columns pass through.
    """
    model = train(labelled_sample(docs, labels, label, settings.rows, id_col=id_col, text_col=text_col), settings)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_text = Scorer(*model)
        for texts in batches:
            yield pa.array([of_text(t) for t in text_bytes(texts)], pa.float64())

    scored = docs.withColumns({"held_out": held_out(docs[id_col]), "score": score(docs[text_col].cast("string"))})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

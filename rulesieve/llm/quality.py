"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is
described by numbers, encoded by a learned layer, and weighted by gated
attention; the score is that of the weighted sum of encodings. So a document
of fair prose with a stretch of junk can be told by that stretch, and the
weights say which passage decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulesieve.llm.common import WordHashes, give_back, text_bytes
from rulesieve.llm.training import held_out, labelled_sample

#: Words described together; bounds the memory that a long text takes.
WORDS_AT_ONCE = 1 << 18
HASHED = 48  # dimensions that word hashes are summed into


@dataclass(frozen=True)
class Settings:
    """Sizes and rates of the model. ``rows`` bounds the training sample."""

    rows: int = 6_000
    words: int = 64  # of a passage
    encoding: int = 24
    attention: int = 12
    epochs: int = 30
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4


def _byte_classes() -> np.ndarray:
    """Class of every byte: each mark its own; letters by case, digits, blank and the rest together."""
    out, marks = np.zeros(256, np.int64), 5
    for b in range(33, 127):
        c = chr(b)
        out[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else marks
        marks += out[b] == marks
    out[128:] = 4
    return out


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1
FEATURES = _CLASSES + HASHED + 5


def describe(words: list[bytes], hashes: np.ndarray, size: int) -> np.ndarray:
    """One row of ``FEATURES`` numbers per passage of ``size`` words."""
    n = len(words)
    count = -(-n // size)
    passage = np.arange(n) // size
    lengths = np.fromiter(map(len, words), np.int64, n)
    of_byte = np.frombuffer(b"".join(words), np.uint8)
    cell = np.repeat(passage, lengths) * _CLASSES + _CLASS[of_byte]
    classes = np.bincount(cell, minlength=count * _CLASSES).reshape(count, _CLASSES)
    in_passage = np.bincount(passage, minlength=count).astype(float)
    sign = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(float)
    hashed = np.bincount(
        passage * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), weights=sign, minlength=count * HASHED
    ).reshape(count, HASHED)
    named = np.sort((passage.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.ones(n, bool)
    first[1:] = named[1:] != named[:-1]
    distinct = np.bincount((named[first] >> np.uint64(44)).astype(np.int64), minlength=count)
    again = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    repeats = np.bincount(passage[1:][again], minlength=count)
    mean = np.bincount(passage, weights=lengths, minlength=count) / in_passage
    square = np.bincount(passage, weights=lengths.astype(float) ** 2, minlength=count) / in_passage
    return np.column_stack(
        [
            classes / np.maximum(1, classes.sum(1, keepdims=True)),
            hashed / in_passage[:, None],
            distinct / in_passage,
            repeats / in_passage,
            np.log1p(mean),
            np.log1p(np.sqrt(np.maximum(0, square - mean**2))),
            np.log1p(in_passage),
        ]
    )


def passages(text: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """The described passages of a whole text; without words, one row of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES))
    step = WORDS_AT_ONCE // size * size
    return np.vstack(
        [describe(w, hashes.of(w), size) for w in (words[i : i + step] for i in range(0, len(words), step))]
    )


class GatedAttention:
    """Encoder, gated attention and output, with their gradients."""

    def __init__(self, s: Settings, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray] | None = None):
        self.s, self.mean, self.scale = s, mean, scale
        rng = np.random.default_rng(0)

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.w = weights or {
            "E": start(FEATURES, s.encoding), "e": np.zeros(s.encoding),
            "V": start(s.encoding, s.attention), "U": start(s.encoding, s.attention),
            "a": start(s.attention, 1), "c": start(s.encoding, 1), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Scores of bags; ``first`` are the rows at which the bags of ``x`` begin."""
        w, bag = self.w, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(0, x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        u = ((t * g) @ w["a"])[:, 0]
        u = np.exp(u - np.maximum.reduceat(u, first)[bag])
        attention = u / np.add.reduceat(u, first)[bag]
        z = np.add.reduceat(attention[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip((z @ w["c"])[:, 0] + w["b"][0], -30, 30)))
        return p, attention, z, (bag, x, h, t, g)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        p, attention, z, (bag, x, h, t, g) = self.forward(x, first)
        d = ((p - y) / len(y))[:, None]
        dz = d @ w["c"].T
        # Through the weighted sum, then through the softmax of the bag.
        da = (dz[bag] * h).sum(1)
        du = (attention * (da - np.add.reduceat(attention * da, first)[bag]))[:, None]
        dt, dg = du @ w["a"].T * g * (1 - t**2), du @ w["a"].T * t * g * (1 - g)
        dh = (attention[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (h > 0)
        return {
            "E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg,
            "a": (t * g).T @ du, "c": z.T @ d, "b": d.sum(0),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        """Adam over shuffled batches of bags."""
        rng, step = np.random.default_rng(1), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for _ in range(self.s.epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), self.s.batch):
                own = order[at : at + self.s.batch]
                first = np.cumsum([0] + [len(bags[i]) for i in own])[:-1]
                step += 1
                for k, grad in self.gradients(np.vstack([bags[i] for i in own]), first, y[own]).items():
                    grad = grad + self.s.decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    self.w[k] -= (
                        self.s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    )


def fit(texts: list[bytes], y: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """All arrays of the model, from texts and their labels."""
    hashes = WordHashes()
    bags = [passages(t, hashes, s.words) for t in texts]
    rows, ends = np.vstack(bags), np.cumsum([len(b) for b in bags])
    bags = np.split(rows, ends[:-1])  # views, so that passages are held once
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    model = GatedAttention(s, mean, scale)
    model.fit(bags, y)
    return {**model.w, "mean": mean, "scale": scale}


def train(sample: DataFrame, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """The model from ``sample(id, text, y)``, fitted in one task as the sample is bounded.

    Rows are sorted first, so the fit does not depend on their arrival. Without
    rows the model is empty, and every score is one half.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted(
            (i, t, y)
            for b in rows
            for i, t, y in zip(b.column("id").to_pylist(), text_bytes(b.column("text")), b.column("y").to_pylist())
        )
        if table:
            found = fit([t for _, t, _ in table], np.array([y for *_, y in table], float), s)
            yield pa.RecordBatch.from_pydict(
                {
                    "name": list(found),
                    "columns": [v.shape[1] if v.ndim > 1 else 0 for v in found.values()],
                    "content": [v.tobytes() for v in found.values()],
                },
                pa.schema([("name", pa.string()), ("columns", pa.int32()), ("content", pa.binary())]),
            )
        del table
        give_back()

    rows = sample.repartition(1).mapInArrow(run, "name string, columns int, content binary").collect()
    return {
        r["name"]: np.frombuffer(r["content"]).reshape((-1, r["columns"]) if r["columns"] else -1) for r in rows
    }


def quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
    s: Settings = Settings(),
    train_on: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; every row stays.

    ``train_on`` are the documents that labels refer to, by default ``docs``.
    Scores depend on the whole text alone: a null or empty text is one passage
    without words, equal texts have equal scores. Other columns pass through.
    """
    source = docs if train_on is None else train_on
    model = train(labelled_sample(source, labels, label, s.rows, id_col=id_col, text_col=text_col), s)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        net = GatedAttention(s, model["mean"], model["scale"], model) if model else None

        def of_text(text: bytes) -> float:
            return float(net.forward(passages(text, hashes, s.words), np.zeros(1, np.int64))[0][0]) if net else 0.5

        for texts in batches:
            yield pa.array([of_text(t) for t in text_bytes(texts)], pa.float64())
            give_back()

    scored = docs.withColumns({"held_out": held_out(docs[id_col]), "score": score(docs[text_col].cast("string"))})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

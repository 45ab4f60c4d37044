"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders are mixed with weights that depend on
how often the context was seen. The weights are learned by expectation
maximisation on deleted counts: every training token is predicted from the
counts of all others.

Counts come from the whole corpus, and every text asks for the counts of its
own n-grams, so both sides are as large as the corpus. Texts are therefore laid
out in blocks of tokens, n-grams are named by hashes, and a block sends each
distinct n-gram once, packed in order, to the bucket of its hash. A bucket adds
up the counts of all blocks and answers each block in the order of its keys.
Buckets and blocks are bounded, their number grows with the input.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulesieve.llm.common import WordHashes, batches, fold, stored, text_bytes

#: Tokens of a block, and n-grams of a bucket, about.
BLOCK_TOKENS, BUCKET_KEYS = 1_200_000, 1_000_000
#: Tokens of a block looked at together; bounds the memory.
TOKENS_AT_ONCE = 1 << 18
#: Words are told apart by so many bytes of their hashes.
WORD_BYTES = 6
_WORD = np.uint64((1 << 8 * WORD_BYTES) - 1)
#: Names of the token that ends a text and of the one before its first.
END, BEGIN = np.uint64(0xF42D4C957F2D), np.uint64(0x7B7EF767814F)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
CONTEXTS = 32  # classes of context frequency
#: Classes of an estimate for the fit: 0 and powers of two down to 2 ** -62, below that of any count in a corpus.
LEVELS = 64


@dataclass(frozen=True)
class Settings:
    order: int = 3
    folds: int = 7
    held_out: int = 2
    rounds: int = 40


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0, byte by byte of all of them, as many bytes as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpacked(content: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(memoryview(content)[1:]), np.uint8).reshape(content[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8")[:, 0]


def _blocks(docs: DataFrame) -> DataFrame:
    """``docs(id, text, held)`` as blocks of tokens.

    ``codes`` index ``words``, the most frequent first. The name of a block is drawn at
    random, so the table must be stored before it is used.
    """

    def block(ids: list, held: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        words, codes, often = np.unique(tokens, return_inverse=True, return_counts=True)
        by_count = np.argsort(-often, kind="stable")
        turn = np.empty(len(words), np.int64)
        turn[by_count] = np.arange(len(words))
        words, codes = words[by_count], turn[codes]
        lengths = np.array([len(p) for p in parts], "<i8")
        train = int(lengths[~np.array(held, bool)].sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([secrets.randbits(62)]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([_packed(lengths)], pa.binary()),
                pa.array([words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()], pa.binary()),
                pa.array([_packed(codes)], pa.binary()),
                pa.array([len(tokens)], pa.int64()),
                pa.array([train], pa.int64()),
            ],
            ["block", "ids", "held", "lengths", "words", "codes", "tokens", "train"],
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, held, parts, n = [], [], [], 0
        for batch in batches(rows, 200):
            for i, h, t in zip(
                batch.column("id").to_pylist(), batch.column("held").to_pylist(), text_bytes(batch.column("text"))
            ):
                ids.append(i)
                held.append(h)
                parts.append(np.append(hashes.of(t.lower().split()) & _WORD, END))
                n += len(parts[-1])
                if n >= BLOCK_TOKENS:
                    yield block(ids, held, parts)
                    ids, held, parts, n = [], [], [], 0
        if parts:
            yield block(ids, held, parts)

    return docs.mapInArrow(
        run,
        "block long, ids array<long>, held array<boolean>, lengths binary, words binary, codes binary, "
        "tokens long, train long",
    )


class Tokens:
    """The tokens of a stored block and the names of its n-grams."""

    def __init__(self, row: dict):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lengths = _unpacked(row["lengths"])
        stored = np.frombuffer(row["words"], np.uint8).reshape(-1, WORD_BYTES)
        words = np.zeros((len(stored), 8), np.uint8)
        words[:, :WORD_BYTES] = stored
        self.names = words.view(np.uint64)[:, 0][_unpacked(row["codes"])]
        self.first = np.cumsum(self.lengths) - self.lengths  # where texts begin

    def grams(self, order: int) -> np.ndarray:
        """Names of the n-grams that end at each token; before a text stand ``BEGIN`` tokens."""
        name, earlier = self.names * np.uint64(_MIX[0]), self.names
        for step in range(1, order):
            shifted = np.empty_like(earlier)
            shifted[1:] = earlier[:-1]
            shifted[self.first] = BEGIN
            earlier = shifted
            name = (name ^ (name >> np.uint64(31))) * np.uint64(_MIX[1]) + earlier * np.uint64(_MIX[2])
        name = (name ^ (name >> np.uint64(29))) * np.uint64(_MIX[1])
        return name ^ (name >> np.uint64(32))


def _below(bits: int) -> int:
    """Bits of a key below those of the bucket."""
    return min(40, 64 - bits)


def _keys(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block in order, and each token's place in them."""
    return np.unique(grams >> np.uint64(64 - bits - _below(bits)), return_inverse=True)


def _requests(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """One row per block, order and bucket: distinct keys and how often they are in training texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                block = Tokens(row)
                train = np.repeat(~block.held, block.lengths)
                for n in range(1, order + 1):
                    keys, place = _keys(block.grams(n), bits)
                    counts = np.bincount(place[train], minlength=len(keys)).astype("<u4")
                    cuts = np.searchsorted(keys >> np.uint64(_below(bits)), np.arange((1 << bits) + 1, dtype=np.uint64))
                    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]
                    high = ((keys >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2")
                    out = [
                        (bucket, low[a:b].tobytes(), _packed(np.diff(high[a:b], prepend=zero)), _packed(counts[a:b]))
                        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:]))
                        if a < b
                    ]
                    own, lows, highs, sums = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int32()),
                            pa.array([n] * len(out), pa.int32()),
                            pa.array([row["block"]] * len(out), pa.int64()),
                            pa.array(lows, pa.binary()),
                            pa.array(highs, pa.binary()),
                            pa.array(sums, pa.binary()),
                        ],
                        ["bucket", "n", "block", "low", "high", "counts"],
                    )

    zero = np.zeros(1, "<u2")
    needed = blocks.select("block", "ids", "held", "lengths", "words", "codes")
    return needed.mapInArrow(run, "bucket int, n int, block long, low binary, high binary, counts binary")


def _replies(requests: DataFrame) -> DataFrame:
    """Per request the counts of its keys over all blocks; ``types`` counts trained keys, once a bucket."""

    def run(table: pa.Table) -> pa.Table:
        highs = [np.cumsum(_unpacked(x), dtype="<u2") for x in table.column("high").to_pylist()]
        keys = np.concatenate(highs).astype("<u8") << np.uint64(24)
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, 3)
        keys.view(np.uint8).reshape(-1, 8)[:, :3] = low
        counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()])
        found, place = np.unique(keys, return_inverse=True)
        totals = np.bincount(place, weights=counts, minlength=len(found)).astype("<u8")
        ends = np.cumsum([len(x) for x in highs])
        answers = [_packed(x) for x in np.split(totals[place], ends[:-1])]
        types = [int((totals > 0).sum())] + [0] * (len(answers) - 1)
        return pa.table(
            {
                "bucket": table.column("bucket"), "n": table.column("n"), "block": table.column("block"),
                "answer": pa.array(answers, pa.binary()), "types": pa.array(types, pa.int64()),
            }
        )

    return requests.groupBy("bucket", "n").applyInArrow(run, "bucket int, n int, block long, answer binary, types long")


def context_classes(contexts: list[np.ndarray]) -> np.ndarray:
    """Class of every token by the count of its longest context seen, from the longest on."""
    out, first = np.zeros(len(contexts[0]), np.int64), 1
    width = (CONTEXTS - 1) // len(contexts)
    for count in contexts:
        own = (out == 0) & (count > 0)
        out[own] = first + np.minimum(np.log2(count[own]).astype(np.int64), width - 1)
        first += width
    return out


def estimates(counts: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """Maximum-likelihood estimates, one column per order, 0 where the context is new."""
    return np.column_stack([np.where(d > 0, c / np.maximum(d, 1), 0.0) for c, d in zip(counts, contexts)])


def _level(p: np.ndarray) -> np.ndarray:
    """0 for 0, else by powers of two."""
    return np.where(p > 0, 1 + np.minimum(np.round(-np.log2(np.maximum(p, 1e-30))), LEVELS - 2), 0).astype(np.int64)


def learned_weights(cells: np.ndarray, numbers: np.ndarray, order: int, uniform: float, rounds: int) -> np.ndarray:
    """Mixture weights per context class: highest order first, the uniform distribution last.

    ``cells`` are numbers in base ``LEVELS`` of the estimates' levels, with the
    class above, ``numbers`` how many tokens have them.
    """
    weights = np.full((CONTEXTS, order + 1), 1 / (order + 1))
    p, rest = np.zeros((len(cells), order + 1)), cells.copy()
    for column in reversed(range(order)):
        level = rest % LEVELS
        p[:, column] = np.where(level > 0, 0.5 ** (level - 1.0), 0)
        rest //= LEVELS
    p[:, order] = uniform
    for _ in range(rounds):
        share = weights[rest] * p
        share *= (numbers / share.sum(1))[:, None]
        total = np.stack([np.bincount(rest, share[:, i], CONTEXTS) for i in range(order + 1)], 1)
        seen = total.sum(1) > 0
        weights[seen] = total[seen] / total[seen].sum(1, keepdims=True)
    # A small floor keeps every probability above zero.
    weights = np.maximum(weights, 1e-6)
    return weights / weights.sum(1, keepdims=True)


def interpolated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Tokens are words in lower case (A to Z) and one end per text; a null text
    is empty, so its end is its only token. Texts whose crc32(id) modulo
    ``folds`` is ``held_out`` are scored but teach nothing; a null id teaches.
    ``base_score`` is the add-one unigram log10 probability, ``score`` that of the
    mixture. Repeated rows teach and are scored each time. An empty table gives
    an empty result. N-grams are told apart by 40 bits and those of their
    bucket (64 at most), so the chance of a mix-up stays near one in a million
    for each however large the input.
    """
    held = F.coalesce(fold(docs[id_col].cast("long"), s.folds) == s.held_out, F.lit(False))
    given = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), held.alias("held"))
    blocks = stored(_blocks(given), "blocks")
    size = blocks.agg(F.sum("tokens").alias("tokens"), F.sum("train").alias("train")).first()
    trained, bits = size.train or 0, 0
    while (1 << bits) * BUCKET_KEYS < (size.tokens or 0) and bits < 24:
        bits += 1
    replies = stored(_replies(_requests(blocks, s.order, bits)), "replies")
    types = replies.where("n = 1").agg(F.sum("types")).first()[0] or 0
    order = s.order

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's texts with the counts of their n-grams, and the cells that the fit needs."""
        row = left.to_pylist()[0]
        block, answers = Tokens(row), {}
        for n, bucket, answer in sorted(
            zip(*(right.column(c).to_pylist() for c in ("n", "bucket", "answer"))), key=lambda x: x[:2]
        ):
            answers.setdefault(n, []).append(_unpacked(answer))
        counts = [np.concatenate(answers[n])[_keys(block.grams(n), bits)[1]] for n in range(1, order + 1)]
        # Training tokens as predicted from all others.
        train = np.repeat(~block.held, block.lengths)
        begun = int(right.column("begun")[0].as_py())
        contexts = _contexts(counts, block.first, begun, trained)
        found = []
        for at in range(0, len(train), TOKENS_AT_ONCE):
            part = slice(at, at + TOKENS_AT_ONCE)
            own = train[part]
            deleted = [c[part][own] - 1 for c in counts[::-1]], [c[part][own] - 1 for c in contexts]
            cells = context_classes(deleted[1][:-1] or deleted[1])
            for p in estimates(*deleted).T:
                cells = cells * LEVELS + _level(p)
            found.append(np.unique(cells, return_counts=True))
        cells, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        numbers = np.bincount(place, np.concatenate([n for _, n in found]), len(cells)).astype(np.int64)
        return pa.table(
            {
                "ids": pa.array([row["ids"]], pa.list_(pa.int64())),
                "held": pa.array([row["held"]], pa.list_(pa.bool_())),
                "lengths": pa.array([row["lengths"]], pa.binary()),
                "counts": pa.array([[_packed(c) for c in counts]], pa.list_(pa.binary())),
                "cells": pa.array([[{"cell": c, "n": n} for c, n in zip(cells.tolist(), numbers.tolist())]],
                                  pa.list_(pa.struct([("cell", pa.int64()), ("n", pa.int64())]))),
            }
        )

    begun = blocks.select(F.explode("held").alias("h")).where("not h").count()  # training texts
    answered = replies.select("block", "n", "bucket", "answer", F.lit(begun).cast("long").alias("begun"))
    known = stored(
        blocks.select("block", "ids", "held", "lengths", "words", "codes")
        .groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(
            counted,
            "ids array<long>, held array<boolean>, lengths binary, counts array<binary>, "
            "cells array<struct<cell: long, n: long>>",
        ),
        "counts",
    )
    cells = known.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).collect()
    weights = learned_weights(
        np.array([c.cell for c in cells], np.int64), np.array([c.n for c in cells], float), order, 1 / (types + 1), s.rounds
    )

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                lengths = _unpacked(row["lengths"])
                counts = [_unpacked(c) for c in row["counts"]]
                first = np.cumsum(lengths) - lengths
                contexts = _contexts(counts, first, begun, trained)
                scores = np.empty(len(counts[0]))
                for at in range(0, len(scores), TOKENS_AT_ONCE):
                    own = slice(at, at + TOKENS_AT_ONCE)
                    seen = [c[own] for c in contexts]
                    p = estimates([c[own] for c in counts[::-1]], seen)
                    w = weights[context_classes(seen[:-1] or seen)]
                    scores[own] = np.log10((w[:, :order] * p).sum(1) + w[:, order] / (types + 1))
                base = np.log10((counts[0] + 1) / (trained + 1 * (types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(lengths),
                        pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), first)),
                        pa.array(np.full(len(lengths), trained)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(scores, first)),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return known.select("ids", "held", "lengths", "counts").mapInArrow(
        score,
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _contexts(counts: list[np.ndarray], first: np.ndarray, begun: int, trained: int) -> list[np.ndarray]:
    """How often the context of each token was seen, longest first, the empty context last.

    A context is the n-gram one shorter that ends at the token before; at the
    beginning of a text it is the beginning, seen once per training text.
    """
    out = []
    for c in counts[:-1]:
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[first] = begun
        out.append(before)
    return out[::-1] + [np.full(len(counts[0]), trained, np.int64)]

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rulesieve.llm import language_model as lm
from tests.llm.conftest import plain


def brute(rows, order):
    """Counts and base score by the definition."""
    out, grams = {}, [Counter() for _ in range(order)]
    texts = {(i, t): (t or "").encode().lower().split() + ["end"] for i, t, *_ in rows}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    begun = 0
    for i, t, *_ in rows:
        if not held(i):
            begun += 1
            w = ["begin"] * (order - 1) + texts[(i, t)]
            for n in range(order):
                grams[n].update(tuple(w[j - n : j + 1]) for j in range(order - 1, len(w)))
    trained, types = sum(grams[0].values()), len(grams[0])
    for (i, t), w in texts.items():
        base = sum(math.log10((grams[0][(x,)] + 1) / (trained + types + 1)) for x in w)
        out[(i, t)] = (held(i), len(w), sum(grams[0][(x,)] > 0 for x in w), trained, base)
    return out, grams, texts, begun, trained, types


@pytest.mark.parametrize("order", [1, 2, 3])
def test_counts_and_base(docs, rows, order, monkeypatch):
    """Small blocks and buckets, so that counts come from many of both."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "BUCKET_KEYS", 400)
    want = brute(rows, order)[0]
    found = lm.interpolated(docs, s=lm.Settings(order=order)).collect()
    assert len(found) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t)
    for r in found:
        got = (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], pytest.approx(r["base_score"], rel=1e-9))
        assert any(want[(r["id"], t)] == got for t in texts[r["id"]])
        assert r["score"] < 0


def test_score_is_the_mixture(docs, rows, monkeypatch):
    """With given weights the score is what the counts say."""
    order = 3
    weights = np.tile([0.4, 0.3, 0.2, 0.1], (lm.CONTEXTS, 1))
    monkeypatch.setattr(lm, "learned_weights", lambda *a: weights)
    _, grams, texts, begun, trained, types = brute(rows, order)
    found = {(r["id"], r["n_tokens"], round(r["score"], 6)) for r in lm.interpolated(docs).collect()}
    for (i, t), own in texts.items():
        w, total = ["begin"] * (order - 1) + own, 0.0
        for j in range(order - 1, len(w)):
            p = 0.1 / (types + 1)
            for share, n in ((0.2, 1), (0.3, 2), (0.4, 3)):
                context = w[j - n + 1 : j]
                seen = trained if n == 1 else begun if context[-1] == "begin" else grams[n - 2][tuple(context)]
                p += share * grams[n - 1][tuple(w[j - n + 1 : j + 1])] / seen if seen else 0
            total += math.log10(p)
        assert any(a == i and b == len(own) and abs(c - total) < 1e-5 for a, b, c in found)


def test_weights_maximise_the_likelihood():
    """One class, two estimates: the best mixture is found."""
    cells = np.array([2 * lm.LEVELS + 4, 5 * lm.LEVELS + 2])  # (1/2, 1/8) and (1/16, 1/2)
    numbers = np.array([30.0, 10.0])
    w = lm.learned_weights(cells, numbers, 2, 1e-9, 500)[0]
    loss = lambda a: -(30 * np.log(a / 2 + (1 - a) / 8) + 10 * np.log(a / 16 + (1 - a) / 2))
    best = min(np.linspace(0.001, 0.999, 999), key=loss)
    assert w[0] == pytest.approx(best, abs=0.01) and w.sum() == pytest.approx(1)


def unrounded_weights(counts, words, total, uniform, rounds):
    """Expectation maximisation of unigram and uniform on the deleted estimates as they are."""
    p, w = np.column_stack([(counts - 1) / (total - 1), np.full(len(counts), uniform)]), np.array([0.5, 0.5])
    for _ in range(rounds):
        share = w * p
        share *= (counts * words / share.sum(1))[:, None]
        w = share.sum(0) / share.sum()
    return w


@pytest.mark.parametrize("total", [10**5, 10**7, 5 * 10**9])
def test_weights_do_not_depend_on_the_size_of_the_corpus(total):
    """Counts of a large corpus, by Zipf: the rounded fit learns about what the unrounded one does."""
    ranks = np.unique(np.geomspace(1, total / 20, 4_000).astype(np.int64))
    words = np.diff(np.append(ranks, total // 20)).astype(float)  # words that share a count
    words = np.maximum(words, 1)
    counts = np.maximum(np.round(total / 22 / ranks), 1)
    total, uniform = float((counts * words).sum()), 1 / (words.sum() + 1)
    want = unrounded_weights(counts, words, total, uniform, 40)
    level = lm._level((counts - 1) / (total - 1))
    got = lm.learned_weights(level, counts * words, 1, uniform, 40)[0]
    assert got[1] == pytest.approx(want[1], rel=0.15)  # powers of two


def test_mixture_beats_the_base_on_held_out(spark):
    import random

    rng = random.Random(0)
    follow = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}

    def text():
        at, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"w{at}")
            at = rng.choice(follow[at])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    rows = [r for r in lm.interpolated(df).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.6 * sum(r["base_score"] for r in rows)


def test_empty_table_and_extra_columns(docs, no_docs, clashing):
    assert lm.interpolated(no_docs).collect() == []
    assert plain(lm.interpolated(clashing(docs)).drop("score")) == plain(lm.interpolated(docs).drop("score"))

import random
import zlib

import numpy as np
import pytest

from rulesieve.llm import quality as ql, toxicity as tx
from tests.llm.conftest import plain, words

LABELS = "doc_id long, quality int, toxic int"
BOTH = pytest.mark.parametrize("score, label", [(tx.toxicity, "toxic"), (ql.quality, "quality")])


@pytest.fixture(scope="module")
def labelled(spark):
    """Plain prose, some with bad words (toxic) or of junk words (no quality)."""
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        text = words(rng, rng.randint(20, 200)).split()
        toxic, junk = i % 5 == 0, i % 4 == 1
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(["Mudface,", "dolt", "GROTTY"])
        if junk:
            half = len(text) // 2
            text[half:] = [t + "###" for t in text[half:]]
        texts.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (10_000, 0, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels[:600]}


@BOTH
def test_held_out_accuracy(labelled, score, label):
    docs, labels, truth = labelled
    rows = score(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]][label == "toxic"] for r in own)
    assert len(own) > 100 and right >= 0.97 * len(own)
    assert all(0 <= r["score"] <= 1 for r in rows)


@BOTH
def test_awkward_rows(docs, no_docs, labelled, clashing, score, label):
    labels = labelled[1]
    found = score(docs, labels).collect()
    assert len(found) == docs.count()
    by_text = {}
    for r in found:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]  # ids and sources play no part
    assert all(r["held_out"] is False for r in found if r["doc_id"] is None)
    assert score(no_docs, labels).collect() == []
    extra = clashing(docs).withColumn("score", docs["n_chars"])  # replaced
    assert plain(score(extra, labels).select("doc_id", "text", "score")) == plain(score(docs, labels).select("doc_id", "text", "score"))


@BOTH
def test_nothing_to_learn_from(spark, docs, score, label):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in score(docs, none).select("score").collect()} == {0.5}


@BOTH
def test_held_out_labels_and_other_columns_teach_nothing(labelled, score, label):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled
    other = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col(label)).otherwise(F.col(label)))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    assert plain(score(docs, labels).select("doc_id", "score")) == plain(score(changed, other).select("doc_id", "score"))


def test_ftrl_against_plain_steps():
    s = tx.Settings(alpha=0.7, beta=1.0, l1=0.5, l2=0.2)
    model, z, n = tx.Ftrl(4, s), [0.0] * 4, [0.0] * 4
    rng = random.Random(2)
    for _ in range(50):
        at, y = sorted(rng.sample(range(4), 2)), rng.randint(0, 1)
        w = [0.0 if abs(z[i]) <= s.l1 else -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2) for i in range(4)]
        p = 1 / (1 + np.exp(-sum(w[i] for i in at)))
        for i in at:
            g = p - y
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
            n[i] += g * g
        model.learn(np.array(at), y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(3)
    text = words(rng, 3_000).encode()
    names = np.unique(tx.features_of(tx.WordHashes().of(tx.words_of(text))))[::50]
    scorer = tx.Scorer(names, np.linspace(-1, 1, len(names)), 0.1)
    whole = scorer(text)
    monkeypatch.setattr(tx, "WORDS_AT_ONCE", 11)
    assert scorer(text) == whole
    bags = ql.passages(text, ql.WordHashes(), 64)
    monkeypatch.setattr(ql, "WORDS_AT_ONCE", 130)
    assert np.allclose(ql.passages(text, ql.WordHashes(), 64), bags) and len(bags) == -(-3_000 // 64)


def test_gradients_of_gated_attention():
    rng = np.random.default_rng(0)
    s = ql.Settings(encoding=5, attention=3)
    net = ql.GatedAttention(s, np.zeros(ql.FEATURES), np.ones(ql.FEATURES))
    x, first, y = rng.normal(size=(9, ql.FEATURES)), np.array([0, 2, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(x, first)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in net.gradients(x, first, y).items():
        at = tuple(rng.integers(0, d) for d in net.w[name].shape)
        net.w[name][at] += 1e-6
        up = loss()
        net.w[name][at] -= 2e-6
        down = loss()
        net.w[name][at] += 1e-6
        assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)

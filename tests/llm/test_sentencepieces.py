import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rulesieve.llm import sentencepieces as sp
from tests.llm.conftest import plain

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def transducer():
    return sp.Transducer(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinrstABC .,;!?#*|\n\t▁éñß²日本0129'\"​😀\0")), max_size=40))
def test_equals_the_library(transducer, library, text):
    data = transducer.encode(text)
    assert ids(data) == library.encode(text)
    assert transducer.decode(data) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(transducer, library, text):
    assert ids(transducer.encode(text)) == library.encode(text)


def test_long_runs(transducer, library, rows):
    for text in ["a" * 3_000, "the" * 500, " " * 100, "\n" * 50, "x. " * 400] + [t for _, t, *_ in rows if t]:
        assert ids(transducer.encode(text)) == library.encode(text)


def test_caches_may_empty(monkeypatch, transducer, library):
    monkeypatch.setattr(sp, "_RUNS_KEPT", 2)
    monkeypatch.setattr(sp, "_PAIRS_KEPT", 3)
    fresh = sp.Transducer(MODEL)
    text = "some words and more words, and numbers 123 456"
    assert fresh.encode(text) == transducer.encode(text)


def test_columns(docs, no_docs, clashing):
    def both(df):
        coded = df.select("doc_id", "text", sp.encoded(F.col("text"), MODEL).alias("ids"))
        return coded.withColumn("back", sp.decoded(F.col("ids"), MODEL))

    assert all(r["back"] == (r["text"] or "") for r in both(docs).collect())
    assert both(no_docs).collect() == [] and plain(both(clashing(docs))) == plain(both(docs))


def test_foreign_ids_decode(spark, transducer):
    df = spark.createDataFrame([(1, bytearray(np.array([1, 0, 3 + 0xFF, 2], "<i4").tobytes())), (2, None)], "i long, ids binary")
    found = {r["i"]: r["t"] for r in df.select("i", sp.decoded(F.col("ids"), MODEL).alias("t")).collect()}
    assert found == {1: "�", 2: None}

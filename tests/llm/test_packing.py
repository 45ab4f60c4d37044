import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rulesieve.llm import packing as pk
from rulesieve.llm.common import id_text

PATHS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATHS[0])


@pytest.fixture(scope="module")
def runs():
    return pk.RunIds(*PATHS)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'sé.1,日 ​\x1c\x85😀²")), max_size=30))
def test_runs_give_the_whole_encoding(tokenizer, runs, text):
    assert np.frombuffer(runs.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [16, 1024])
def test_every_id_lies_in_one_place(docs, rows, tokenizer, window):
    found = pk.assign_sequences(pk.token_pieces(id_text(docs), *PATHS, window), window).collect()
    got = sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in found if r["start"] == 0 and r["length"] == r["doc_tokens"])
    want = [ids_of(tokenizer, t) for _, t, *_ in rows]
    assert got == sorted(w for w in want if len(w) <= window)
    assert sum(r["length"] for r in found) == sum(map(len, want))
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window


def test_fill_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        capacity = rng.randint(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums |= {s + k * length for s in sums for k in range(n + 1)}
        used = pk.fill(counts, capacity)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= capacity)
        assert all(n <= counts[x] for x, n in used.items())


def test_compositions_use_every_piece():
    rng = random.Random(4)
    counts = {rng.randint(1, 1024): rng.randint(1, 500) for _ in range(300)}
    left, total, windows = dict(counts), 0, 0
    for used, times in pk.compositions(counts, 1024):
        assert sum(x * n for x, n in used.items()) <= 1024
        for x, n in used.items():
            left[x] -= n * times
        windows += times
    total, long = sum(x * n for x, n in counts.items()), sum(n for x, n in counts.items() if x > 512)
    assert not any(left.values()) and windows <= max(-(-total // 1024), long) * 1.03


def test_ranks_across_salts(docs, monkeypatch):
    monkeypatch.setattr(pk, "RANKED_TOGETHER", 5)
    found = pk.assign_sequences(pk.token_pieces(id_text(docs), *PATHS, 16), 16)
    assert found.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0


def test_empty_table_and_extra_columns(docs, no_docs, clashing):
    assert pk.assign_sequences(pk.token_pieces(id_text(no_docs), *PATHS)).collect() == []
    pieces = pk.token_pieces(id_text(clashing(docs)), *PATHS).withColumn("other", F.lit("x"))
    assert pk.assign_sequences(pieces).columns[-3:] == ["other", "sequence_id", "offset"]

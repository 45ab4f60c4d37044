"""Literals found in whole batches, against a look for each in each text."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rulesieve.functions import occurrences
from rulesieve.functions.occurrences import literal_finder


def expected(literals, texts):
    return [(i, j) for i, t in enumerate(texts) for j, w in enumerate(literals) if t is not None and w in t]


def found(literals, texts):
    rows, which = literal_finder(literals)(pa.array(texts, pa.string()))
    return list(zip(rows.tolist(), which.tolist()))


words = st.lists(st.text("abé\0", min_size=1, max_size=40), min_size=1, max_size=25, unique=True)


@given(words, st.lists(st.none() | st.text("abé\0", max_size=90), max_size=12))
@settings(max_examples=400, deadline=None)
def test_equals_a_look_for_each(literals, texts):
    assert found(literals, texts) == expected(literals, texts)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunks_and_slices(monkeypatch, chunk):
    monkeypatch.setattr(occurrences, "_CHUNK_BYTES", chunk)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    literals = sorted({word(n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 23, 24, 33)})
    texts = [word(rng.randint(0, 70)) for _ in range(40)] + [None, "", literals[-1], literals[-1] * 3]
    assert found(literals, texts) == expected(literals, texts)
    rows, which = literal_finder(literals)(pa.array([*texts, "a"]).slice(3, 20))
    assert list(zip(rows.tolist(), which.tolist())) == expected(literals, texts[3:23])
    assert len(literal_finder(literals)(pa.array([], pa.string()))[0]) == 0


def test_literals_do_not_run_over_the_ends_of_texts():
    assert found(["ab", "abcdefgh", "\0"], ["a", "b", "abcd", "efgh", "\0"]) == [(2, 0), (4, 2)]


def test_shared_pieces_and_nested_literals():
    literals = ["prefix-shared-" + str(i) for i in range(300)] + ["prefix", "shared", "e"]
    texts = ["x prefix-shared-17 y", "prefix-shared-2999", "nothing"]
    assert found(literals, texts) == expected(literals, texts)


def test_thousands_of_literals_in_one_pass():
    """The work grows with the text, not with literals times rows."""
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, row)) for row in rng.integers(97, 123, (4_000, 250))]
    few, many = ([t[:20] for t in texts[:n]] for n in (50, 4_000))
    spent = []
    for literals in (few, many):
        find, column = literal_finder(sorted(set(literals))), pa.array(texts)
        find(column)
        start = time.process_time()
        rows, _ = find(column)
        spent.append(time.process_time() - start)
        assert len(set(rows.tolist())) == len(literals)
    assert spent[1] < 12 * spent[0]

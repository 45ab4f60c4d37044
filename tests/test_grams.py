"""Byte pieces: what a text yields must cover every pattern it contains."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulesieve.functions import grams as g


def pieces(texts, sizes=g.SIZES, largest_only=False, known=None):
    found = g._cutter(tuple(sizes), largest_only, known)(pa.array(texts, pa.string()))
    return [{(e["size"], e["piece"]) for e in row} for row in found.to_pylist()]


def brute(text, size):
    raw = text.encode()
    return {
        (size, int(np.frombuffer(raw[i : i + size].ljust(8, b"\0"), np.int64)[0])) for i in range(len(raw) - size + 1)
    }


def test_all_pieces_of_all_sizes():
    texts = ["", "a", "ab", "abcabc", "naïve été", None, "0123456789abcdef" * 3]
    got = pieces(texts)
    for text, found in zip(texts, got):
        assert found == set().union(*[brute(text or "", s) for s in g.SIZES])


def test_pattern_uses_the_largest_size_that_fits():
    texts = ["a", "ab", "abc", "abcd", "abcdefg", "abcdefgh", "é", "abcdefghij"]
    sizes = [{s for s, _ in found} for found in pieces(texts, largest_only=True)]
    assert sizes == [{1}, {2}, {2}, {4}, {4}, {8}, {2}, {8}]


def test_slices_and_chunks(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    want = pieces(texts)
    sliced = g._cutter(g.SIZES, False, None)(pa.array(texts, pa.string()).slice(50, 100))
    assert [{(e["size"], e["piece"]) for e in row} for row in sliced.to_pylist()] == want[50:150]
    monkeypatch.setattr(g, "_CHUNK_BYTES", 16)
    assert pieces(texts) == want


@pytest.mark.parametrize("bits", [16, 20])
def test_bitmap_keeps_all_known_and_drops_most_others(spark, bits):
    rng = random.Random(bits)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    patterns = [word(rng.randint(1, 20)) for _ in range(50)]
    known = spark.createDataFrame([(p,) for p in patterns], "p string").select(
        F.inline(g.pattern_pieces(F.col("p")))
    )
    bitmap = g.piece_bitmap(known, bits)
    assert len(bitmap) == 2**bits // 8
    own = set().union(*pieces(patterns, largest_only=True))
    texts = [word(60) + p + word(60) for p in patterns]
    for text, kept in zip(texts, pieces(texts, known=(bits, bitmap))):
        everything = set().union(*[brute(text, s) for s in g.SIZES])
        assert everything & own <= kept <= everything
    strange = ["".join(rng.choice("XYZ0123456789") for _ in range(400)) for _ in range(20)]
    assert sum(map(len, pieces(strange, known=(bits, bitmap)))) < sum(map(len, pieces(strange))) / 10


def test_bitmap_size_is_bounded():
    assert [g.bitmap_bits(n) for n in (0, 1, 1000, 10**6, 10**12)] == [16, 16, 16, 26, 27]

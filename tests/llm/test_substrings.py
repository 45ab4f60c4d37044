import hashlib

import pytest

from rulesieve.llm import substrings as ss
from tests.llm.conftest import plain


def brute(rows, window=13):
    """(id, text) -> (n_words, covered words) by the definition."""
    first = {}
    split = {(i, t): (t or "").encode().split() for i, t, *_ in rows}
    for (i, _), w in split.items():
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = {}
    for (i, t), w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[(i, t)] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("window, gram, bits", [(13, 5, 1 << 27), (13, 13, 1 << 15), (5, 1, 1 << 27)])
def test_against_brute_force(docs, rows, monkeypatch, window, gram, bits):
    monkeypatch.setattr(ss, "MAX_BITMAP_BITS", bits)
    want = brute(rows, window)
    found = ss.without_repeats(docs, window=window, gram=gram).select("doc_id", "text", "cut.*").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[(r["doc_id"], r["text"])]
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_same_id_with_other_texts(spark):
    p, q = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(20))
    rows = [(1, p), (2, q), (5, p + " tail"), (5, "x " + q), (5, p + " tail")]
    found = ss.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["cut"]["kept"]) for r in found) == [(1, p), (2, q), (5, "tail"), (5, "tail"), (5, "x")]


def test_a_full_bitmap_changes_nothing(docs, monkeypatch):
    want = plain(ss.without_repeats(docs))
    monkeypatch.setattr(ss.Bitmap, "has", lambda self, numbers: numbers == numbers)
    assert plain(ss.without_repeats(docs)) == want


def test_empty_table_and_extra_columns(docs, no_docs, clashing):
    assert ss.without_repeats(no_docs).collect() == []
    extra = clashing(docs)
    found = ss.without_repeats(extra)
    assert found.columns == [*extra.columns, "cut"]
    assert plain(found.select(*docs.columns, "cut")) == plain(ss.without_repeats(docs))


def test_bitmap_has_its_members(spark):
    numbers = [0, 1, 32767, 32768, -1, -(2**63), 2**63 - 1, 5 << 40]
    bitmap = ss.Bitmap(spark.createDataFrame([(n,) for n in numbers], "n long"))
    import numpy as np

    assert bitmap.has(np.array(numbers)).all() and bitmap.has(np.arange(100_000)).sum() < 50


def test_digest_is_of_what_is_kept(docs, rows):
    from rulesieve.llm.queries import F

    found = ss.without_repeats(docs).select("doc_id", "text", F.sha2("cut.kept", 256).alias("s")).collect()
    want = brute(rows)
    assert all(r["s"] == hashlib.sha256(want[(r["doc_id"], r["text"])][2].encode()).hexdigest() for r in found)

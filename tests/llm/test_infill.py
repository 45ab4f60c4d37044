"""Fill-in-middle: cuts at exact ranks, and the text back from every output."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulesieve.llm import infill
from tests.llm.conftest import DOCS, plain


def expected(doc_id, text, seed=1):
    """By slicing alone."""
    text = text or ""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    start, end = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:start], text[start:end], text[end:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", start, end - start, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", start, end - start, f"<P>{p}<S>{s}<M>{m}"


def tuples(df):
    return sorted(map(repr, ((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect())))


def more(rows):
    marked = ["a <P> b", "<S>", "x<M", "<P", "P>", "S>M>", "<<S", ">" * 30, "<S <M <P" * 9, "é" * 17, "😀é‍" * 50]
    return rows + [(2000 + i, t, None, None, None) for i, t in enumerate(marked * 12)]


def test_equals_slicing_and_comes_back(spark, rows):
    docs = spark.createDataFrame(more(rows), DOCS).repartition(3)
    found = infill.infilled(docs)
    assert tuples(found) == sorted(map(repr, (expected(r[0], r[1]) for r in more(rows))))
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    back = found.select("id", infill.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((r[0], r[1] or "")) for r in more(rows))


@pytest.mark.parametrize("unit", [r"\S+", r"[^\n]*\n", r"\b", r"(?s).{7}"])
def test_other_units(spark, docs, unit):
    found = infill.infilled(docs, unit=unit, seed=3, plain_from=100, suffix_first_below=50)
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    for r in found.withColumn("text", infill.restored(F.col("output"), F.col("form"))).collect():
        assert (r.id, r.text) in texts
        if r.form != "plain":
            ends = np.cumsum(infill.unit_widths(r.text, re.compile(unit)))
            assert r.n == len(ends) and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {0, *ends.tolist()}


def test_skip_list_places():
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 4097):
        widths = np.array([rng.randint(1, 9) for _ in range(n)], np.int64)
        units, ends = infill.SkipList(widths), [0, *np.cumsum(widths).tolist()]
        assert [units.place(r) for r in range(n + 1)] == ends
        assert len(units.lanes) <= 1 + max(1, n).bit_length() // 4


def test_empty_table_and_clashing_names(docs, no_docs, clashing):
    assert infill.infilled(no_docs).count() == 0
    assert plain(infill.infilled(clashing(docs))) == plain(infill.infilled(docs))

"""License scans against a plain version over all windows."""

import random
import re
from math import ceil

from rulesieve.llm import licenses
from tests.llm.conftest import DOCS, plain

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, threshold=0.8):
    out = []
    for row in rows:
        w, starts, base, labels, score = words(row[1]), [], set(), set(), 0.0
        for phrase, label in phrases:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        for label, text in templates:
            t = words(text)
            if not t:
                continue
            need = ceil(threshold * len(set(t)) - 1e-9)
            window = next(1 << k for k in range(20) if 1 << k >= 2 * len(t))
            for start in range(0, max(1, len(w)), window // 2):
                if start and start + window // 2 >= len(w):
                    break
                held = len(set(t) & set(w[start : start + window]))
                if held >= need:
                    labels.add(label)
                    score = max(score, held / len(set(t)))
        out.append((row[0], len(w), sorted(starts), sorted(base), sorted(base | labels), 1.0 if base else score))
    return sorted(map(repr, out))


def listed(df):
    columns = ("n_words", "starts", "base_labels", "labels", "score")
    return sorted(repr((r.doc_id, *(r.license[c] for c in columns))) for r in df.collect())


def planted(rng):
    """Whole and damaged notices, alone, in long texts and at the borders of windows."""
    filler = [f"w{i}" for i in range(50)] + ["the", "of", "license", "is", "under", "this"]
    for label, text in licenses.TEMPLATES:
        for kept in (1.0, 0.9, 0.82, 0.78, 0.5):
            body = text.split()
            gone = set(rng.sample(range(len(body)), round(len(body) * (1 - kept))))
            body = [w for i, w in enumerate(body) if i not in gone]
            before = [rng.choice(filler) for _ in range(rng.choice([0, 7, 90, 700]))]
            yield " ".join([*before, *body, *(rng.choice(filler) for _ in range(rng.choice([0, 300])))])


SHORT = ["Under the MIT License!", "under the mit licenses", "UNDER-THE-MIT-LICENSE under the mit license", "CC BY-NC 4.0 cc_by_nc",
         "Apache License, Version 2.0", "apache license version 20", "Kcc by ncİ", "cc cc by nc by nc", "éunder the mit license", "by"]
ODD = ["".join(map(chr, range(0x180))), " , ", "-mit", "mit-", "\u212aelvin \u0130 Éa", "a\U0001f600b \u2028c\u00a0d", "\ud7ff\ue000 x"]


def test_equals_brute_force(spark, rows):
    more = rows + [(500 + i, t, None, None, None) for i, t in enumerate([*SHORT, *planted(random.Random(7))])]
    docs = spark.createDataFrame(more, DOCS).repartition(3)
    found = licenses.license_labels(docs)
    assert listed(found) == expected(more)
    labels = {label for r in found.collect() for label in r.license.labels}
    assert labels == {p[1] for p in licenses.PHRASES} | {t[0] for t in licenses.TEMPLATES}


def test_blocks_hold_what_they_say(spark):
    text = licenses.TEMPLATES[0][1]
    docs = spark.createDataFrame([(1, text, None, None, None), (1, "other " * 40 + text, None, None, None)] * 2, DOCS)
    blocks = licenses.license_blocks(docs).collect()
    assert {b.label for b in blocks} == {"gpl-3"} and all(b.containment == 1.0 for b in blocks)
    assert len({(b.h1, b.h2) for b in blocks}) == 2 and len(blocks) == len(set(blocks))


def test_other_templates(spark, rows):
    phrases = (("a a", "twice"), ("b", "one"))
    templates = (("x", "one two three"), ("none", " . "), ("a", "a b"))
    more = rows + [(900, "a a a b", None, None, None), (901, "", None, None, None)]
    docs = spark.createDataFrame(more, DOCS)
    found = licenses.license_labels(docs, phrases, templates, 0.6)
    assert listed(found) == expected(more, phrases, templates, 0.6)


def test_empty_table_and_clashing_names(docs, no_docs, clashing):
    assert licenses.license_labels(no_docs).count() == 0
    wide = licenses.license_labels(clashing(docs).withColumnRenamed("lang", "license").withColumnRenamed("source", "words"))
    assert {"_id", "id", "h1", "words", "license"} <= set(wide.columns)
    assert plain(wide.select("doc_id", "license")) == plain(licenses.license_labels(docs).select("doc_id", "license"))


def test_no_python_in_the_plan(docs):
    plan = licenses.license_labels(docs)._jdf.queryExecution().toString()
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|CartesianProduct|NestedLoop", plan)


def test_texts_are_cut_twice_and_nothing_is_extracted(spark, rows, monkeypatch):
    """Once for the blocks, once for the phrases, and the order of words comes from the blocks."""
    cut, made = licenses.words_of, []
    monkeypatch.setattr(licenses, "words_of", lambda text: made.append(1) or cut(text))
    more = rows + [(500 + i, t, None, None, None) for i, t in enumerate([*SHORT, *planted(random.Random(8)), *ODD])]
    found = licenses.license_labels(spark.createDataFrame(more, DOCS))
    assert len(made) == 2
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    assert listed(found) == expected(more)

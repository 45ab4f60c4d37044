import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rulesieve.llm import simhash as sh
from tests.llm.conftest import plain


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, threshold=4):
    """Brute force over (id, fingerprint)."""
    ids = [i for i, _ in prints]
    group = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= threshold and group[b] > group[a]:
                    group[b], changed = group[a], True
    return group


def test_against_brute_force(docs, rows):
    found = sh.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    unsigned = lambda x: x % (1 << 64)
    want = {(i, t): fingerprint(t) for i, t, *_ in rows}
    assert sorted(unsigned(r["fp"]) for r in found) == sorted(want[(i, t)] for i, t, *_ in rows)
    groups = components([(i, f) for (i, _), f in want.items() if i is not None])
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == groups
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_is_lost(spark, seed):
    """Fingerprints around few centres, some pairs at exactly the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-(2**63), 2**63 - 1, 6)
    prints = set(centres.tolist()) | {0, -1}
    for c in centres.tolist():
        for _ in range(40):
            flips = rng.choice(64, rng.integers(1, 9), replace=False)
            prints.add(int(np.int64(c) ^ np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64)).view(np.int64)))
    prints = sorted(prints)
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    got = {tuple(sorted((r["u"], r["v"]))) for r in sh.links(nodes).collect()}
    want = {
        (a, b)
        for a in range(len(prints))
        for b in range(a)
        if ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 4
    }
    assert got == {tuple(sorted(p)) for p in want} and len(want) > 50


def test_codes_cover_their_segments():
    for segment in sh.SEGMENTS:
        flips = segment.flips()
        assert all(own and own[0].bit_count() <= segment.radius for own in flips)
        if segment.checks:
            assert sum(map(len, flips)) / len(flips) == pytest.approx(18.8, abs=0.1)
    with pytest.raises(ValueError):
        sh.Segment(0, 24, sh.hamming_checks(4), 0, 1).flips()
    with pytest.raises(ValueError):
        sh.links(None, threshold=5)


@pytest.mark.parametrize("search", [sh.links, sh.home_links])
def test_copies_are_not_broadcast(spark, search):
    """Spark sizes exploded copies like their nodes, so a table under its bound for broadcasts would not fit the driver."""
    nodes = spark.range(2_000).select("id", F.xxhash64("id").alias("fp"))
    pairs = search(nodes.groupBy("fp").agg(F.min("id").alias("node")))
    for _ in ("before", "after it ran"):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        pairs.collect()


def test_empty_table_and_extra_columns(docs, no_docs, clashing):
    assert sh.near_duplicates(no_docs).collect() == []
    assert plain(sh.near_duplicates(clashing(docs))) == plain(sh.near_duplicates(docs))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    words = [str(i % 97).encode() for i in range(1000)]
    whole = sh.simhash(words, 4, 42)
    monkeypatch.setattr(sh, "SHINGLES_AT_ONCE", 7)
    assert sh.simhash(words, 4, 42) == whole == np.uint64(fingerprint(" ".join(map(bytes.decode, words)))).view(np.int64)

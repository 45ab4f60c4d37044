import random

import pytest

from rulesieve.operators import budgets as b

SCHEMA = "artifact_id string, container_ord long, uncompressed_size long"


@pytest.fixture
def containers(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def kept(df):
    return sorted((r["artifact_id"], r["container_ord"]) for r in df.collect())


def test_byte_budget(containers):
    rows = containers([("a", 0, 50), ("a", 1, 40), ("a", 2, 50), ("a", 3, 1), ("b", 0, 100), ("c", 0, 101)])
    assert kept(b.within_bytes(rows, 100)) == [("a", 0), ("a", 1), ("b", 0)]
    outcomes = {r["artifact_id"]: r["outcome"] for r in b.outcome(b.apply_budget(rows, 100, 10), 100, 10).collect()}
    assert outcomes == {"a": "partial", "b": "ok", "c": "partial"}


def test_huge_sizes_do_not_overflow(containers):
    rows = containers([("a", 0, 2**63 - 1), ("a", 1, 2**63 - 1), ("b", 0, None), ("b", 1, 7)])
    assert kept(b.within_bytes(rows, 100)) == [("b", 0), ("b", 1)]


def test_count_cap_is_never_partial(containers):
    rows = containers([("a", i, 1) for i in range(3)])
    capped = b.apply_budget(rows, 100, 2)
    assert kept(capped) == [("a", 0), ("a", 1)]
    row = b.outcome(capped, 100, 2).collect()[0]
    assert (row["outcome"], row["outcome_reason"], row["at_count_cap"]) == ("ok", None, True)


def test_no_budget_keeps_everything(containers):
    rows = containers([("a", i, 2**62) for i in range(20)])
    free = b.apply_budget(rows, None, None)
    assert free.where("kept").count() == 20
    assert b.outcome(free, None, None).collect()[0]["outcome"] == "ok"


def test_containers_after_the_cap_are_not_charged(containers):
    rows = containers([("a", 0, 60), ("a", 1, 40), ("a", 2, 60)])
    assert b.outcome(b.apply_budget(rows, 100, 2), 100, 2).collect()[0]["outcome"] == "ok"


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_ranges_give_the_plain_running_sum(containers, width):
    rng = random.Random(width)
    rows = [(a, o, rng.randint(0, 9)) for a in "ab" for o in rng.sample(range(200), 60)]
    want = []
    for a in "ab":
        total = 0
        for _, o, size in sorted(r for r in rows if r[0] == a):
            total += size
            if total <= 120:
                want.append((a, o))
    assert kept(b.within_bytes(containers(rows), 120, width=width)) == sorted(want)
    assert kept(b.apply_budget(containers(rows), 120, None).where("kept")) == sorted(want)


@pytest.mark.parametrize("n", [1, 19, 20, 999, 1000, 1001, None])
def test_one_result_for_every_count(containers, n):
    """Null keys, null positions and repeated rows stay, whatever the count."""
    rows = [(a, o, 1) for a in "ab" for o in range(0, 90, 3)] + [("a", None, 1), (None, 4, 1), (None, None, 1)]
    rows += [("b", 3, 1)] * 3
    ordered = sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0))
    groups = {a: [r[:2] for r in ordered if r[0] == a] for a in ("a", "b", None)}
    want = sorted((k for own in groups.values() for k in own[:n]), key=str)

    def listed(df):
        return sorted(((r["artifact_id"], r["container_ord"]) for r in df.collect()), key=str)

    for width in (10, 65_536):
        assert listed(b.apply_budget(containers(rows), None, n, width=width)) == want
        assert listed(b.apply_budget(containers(rows), 10**9, n, width=width).where("kept")) == want
        if n is not None:
            assert listed(b.first_n(containers(rows), n, width=width)) == want


def test_ranges_of_ranges(containers):
    rows = [("a", o, 2) for o in range(40)]
    assert kept(b.within_bytes(containers(rows), 31, width=2)) == [("a", o) for o in range(15)]


def test_a_limit_must_be_named(containers):
    rows = containers([("a", 0, 1)])
    for call in (b.first_n, b.within_bytes, b.apply_budget, b.outcome):
        with pytest.raises(TypeError):
            call(rows)


def test_artifacts_without_containers_are_ok(spark, containers):
    rows = b.apply_budget(containers([("a", 0, 101)]), 100, None)
    spine = spark.createDataFrame([("a",), ("z",), (None,)], "artifact_id string")
    found = {r["artifact_id"]: (r["outcome"], r["n_containers"], r["at_count_cap"]) for r in b.outcome(rows, 100, None, spine).collect()}
    assert found == {"a": ("partial", 1, False), "z": ("ok", 0, False), None: ("ok", 0, False)}


def test_unreadable_containers_are_charged_and_passed_over(spark):
    rows = spark.createDataFrame(
        [("a", 0, 60, "bad header"), ("a", 1, 60, None), ("b", 0, 1, "cut"), ("b", 1, 1, "bad"), ("c", 0, 1, "x"), ("c", 1, 1, None)],
        SCHEMA + ", error string",
    )
    found = {r["artifact_id"]: (r["outcome"], r["outcome_reason"]) for r in b.outcome(b.apply_budget(rows, 100, None), 100, None, error="error").collect()}
    assert found["a"] == ("failed", "none of 1 containers could be read: bad header")
    assert found["b"] == ("failed", "none of 2 containers could be read: bad")
    assert found["c"] == ("ok", None)

"""As-of and overlap joins against loops."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st

from rulesieve.operators.intervals import as_of, overlapping

L, R = "k string, at int, id int", "k string, at int, v int, w string"


def expected_as_of(left, right):
    out = []
    for k, at, i in left:
        known = [(a, v if v is not None else -1e9, w or "", v, w) for rk, a, v, w in right if k is not None and rk == k and a is not None and at is not None and a <= at]
        best = max(known, key=lambda r: r[:3]) if known else (None,) * 5
        out.append((k, at, i, best[3], best[4]))
    return sorted(map(repr, out))


def rows(df, *columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def some(rng, n, side):
    keys = ["hot"] * 6 + ["a", "b", None]
    out = [(rng.choice(keys), rng.choice([None, *range(40)]), i) for i in range(n)]
    return out if side == "left" else [(k, at, rng.choice([None, i % 7]), rng.choice([None, "x", "y"])) for k, at, i in out]


@pytest.mark.parametrize("range_rows", [1, 4, 25, 50_000])
def test_as_of_equals_a_loop_whatever_the_ranges(spark, range_rows):
    rng = random.Random(range_rows)
    left, right = some(rng, 120, "left"), some(rng, 90, "right")
    left += left[:5]
    found = as_of(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "at", ["k"], range_rows=range_rows)
    assert rows(found, "k", "at", "id", "right_v", "right_w") == expected_as_of(left, right)


def test_as_of_with_times_and_several_keys(spark):
    day = datetime(2024, 3, 31)
    left = spark.createDataFrame([("a", 1, day + timedelta(hours=h)) for h in range(6)], "k string, n int, t timestamp_ntz")
    right = spark.createDataFrame([("a", 1, day + timedelta(hours=h, seconds=1), h) for h in (1, 3)] + [("a", 2, day, 9)], "k string, n int, t timestamp_ntz, v int")
    for kind in ("timestamp_ntz", "timestamp", "date"):
        both = [df.withColumn("t", df["t"].cast(kind)) for df in (left, right)]
        found = as_of(*both, "t", ["k", "n"], range_rows=2).orderBy("t").collect()
        if kind != "date":
            assert [r.right_v for r in found] == [None, None, 1, 1, 3, 3]
        else:
            assert [r.right_v for r in found] == [3] * 6


def test_as_of_empty_sides_and_names(spark):
    left, right = spark.createDataFrame([("a", 1, 2)], L), spark.createDataFrame([("a", 1, 5, "x")], R)
    assert as_of(left.where("false"), right, "at", ["k"]).count() == 0
    assert [r.right_v for r in as_of(left, right.where("false"), "at", ["k"]).collect()] == [None]
    clash = left.withColumnRenamed("id", "_range")
    assert as_of(clash, right.withColumnRenamed("v", "_at"), "at", ["k"]).first().asDict() == dict(k="a", at=1, _range=2, right__at=5, right_w="x")
    assert as_of(left, right, "at", ["k"], values=["w"]).columns == ["k", "at", "id", "right_w"]
    with pytest.raises(ValueError):
        as_of(left, right, "at", [])


def test_as_of_splits_a_hot_key(spark):
    """Ranges of a key are partitions of their own, and nothing loops over pairs."""
    left = spark.range(5_000).selectExpr("'hot' as k", "cast(id * id as int) as at", "cast(id as int) as id")
    right = spark.range(3_000).selectExpr("'hot' as k", "cast(id * 7 as int) as at", "cast(id as int) as v", "'' as w")
    found = as_of(left, right, "at", ["k"], range_rows=500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "_range" in plan.split("Window", 1)[1]
    assert all(r.right_v == min(r.at // 7, 2_999) for r in found.collect())


def expected_overlaps(left, right):
    out = []
    for k1, s1, e1, i in left:
        for k2, s2, e2, j in right:
            if None not in (k1, k2, s1, e1, s2, e2) and k1 == k2 and max(s1, s2) < min(e1, e2):
                out.append((k1, i, j))
    return sorted(map(repr, out))


I = "k string, start long, end long, id int"  # noqa: E741
ranges = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.integers(-300, 300), st.none() | st.integers(-20, 400)), max_size=25
)


@given(ranges, ranges)
@settings(max_examples=12, deadline=None)
def test_overlaps_equal_a_loop(spark, left, right):
    left, right = ([(k, s, None if s is None or n is None else s + n, i) for i, (k, s, n) in enumerate(side)] for side in (left, right))
    found = overlapping(spark.createDataFrame(left, I), spark.createDataFrame(right, I), by=["k"])
    assert rows(found, "k", "left_id", "right_id") == expected_overlaps(left, right)


def test_overlaps_of_all_lengths_and_repeated_rows(spark):
    rng = random.Random(9)
    side = lambda n: [("a", s, s + 4 ** rng.randint(0, 20) + rng.randint(0, 3), i) for i in range(n) for s in [rng.randint(-(10**6), 10**12)]]
    left, right = side(80), side(80)
    left += [*left[:3], ("a", -(2**60), 2**60, 999)]
    found = overlapping(spark.createDataFrame(left, I), spark.createDataFrame(right, I), by=["k"])
    assert rows(found, "k", "left_id", "right_id") == expected_overlaps(left, right)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    free = overlapping(spark.createDataFrame(left, I), spark.createDataFrame(right, I).where("false"))
    assert free.count() == 0 and "left_k" in free.columns


def test_short_ranges_do_not_meet_because_of_a_long_one(spark):
    """Candidates stay near the pairs found, however long one range is."""
    short = [("a", 10 * i, 10 * i + 5, i) for i in range(2_000)]
    left = spark.createDataFrame([*short, ("a", 0, 10**9, -1)], I)
    right = spark.createDataFrame([("a", 10 * i + 3, 10 * i + 8, i) for i in range(2_000)], I)
    found = overlapping(left, right, by=["k"])
    assert found.count() == 4_000

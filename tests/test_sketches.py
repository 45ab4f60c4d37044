"""Sketches that merge in any order, and a cube in one shuffle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rulesieve.operators import sketches as sk
from rulesieve.operators.report import findings_cube

ROWS = "scan int, rule string, artifact long, size double"


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(3)
    hot = [(rng.randint(0, 5), "hot", rng.randint(0, 9_000), round(math.exp(rng.gauss(5, 2)), 2)) for _ in range(12_000)]
    few = [(1, "few", 7, 0.0), (1, "few", 7, 4.0), (2, "few", 8, 4.0), (2, "few", None, None), (3, "none", None, None)]
    bad = [(3, "bad", 1, -1.0), (3, "bad", 1, float("nan")), (3, "bad", 1, float("inf"))]
    return hot + few + bad


def test_distinct_counts_merge_to_those_of_all_rows(spark, found):
    df = spark.createDataFrame(found, ROWS)
    kept = sk.distinct_sketches(df, ["scan", "rule"], "artifact")
    merged = {r.rule: r.estimate for r in sk.distinct_estimates(sk.merge_distinct(kept, ["rule"])).collect()}
    again = kept.orderBy(F.desc("scan")).repartition(5)
    assert merged == {r.rule: r.estimate for r in sk.distinct_estimates(sk.merge_distinct(again, ["rule"])).collect()}
    exact = len({a for _, r, a, _ in found if r == "hot"})
    assert abs(merged["hot"] - exact) <= sk.distinct_error() * exact
    assert (merged["few"], merged["none"], merged["bad"]) == (2, 0, 1)


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_quantiles_are_within_their_error(spark, found, accuracy):
    df, shares = spark.createDataFrame(found, ROWS), [0.0, 0.01, 0.5, 0.9, 1.0]
    kept = sk.amount_bins(df, ["scan", "rule"], F.col("size"), accuracy)
    bins = sk.merge_bins(kept, ["rule"])
    assert sorted(map(str, bins.collect())) == sorted(map(str, sk.amount_bins(df, ["rule"], F.col("size"), accuracy).collect()))
    got = {r.rule: r.quantiles for r in sk.quantiles(bins, ["rule"], shares, accuracy).collect()}
    assert set(got) == {"hot", "few"}  # no other rule has an amount
    for rule, values in got.items():
        sizes = sorted(s for _, r, _, s in found if r == rule and s is not None)
        for share, value in zip(shares, values):
            exact = sizes[max(math.ceil(share * len(sizes)), 1) - 1]
            assert abs(value - exact) <= (accuracy + 1e-9) * exact
    assert got["few"][0] == 0.0
    with pytest.raises(ValueError):
        sk.amount_bins(df, ["rule"], F.col("size"), 1.5)


def test_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert sk.merge_distinct(sk.distinct_sketches(none, ["scan", "rule"], "artifact"), ["rule"]).count() == 0
    assert sk.quantiles(sk.amount_bins(none, ["rule"], F.col("size")), ["rule"], [0.5]).count() == 0


FINDINGS = "source string, category string, severity string, behavior string"


def test_cube_equals_a_loop_in_one_shuffle(spark):
    rng = random.Random(9)
    rows = [
        (rng.choice(["a", "a", "b", None]), rng.choice(["x", "y"]), rng.choice(["low", "high", "critical"]), rng.choice(["unknown", "hard_block", None]))
        for _ in range(200)
    ]
    df = findings_cube(spark.createDataFrame(rows, FINDINGS).repartition(4), ["source", "category"])
    expected = {}
    for source, category, *_ in rows:
        for level in range(4):
            at = (None if level & 2 else source, None if level & 1 else category, level)
            expected[at] = expected.get(at, 0) + 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = df.collect()
    assert {(r.source, r.category, r.level): r.n_findings for r in found} == expected and len(found) == len(expected)
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" in plan
    total = next(r for r in found if r.level == 3)
    assert total.highest_severity == "critical" and total.n_blocking <= total.n_findings == 200
    assert findings_cube(spark.createDataFrame([], FINDINGS), ["source", "category"]).count() == 0

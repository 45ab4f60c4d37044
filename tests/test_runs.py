"""Runs over the scan history against a loop, and the split of a rule that fires in all scans."""

import random

import pytest

from rulesieve.operators.runs import firing_history, firing_runs

S, F_ = "artifact_id string, scan long", "artifact_id string, scan long, rule_id string"


def expected(scans, findings):
    out, per_key = [], {}
    for k, s in scans:
        if k is not None and s is not None:
            per_key.setdefault(k, set()).add(s)
    fired = {}
    for k, s, r in findings:
        if None not in (k, s, r) and s in per_key.get(k, ()):
            fired.setdefault((k, r), set()).add(s)
    for (k, r), on in fired.items():
        order, run = sorted(per_key[k]), []
        for s in [*order, None]:
            if s in on:
                run.append(s)
            elif run:
                out.append((k, r, run[0], run[-1], len(run), run[-1] == order[-1]))
                run = []
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("width", [1, 2, 5, 7, 65_536])
def test_equals_a_loop_whatever_the_ranges(spark, width):
    rng = random.Random(width)
    scans = [(k, 3 * i + rng.randint(0, 2)) for k in ("hot", "cold", "none") for i in range(60 if k == "hot" else 9)]
    findings = [(k, s, r) for k, s in scans for r, p in (("always", 1), ("mostly", 0.9), ("seldom", 0.2)) if k != "none" and rng.random() < p]
    findings += findings[:9] + [("hot", 10_000, "always"), (None, 3, "always"), ("hot", None, "x"), ("hot", scans[0][1], None), ("new", 1, "x")]
    scans += scans[:5] + [(None, 1), ("hot", None)]
    found = firing_runs(spark.createDataFrame(scans, S).repartition(3), spark.createDataFrame(findings, F_), width=width)
    assert rows(found) == expected(scans, findings)


def test_history_adds_runs_up(spark):
    scans = [("a", i) for i in range(10)]
    findings = [("a", i, "r") for i in (0, 1, 2, 5, 7, 8)] + [("a", 9, "late")]
    found = firing_history(firing_runs(spark.createDataFrame(scans, S), spark.createDataFrame(findings, F_), width=4))
    assert rows(found) == [("a", "late", 9, 9, 1, 0, 1, True), ("a", "r", 0, 8, 6, 2, 3, False)]


def test_empty_tables(spark):
    none, no_scans = spark.createDataFrame([], F_), spark.createDataFrame([], S)
    some = spark.createDataFrame([("a", 1, "r")], F_)
    assert firing_runs(spark.createDataFrame([("a", 1)], S), none).count() == 0
    assert firing_runs(no_scans, some).count() == 0
    assert firing_history(firing_runs(no_scans, none)).count() == 0


def test_several_keys_of_other_names(spark):
    scans = spark.createDataFrame([(1, "x", i) for i in range(4)], "team int, app string, at int")
    findings = scans.where("at <> 2").selectExpr("*", "'r' as id")
    found = firing_runs(scans, findings, ["team", "app"], "at", "id", width=2)
    assert rows(found) == [(1, "x", "r", 0, 1, 2, False), (1, "x", "r", 3, 3, 1, True)]

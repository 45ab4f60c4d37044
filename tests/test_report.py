import pytest

from rulesieve.operators import diff as d, report as rp
from rulesieve.sources.catalogue import local_table
from rulesieve import schema

ALL = [(b, s) for b, s in zip(schema.BEHAVIORS, ("critical", "high", "medium", "low", "info"))]


def counts(df):
    return {r["artifact_id"]: (r["total"], r["kept"], r["hidden"]) for r in df.collect()}


def test_blocking_filter_and_its_counts(make_findings, artifacts):
    found = make_findings(
        *[("five", f"r{i}", "root", s, b) for i, (b, s) in enumerate(ALL)],
        ("hidden", "r3", "root", "low", "log_only"),
        ("hidden", "r4", "root", "low", "unknown"),
        ("kills", "r0", "root", "low", "process_kill"),
        ("kills", "r1", "root", "low", "process_kill"),
    )
    spine = artifacts("five", "hidden", "kills", "none")
    assert counts(rp.blocking_counts(spine, found)) == {
        "five": (5, 3, 2), "hidden": (2, 0, 2), "kills": (2, 2, 0), "none": (0, 0, 0),
    }
    assert rp.blocking_only(found).count() == 5
    assert found.count() == 9


def test_behavior_decides_not_severity(make_findings):
    found = make_findings(("a", "x", "root", "low", "hard_block"), ("a", "y", "root", "critical", "log_only"))
    assert [r["rule_id"] for r in rp.blocking_only(found).collect()] == ["x"]
    assert [r["rule_id"] for r in rp.min_severity(found).collect()] == ["y"]
    assert rp.min_severity(found, "low").count() == 2


def test_category_rollup(make_findings):
    found = make_findings(
        ("a", "x", "app_defense", "low", "unknown"),
        ("a", "y", "root", "medium", "unknown"),
        ("a", "z", "root", "critical", "unknown"),
        ("a", "w", "root", "info", "unknown"),
        ("b", "x", "app_defense", "info", "unknown"),
    )
    rows = rp.category_rollup(found).orderBy("artifact_id", "category_rank").collect()
    assert [tuple(r)[:4] for r in rows] == [
        ("a", "root", 3, "critical"), ("a", "app_defense", 1, "low"), ("b", "app_defense", 1, "info"),
    ]


def test_report_order(make_findings):
    found = make_findings(
        ("a", "b-low", "root", "low", "unknown"),
        ("a", "z-high", "root", "high", "unknown"),
        ("a", "a-high", "root", "high", "unknown"),
        ("a", "last", "app_defense", "critical", "unknown"),
        ("a", "mid", "anti_hooking", "info", "unknown"),
    )
    rows = rp.order_findings(found).orderBy("position").collect()
    assert [r["rule_id"] for r in rows] == ["a-high", "z-high", "b-low", "mid", "last"]


def test_summary_keeps_artifacts_without_anything(spark, make_findings, make_rules, artifacts):
    entries = spark.createDataFrame([("a", 5), ("a", 7)], "artifact_id string, uncompressed_size long")
    found = make_findings(("a", "x", "root", "low", "unknown"))
    rules = make_rules(("x", ["x"]), ("y", ["y"]))
    rows = rp.artifact_summary(artifacts("a", "b"), entries, found, rules).orderBy("artifact_id").collect()
    assert [tuple(r) for r in rows] == [("a", 12, 1, 2), ("b", 0, 0, 2)]


def test_guidance_is_optional(spark, make_findings, make_rules):
    found = make_findings(("a", "x", "root", "low", "unknown"), ("a", "y", "root", "low", "unknown"))
    found = found.withColumn("guidance_key", found["rule_id"])
    guidance = spark.createDataFrame([("x", "do this")], "guidance_key string, guidance string")
    rows = rp.with_guidance(found, make_rules(("x", ["p"]), ("y", ["q"])), guidance).collect()
    assert {r["rule_id"]: (r["description"], r["guidance"]) for r in rows} == {
        "x": ("about x", "do this"), "y": ("about y", None),
    }


def test_prevalence(make_findings, make_rules, artifacts):
    found = make_findings(
        ("a", "x", "root", "low", "unknown"), ("a", "x", "root", "low", "unknown"), ("b", "x", "root", "low", "unknown")
    )
    rows = rp.prevalence(found, artifacts("a", "b", "c", "d"), make_rules(("x", ["p"]), ("y", ["q"]))).collect()
    assert {r["rule_id"]: (r["n_artifacts"], r["share"]) for r in rows} == {"x": (2, 0.5), "y": (0, 0.0)}


# --- diff --------------------------------------------------------------------


@pytest.fixture
def versions(make_findings):
    old = make_findings(
        ("a", "gone", "root", "low", "unknown", "old gone"),
        ("a", "same", "root", "low", "unknown", "old same"),
        ("a", "moved", "root", "low", "unknown", "old place"),
    )
    new = make_findings(
        ("a", "same", "root", "high", "hard_block", "new same"),
        ("a", "fresh", "app_defense", "low", "unknown", "new fresh"),
        ("a", "moved", "anti_tamper", "low", "unknown", "new place"),
    )
    return old, new


def test_diff_by_rule_and_category(versions):
    rows = d.order_diff(d.diff(*versions)).collect()
    assert [(r["status"], r["rule_id"], r["category"], r["evidence"]) for r in rows] == [
        ("added", "moved", "anti_tamper", "new place"),
        ("added", "fresh", "app_defense", "new fresh"),
        ("removed", "gone", "root", "old gone"),
        ("removed", "moved", "root", "old place"),
        ("unchanged", "same", "root", "new same"),
    ]


def test_diff_counts_include_zeros(versions):
    old, _ = versions
    row = d.diff_counts(d.diff(old, old)).collect()[0]
    assert (row["n_added"], row["n_removed"], row["n_unchanged"]) == (0, 0, 3)
    empty = old.where("false")
    assert tuple(d.diff_counts(d.diff(empty, empty)).collect()[0]) == (0, 0, 0)


def test_last_of_repeated_keys_wins(spark):
    struct = schema._struct(("artifact_id", schema._S), ("rule_id", schema._S), ("category", schema._S),
                            ("evidence", schema._S), ("seq", schema._L))
    rows = [("a", "x", "root", "first", 1), ("a", "x", "root", "last", 3), ("a", "x", "root", "mid", 2)]
    table = local_table(spark, [dict(zip(struct.names, r)) for r in rows], struct)
    assert [r["evidence"] for r in d.latest_by_key(table).collect()] == ["last"]
    changes = d.diff(table, table, seq="seq").collect()
    assert [(r["status"], r["evidence"]) for r in changes] == [("unchanged", "last")]


def test_diff_is_one_shuffle(versions):
    plan = d.diff(*versions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan

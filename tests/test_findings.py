from rulesieve import schema
from rulesieve.operators import budgets
from rulesieve.operators.findings import (
    cap_evidence,
    cap_first_pattern,
    clean_artifacts,
    first_pattern_hits,
    scan,
    scan_report,
    to_findings,
)
from rulesieve.operators.matching import match_contains, match_longest


def evidence_of(df):
    return {(r["artifact_id"], r["rule_id"]): r["evidence"] for r in df.collect()}


def test_cap_keeps_scan_order_and_repeats(make_rules, strings):
    rules = make_rules(("A", ["su"]))
    found = scan(strings("su 1", "none", "su 1", "su 3", "su 4", "su 5"), rules)
    assert evidence_of(found) == {("a", "A"): "DEX string match: `su 1`, `su 1`, `su 3`"}


def test_value_with_two_patterns_counts_twice(make_rules, strings):
    found = scan(strings("one two", "two"), make_rules(("A", ["one", "two"])))
    assert evidence_of(found) == {("a", "A"): "DEX string match: `one two`, `one two`, `two`"}


def test_pattern_listed_twice_counts_twice(make_rules, strings):
    found = scan(strings("x"), make_rules(("A", ["x", "x"])))
    assert evidence_of(found) == {("a", "A"): "DEX string match: `x`, `x`"}


def test_containers_come_in_their_order(make_rules, make_evidence):
    evidence = make_evidence(
        ("a", "dex_string", "classes2.dex", 1, 0, "x second"),
        ("a", "dex_string", "classes.dex", 0, 5, "x first"),
        ("b", "dex_string", "classes.dex", 0, 0, "x other"),
    )
    assert evidence_of(scan(evidence, make_rules(("A", ["x"])))) == {
        ("a", "A"): "DEX string match: `x first`, `x second`",
        ("b", "A"): "DEX string match: `x other`",
    }


def test_labels_per_kind(make_rules, make_evidence):
    rules = make_rules(
        ("N", ["missing", "hook"], dict(evidence_location="native_lib_name")),
        ("Z", ["assets/", "x"], dict(evidence_location="zip_entry")),
        ("M", ["a=1 tag", "debug"], dict(evidence_location="manifest")),
        ("Y", ["sym"], dict(evidence_location="native_symbol")),
    )
    evidence = make_evidence(
        ("a", "native_lib_name", "arm64", 0, 0, "libhook.so"),
        ("a", "native_lib_name", "x86", 1, 0, "libhook.so"),
        ("a", "zip_entry", "n", 0, 0, "x.txt"),
        ("a", "zip_entry", "n", 1, 0, "assets/1"),
        ("a", "zip_entry", "n", 2, 0, "assets/2x"),
        ("a", "zip_entry", "n", 3, 0, "assets/3"),
        ("a", "zip_entry", "n", 4, 0, "assets/4"),
        ("a", "manifest", "m", 0, 0, "el a=1 tag debug=true "),
        ("a", "native_symbol", "s", 0, 0, "my_sym"),
    )
    assert evidence_of(scan(evidence, rules)) == {
        ("a", "N"): "Native lib: lib/arm64/libhook.so, lib/x86/libhook.so",
        ("a", "Z"): "ZIP entry: assets/1, assets/2x, assets/3",
        ("a", "M"): "Manifest match: `a=1 tag`",
        ("a", "Y"): "Native symbol: my_sym",
    }


def test_first_pattern_wins_for_names(make_rules, make_evidence):
    rules = make_rules(("Z", ["late", "early"], dict(evidence_location="zip_entry")))
    evidence = make_evidence(
        ("a", "zip_entry", "n", 0, 0, "early 0"),
        ("a", "zip_entry", "n", 1, 0, "late 1"),
        ("a", "zip_entry", "n", 2, 0, "late 2"),
        ("b", "zip_entry", "n", 0, 0, "early b"),
    )
    matches = match_contains(evidence, rules)
    kept = sorted((r["artifact_id"], r["value"]) for r in first_pattern_hits(matches).collect())
    assert kept == [("a", "late 1"), ("a", "late 2"), ("b", "early b")]
    capped = sorted((r["artifact_id"], r["value"]) for r in cap_first_pattern(matches, 1).collect())
    assert capped == [("a", "late 1"), ("b", "early b")]


def test_finding_carries_rule_attributes(make_rules, strings):
    rules = make_rules(("A", ["x"], dict(severity="high", behavior=None, guidance_key="g")))
    row = to_findings(cap_evidence(match_longest(strings("x"), rules)), rules).collect()[0]
    assert row.asDict() == dict(
        artifact_id="a", rule_id="A", rule_name="rule A", category="root", severity="high",
        behavior="unknown", evidence="DEX string match: `x`", guidance_key="g",
    )
    assert list(row.asDict()) == schema.FINDING.names


def test_regex_and_literal_rules_in_one_scan(make_rules, strings):
    rules = make_rules(("L", ["key"]), ("R", ["k.y"], dict(is_regex=True)))
    assert evidence_of(scan(strings("kay", "key"), rules)) == {
        ("a", "L"): "DEX string match: `key`",
        ("a", "R"): "DEX string match: `kay`, `key`",
    }


def test_clean_artifacts(make_rules, strings, artifacts):
    found = scan(strings("x"), make_rules(("A", ["x"])))
    assert [r[0] for r in clean_artifacts(artifacts("a", "b"), found).collect()] == ["b"]


def test_cap_none_keeps_all(make_rules, strings):
    matches = match_longest(strings(*["x"] * 9), make_rules(("A", ["x"])))
    assert cap_evidence(matches, None).count() == 9 and cap_first_pattern(matches, None).count() == 9


def test_first_pattern_reads_the_evidence_once(make_rules, make_evidence):
    rows = make_evidence(*[("a", "zip_entry", "c", 0, i, v) for i, v in enumerate(["q p", "q", "p"])])
    found = first_pattern_hits(match_contains(rows, make_rules(("A", ["p", "q"], dict(evidence_location="zip_entry")))))
    assert sorted((r["ordinal"], r["pattern"]) for r in found.collect()) == [(0, "p"), (2, "p")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("LocalTableScan") <= 2 and plan.count("ArrowEvalPython") == 1 and plan.count("WindowGroupLimit") == 2


def test_scan_searches_only_containers_within_the_budget(spark, make_rules, make_evidence):
    rules = make_rules(("A", ["x"]), ("Z", ["z"], dict(evidence_location="zip_entry")))
    evidence = make_evidence(
        ("a", "dex_string", "c0", 0, 0, "none"), ("a", "dex_string", "c1", 1, 0, "x"), ("a", "zip_entry", "z", 7, 0, "z"),
        ("b", "dex_string", "c0", 0, 0, "x"), ("b", "dex_string", "c1", 1, 0, "x"),
    )
    containers = spark.createDataFrame(
        [("a", 0, 60, None), ("a", 1, 60, None), ("b", 0, 10, "bad"), ("b", 1, 10, None)],
        "artifact_id string, container_ord long, uncompressed_size long, error string",
    )
    kept = budgets.apply_budget(containers, 100, None)
    found = scan(evidence, rules, containers=kept, error="error")
    assert sorted((r["artifact_id"], r["rule_id"]) for r in found.collect()) == [("a", "Z"), ("b", "A")]
    spine = spark.createDataFrame([("a",), ("b",), ("none",)], "artifact_id string")
    report = scan_report(budgets.outcome(kept, 100, None, spine, "error"), found).collect()
    assert {r["artifact_id"]: (r["outcome"], r["n_findings"], r["rule_ids"]) for r in report} == {
        "a": ("partial", 1, ["Z"]), "b": ("ok", 1, ["A"]), "none": ("ok", 0, []),
    }

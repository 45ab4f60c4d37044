import json

import pytest
from pyspark.sql import functions as F

from rulesieve import schema
from rulesieve.operators import policy as p
from rulesieve.sources.catalogue import local_table

FIELDS = ["rooted", "hidden", "emulator"]


@pytest.fixture
def conditions(spark):
    def make(*rows):
        full = [dict(rule_id=r, row_no=n, fields=list(f.items()), verdict=v, detail=f"row {n}") for r, n, f, v in rows]
        return local_table(spark, full, schema.CONDITION)

    return make


@pytest.fixture
def profiles(spark):
    def make(**rows):
        struct = schema._struct(("profile_id", schema._S), *[(f, schema._B) for f in FIELDS])
        full = [dict(profile_id=k, **{f: v.get(f) for f in FIELDS}) for k, v in rows.items()]
        return p.profile_map(local_table(spark, full, struct), FIELDS)

    return make


@pytest.fixture
def pairs(spark):
    struct = schema._struct(("artifact_id", schema._S), ("profile_id", schema._S))
    return lambda *rows: local_table(spark, [dict(zip(struct.names, r)) for r in rows], struct)


TWO_FIELDS = [
    ("su", 1, {"rooted": False}, "not_triggered"),
    ("su", 2, {"rooted": True, "hidden": True}, "not_triggered"),
    ("su", 3, {"rooted": True, "hidden": False}, "triggered"),
]


def verdicts(df):
    return {(r["profile_id"], r["rule_id"]): r["verdict"] for r in df.collect()}


def test_first_matching_row_wins_and_null_is_unknown(make_findings, conditions, profiles, pairs):
    cases = dict(
        clean=dict(rooted=False), masked=dict(rooted=True, hidden=True), open=dict(rooted=True, hidden=False),
        half=dict(rooted=True), only_hidden=dict(hidden=True), nothing={},
    )
    found = p.evaluate(
        make_findings(("a", "su", "root", "low", "hard_block")), pairs(*[("a", c) for c in cases]),
        profiles(**cases), conditions(*TWO_FIELDS),
    )
    assert verdicts(found) == {
        ("clean", "su"): "not_triggered", ("masked", "su"): "not_triggered", ("open", "su"): "triggered",
        ("half", "su"): "unknown", ("only_hidden", "su"): "unknown", ("nothing", "su"): "unknown",
    }


def test_wildcards_order_and_unmapped_rules(make_findings, conditions, profiles, pairs):
    table = conditions(
        ("any", 2, {"rooted": True}, "triggered"), ("any", 1, {"emulator": True}, "not_triggered"),
        ("always", 1, {}, "triggered"),
    )
    findings = make_findings(
        *[("a", r, "root", "low", "hard_block") for r in ("any", "always", "unmapped")]
    )
    found = p.evaluate(findings, pairs(("a", "x")), profiles(x=dict(rooted=True, emulator=True)), table)
    rows = {r["rule_id"]: (r["verdict"], r["detail"]) for r in found.collect()}
    assert rows == {
        "any": ("not_triggered", "row 1"), "always": ("triggered", "row 1"),
        "unmapped": ("unknown", "no conditions for this rule"),
    }


def test_six_checks_on_one_field(make_findings, conditions, profiles, pairs):
    findings = make_findings(*[("a", f"c{i}", "anti_emulator", "low", "hard_block") for i in range(6)])
    table = conditions(*[(f"c{i}", 1, {"emulator": True}, "triggered") for i in range(6)])
    done = p.evaluate_pairs(findings, pairs(("a", "emu")), profiles(emu=dict(emulator=True)), table)
    assert tuple(p.verdict_counts(done).collect()[0])[2:] == (6, 0, 0, 6)


def test_overall_outcome(make_findings, conditions, profiles, pairs):
    table = conditions(*TWO_FIELDS, ("emu", 1, {"emulator": True}, "triggered"), ("emu", 2, {"emulator": False}, "not_triggered"))
    findings = make_findings(
        ("a", "su", "root", "low", "hard_block"), ("a", "emu", "anti_emulator", "low", "soft_block"),
        ("log", "su", "root", "low", "log_only"),
    )
    people = profiles(
        ok=dict(rooted=False, emulator=False), bad=dict(rooted=False, emulator=True), dim=dict(emulator=False)
    )
    done = p.evaluate_blocking(
        findings, pairs(("a", "ok"), ("a", "bad"), ("a", "dim"), ("log", "bad"), ("empty", "bad")), people, table
    )
    rows = {(r["artifact_id"], r["profile_id"]): r["overall"] for r in p.overall(done).collect()}
    assert rows == {
        ("a", "ok"): "pass", ("a", "bad"): "fail", ("a", "dim"): "inconclusive",
        ("log", "bad"): "no_blocking", ("empty", "bad"): "no_blocking",
    }


def test_catalogue_leaves_out_artifact_side_and_unmapped_rules(make_rules, conditions, profiles):
    rules = make_rules(
        ("su", ["x"]), ("emu", ["x"], dict(category="anti_emulator")), ("packed", ["x"], dict(category="app_hardening")),
        ("signed", ["x"], dict(category="anti_tamper")), ("unmapped", ["x"]),
    )
    table = conditions(
        *TWO_FIELDS, ("emu", 1, {"emulator": True}, "triggered"), ("packed", 1, {}, "triggered"),
        ("signed", 1, {}, "triggered"), ("dead", 1, {}, "triggered"),
    )
    people = profiles(x=dict(rooted=False), y=dict(emulator=True))
    assert verdicts(p.evaluate_catalogue(rules, people, table)) == {
        ("x", "su"): "not_triggered", ("x", "emu"): "unknown", ("y", "su"): "unknown", ("y", "emu"): "triggered",
    }


@pytest.mark.parametrize("bound", [dict(MAX_SHARED_ROWS=7), dict(MAX_SHARED_CHARS=900)])
def test_a_catalogue_in_blocks_gives_what_the_shared_one_gives(make_rules, conditions, profiles, monkeypatch, bound):
    names = [f"r{i}" for i in range(30)]
    rules = make_rules(*[(n, ["x"]) for n in names])
    table = conditions(
        *[(n, 1, {"rooted": i % 2 == 0}, "triggered") for i, n in enumerate(names)],
        *[(n, 2, {}, "not_triggered") for n in names[::3]],
        *[("r4", k, {"emulator": k % 2 == 0}, "triggered") for k in range(2, 20)],  # more rows than a block
    )
    people = profiles(x=dict(rooted=True), y=dict(rooted=False, emulator=False), z={})
    people = people.union(people.where("profile_id = 'x'"))
    listed = lambda: sorted(map(repr, p.evaluate_catalogue(rules, people, table).collect()))
    want = listed()
    assert len(want) == 4 * 30
    for name, value in bound.items():
        monkeypatch.setattr(p, name, value)
    done = p.evaluate_catalogue(rules, people, table)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan and "Cross" not in plan
    assert listed() == want
    assert p.evaluate_catalogue(rules, people.limit(0), table).count() == 0


def test_listing_order_and_document(make_findings, conditions, profiles, pairs):
    findings = make_findings(
        ("a", "u", "root", "critical", "hard_block"), ("a", "n", "root", "low", "hard_block"),
        ("a", "t2", "app_defense", "low", "hard_block"), ("a", "t1", "root", "low", "hard_block", 'say "x"\n'),
    )
    table = conditions(
        ("n", 1, {}, "not_triggered"), ("t1", 1, {}, "triggered"), ("t2", 1, {}, "triggered")
    )
    done = p.evaluate_pairs(findings, pairs(("a", "x"), ("b", "x")), profiles(x=dict(rooted=True, hidden=False)), table)
    listed = p.order_verdicts(p.verdict_rows(done)).collect()
    assert [r["rule_id"] for r in listed] == ["t1", "t2", "n", "u"]
    docs = {r["artifact_id"]: json.loads(r["document"]) for r in p.verdict_documents(done).collect()}
    assert docs["a"]["summary"] == dict(triggered=2, not_triggered=1, unknown=1, total=4)
    assert docs["a"]["profile"] == dict(rooted=True, hidden=False)
    assert [e["rule_id"] for e in docs["a"]["entries"]] == ["u", "n", "t1", "t2"]
    assert docs["a"]["entries"][2]["evidence"] == 'say "x"\n'
    assert docs["b"]["entries"] == [] and docs["b"]["summary"]["total"] == 0


def test_counts_need_no_shuffle_after_the_pairs(make_findings, conditions, profiles, pairs):
    done = p.evaluate_pairs(
        make_findings(("a", "su", "root", "low", "hard_block")), pairs(("a", "x")), profiles(x={}), conditions(*TWO_FIELDS)
    )
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles(p.overall(done)) <= shuffles(done)
    assert shuffles(p.verdict_documents(done)) <= shuffles(done)


def test_shared_and_joined_decisions_agree(make_findings, conditions, profiles, pairs, monkeypatch):
    rules = [f"c{i}" for i in range(25)]
    findings = make_findings(*[("a", r, "root", "low", "hard_block") for r in rules], ("b", "c1", "root", "low", "log_only"))
    table = conditions(*[(r, 1, {"rooted": i % 2 == 0}, "triggered") for i, r in enumerate(rules[:20])])
    some = pairs(("a", "x"), ("a", "y"), ("b", "x"), ("none", "y"), ("a", "nobody"))
    people = profiles(x=dict(rooted=True), y={})
    results = []
    for bound in (2_000, 3):
        monkeypatch.setattr(p, "MAX_SHARED_ROWS", bound)
        done = p.evaluate_pairs(findings, some, people, table)
        results.append([sorted(map(str, f(done).collect())) for f in (p.verdict_counts, p.overall, p.verdict_rows)])
        assert p.verdict_documents(done).count() == 5  # one per pair
    assert results[0] == results[1]


@pytest.mark.parametrize("bound", [2_000, 0])
def test_a_pair_without_profile_is_unknown(make_findings, conditions, profiles, pairs, monkeypatch, bound):
    monkeypatch.setattr(p, "MAX_SHARED_ROWS", bound)
    findings = make_findings(("a", "su", "root", "low", "hard_block"))
    done = p.evaluate_pairs(findings, pairs(("a", "x"), ("a", "nobody")), profiles(x=dict(rooted=True, hidden=True)), conditions(*TWO_FIELDS))
    found = {r["profile_id"]: (r["n_unknown"], r["n_total"]) for r in p.verdict_counts(done).collect()}
    assert found["nobody"] == (1, 1) and found["x"][1] == 1


def test_a_verdict_is_decided_once(make_findings, conditions, profiles, pairs):
    done = p.evaluate(
        make_findings(("a", "su", "root", "low", "hard_block")), pairs(("a", "x")), profiles(x={}), conditions(*TWO_FIELDS)
    )
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("no condition row matches this profile") == 1


# --- profile text ------------------------------------------------------------

TEXTS = {
    '{"rooted":true,"hidden":false}': (False, True, False, None),
    ' {"rooted" : true , "other": false} ': (False, True, None, None),
    '{"rooted":null}': (False, None, None, None),
    "{}": (False, None, None, None),
    "{rooted:true}": (True, None, None, None),
    '{"rooted":"x"}': (True, None, None, None),
    '{"rooted":1,"hidden":true}': (True, None, None, None),
    '{"other":5,"hidden":true}': (True, None, None, None),
    "{'rooted':true}": (True, None, None, None),
    '{"rooted":true': (True, None, None, None),
    "[true]": (True, None, None, None),
    "": (True, None, None, None),
    "true": (True, None, None, None),
}


def test_parse_profiles(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = p.parse_profiles(df, "text", FIELDS).collect()
    got = {r["text"]: (r["rejected"], *[r[f] for f in FIELDS]) for r in rows}
    assert got == TEXTS


def test_profile_round_trip_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1, True, None, False), (2, None, None, None)], "id int, rooted boolean, hidden boolean, emulator boolean")
    texts = df.select("id", p.profile_json(FIELDS).alias("text"))
    assert [r["text"] for r in texts.orderBy("id").collect()] == ['{"rooted":true,"emulator":false}', "{}"]
    back = p.parse_profiles(texts, "text", FIELDS).where(~F.col("rejected")).orderBy("id")
    assert [tuple(r[f] for f in FIELDS) for r in back.collect()] == [(True, None, False), (None, None, None)]

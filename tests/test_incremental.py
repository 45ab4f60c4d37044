"""Findings kept up over refreshes against a scan of everything."""

import random

import pytest
from pyspark.sql import functions as F

from rulesieve import schema
from rulesieve.operators.findings import scan
from rulesieve.operators.incremental import FindingStore, evidence_of, part_of, read_evidence, write_evidence
from rulesieve.session import scratch_path

WORDS = ["frida", "frida-server", "server", "magisk", "su", "root", "x", "ro.debuggable", "debug", "é"]


@pytest.fixture
def store(spark):
    return FindingStore.create(spark, scratch_path(spark, "store"))


def rows(df):
    return sorted(map(str, df.select(*schema.FINDING.names).collect()))


def state(rng, make_evidence, spark, artifacts):
    """Evidence of ``{artifact: [values]}`` and its inventory."""
    evidence = make_evidence(
        *[
            (a, kind, "c", 0, i, v)
            for a, values in artifacts.items()
            for i, (kind, v) in enumerate(values)
        ]
    )
    listed = [(a, str(values)) for a, values in artifacts.items()]
    return evidence, spark.createDataFrame(listed, "artifact_id string, fingerprint string")


def some_values(rng):
    kinds = ["dex_string", "dex_string", "manifest", "zip_entry", "native_lib_name"]
    values = [(rng.choice(kinds), " ".join(rng.choices(WORDS, k=rng.randint(0, 3)))) for _ in range(rng.randint(0, 5))]
    return values + [("dex_string", None)] * rng.randint(0, 1)


def some_rules(rng, make_rules, keep=()):
    out = []
    for name in sorted({*rng.sample("abcdefgh", 5)}):
        patterns = rng.sample(WORDS, rng.randint(1, 2))
        kind = rng.choice(["dex_string", "dex_string", "manifest", "zip_entry"])
        extra = dict(evidence_location=kind, severity=rng.choice(schema.SEVERITIES), is_regex=rng.random() < 0.3)
        out.append((name, ["^" + p if extra["is_regex"] else p for p in patterns], extra))
    return [*keep, *(r for r in out if r[0] not in {k[0] for k in keep})]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_full_scan_after_random_changes(spark, store, make_evidence, make_rules, seed):
    rng = random.Random(seed)
    artifacts = {f"a{i}": some_values(rng) for i in range(12)}
    rules = some_rules(rng, make_rules)
    for step in range(4):
        evidence, listed = state(rng, make_evidence, spark, artifacts)
        assert store.refresh(listed, evidence, make_rules(*rules)) == step + 1
        assert rows(store.findings()) == rows(scan(evidence, make_rules(*rules)))
        for name in rng.sample(sorted(artifacts), 3):
            artifacts[name] = some_values(rng)
        artifacts.pop(rng.choice(sorted(artifacts)))
        artifacts[f"b{step}"] = some_values(rng)
        rules = some_rules(rng, make_rules, keep=rng.sample(rules, len(rules) // 2)) if step % 2 else rules


def test_a_rule_that_hides_or_uncovers_another(spark, store, make_evidence, make_rules):
    evidence, listed = state(None, make_evidence, spark, {"a": [("dex_string", "frida-server")], "b": [("dex_string", "frida")]})
    short, long = ("s", ["frida"]), ("l", ["frida-server"])
    store.refresh(listed, evidence, make_rules(short))
    assert {(r.artifact_id, r.rule_id) for r in store.findings().collect()} == {("a", "s"), ("b", "s")}
    store.refresh(listed, evidence, make_rules(short, long))
    assert {(r.artifact_id, r.rule_id) for r in store.findings().collect()} == {("a", "l"), ("b", "s")}
    assert {(r.artifact_id, r.since) for r in store.snapshot().collect()} == {("a", 2), ("b", 1)}
    store.refresh(listed, evidence, make_rules(short))
    assert {(r.artifact_id, r.rule_id) for r in store.findings().collect()} == {("a", "s"), ("b", "s")}
    assert {(r.artifact_id, r.rule_id) for r in store.findings(2).collect()} == {("a", "l"), ("b", "s")}


def test_nothing_is_scanned_without_a_change(spark, store, make_evidence, make_rules):
    evidence, listed = state(None, make_evidence, spark, {"a": [("dex_string", "frida")], "b": []})
    store.refresh(listed, evidence, make_rules(("s", ["frida"])))
    store.refresh(listed.union(listed), evidence, make_rules(("s", ["frida"])))  # listed twice: another artifact
    assert {r.since for r in store.snapshot().collect()} == {2}
    store.refresh(listed.union(listed), evidence, make_rules(("s", ["frida"], dict(severity="critical", name="new"))))
    assert {r.since for r in store.snapshot().collect()} == {2}
    assert [(r.severity, r.rule_name) for r in store.findings().collect()] == [("critical", "new")]  # attributes are current


def test_empty_tables_and_missing_ids(spark, store, make_evidence, make_rules):
    evidence, listed = state(None, make_evidence, spark, {"a": [("dex_string", "frida")], None: [("dex_string", "frida")]})
    assert store.version() == 0 and store.findings().count() == 0
    store.refresh(listed, evidence, make_rules(("s", ["frida"])))
    assert [r.artifact_id for r in store.findings().collect()] == ["a"]
    store.refresh(listed.where("false"), evidence, make_rules(("s", ["frida"])))
    assert store.findings().count() == 0 and store.snapshot().count() == 0
    assert store.refresh(listed, evidence.where("false"), make_rules(("s", ["frida"])).where("false")) == 3
    assert store.findings().count() == 0


def test_a_broken_off_refresh_is_not_seen_and_can_be_repeated(spark, store, make_evidence, make_rules, monkeypatch):
    evidence, listed = state(None, make_evidence, spark, {"a": [("dex_string", "frida")]})
    store.refresh(listed, evidence, make_rules(("s", ["frida"])))
    other, listed_other = state(None, make_evidence, spark, {"a": [("dex_string", "su")]})
    with monkeypatch.context() as m:
        m.setattr(FindingStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.refresh(listed_other, other, make_rules(("s", ["frida"])))
    assert store.version() == 1 and store.findings().count() == 1
    assert store.refresh(listed_other, other, make_rules(("s", ["frida"]))) == 2
    assert store.findings().count() == 0 and store.findings(1).count() == 1


def test_folders_without_changes_are_not_read(spark, make_evidence):
    path = scratch_path(spark, "evidence")
    evidence = make_evidence(*[(f"a{i}", "dex_string", "c", 0, j, f"v{j}") for i in range(40) for j in range(3)])
    write_evidence(evidence, path, 8)
    laid_out = read_evidence(spark, path)
    todo = spark.createDataFrame([("a3",), ("a7",)], "artifact_id string")
    read = evidence_of(laid_out, todo, 8)
    assert sorted(r.artifact_id for r in read.collect()) == ["a3"] * 3 + ["a7"] * 3
    parts = {r[0] for r in todo.select(part_of(F.col("artifact_id"), 8)).collect()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and len(parts) == 2
    assert all(str(part) in plan.split("PartitionFilters: [", 1)[1].split("]")[0] for part in parts)


@pytest.mark.parametrize("few", [100_000, 0])
def test_evidence_is_not_shuffled_for_the_artifacts_to_be_scanned(spark, store, make_evidence, make_rules, monkeypatch, few):
    """Of many artifacts the matches are picked, of few the ids are broadcast; findings are the same."""
    from rulesieve.operators import incremental

    monkeypatch.setattr(incremental, "FEW", few, raising=False)
    scanned = []

    def looked_at(evidence, *more, **named):
        scanned.append(evidence._jdf.queryExecution().executedPlan().toString())
        return scan(evidence, *more, **named)

    monkeypatch.setattr(incremental, "scan", looked_at)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table over the threshold
    try:
        rules = make_rules(("a", ["frida"], {}), ("b", ["su"], {}))
        rng = random.Random(1)
        artifacts = {f"a{i}": [("dex_string", "frida su"), ("dex_string", "su")] for i in range(6)}
        for _ in range(2):
            evidence, listed = state(rng, make_evidence, spark, artifacts)
            path = scratch_path(spark, "evidence")
            write_evidence(evidence, path, 4)
            store.refresh(listed, read_evidence(spark, path), rules, parts=4)
            assert rows(store.findings()) == rows(scan(evidence, rules))
            artifacts["a1"] = [("dex_string", "x frida")]
        assert len(scanned) == 2 and not any("SortMergeJoin" in plan or "hashpartitioning" in plan for plan in scanned)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

import hashlib
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rulesieve import schema
from rulesieve.functions import text as tx
from rulesieve.operators.findings import scan
from rulesieve.plans import pack
from rulesieve.session import SCAN_PARTITIONS, NoSharedFolder, dealt, scratch_path
from rulesieve.sources import catalogue as c, files, history as h
from rulesieve.streaming.scan import evidence_stream, findings_so_far, start_match_stream

RULE = dict(id="r1", name="n", category="root", severity="low", evidence_location="dex_string", patterns=["p"], description="d")


def test_load_rules_fills_defaults(spark, tmp_path):
    path = tmp_path / "rules.json"
    lines = [RULE, {**RULE, "id": "r2", "behavior": "log_only", "is_regex": True, "bypass_hint": "key"}]
    path.write_text("\n".join(map(json.dumps, lines)))
    rows = {r["id"]: r for r in c.load_rules(spark, str(path)).collect()}
    assert (rows["r1"]["behavior"], rows["r1"]["is_regex"], rows["r1"]["guidance_key"]) == ("unknown", False, None)
    assert (rows["r2"]["behavior"], rows["r2"]["is_regex"], rows["r2"]["guidance_key"]) == ("log_only", True, "key")
    array = tmp_path / "array.json"
    array.write_text(json.dumps(lines, indent=1))
    assert c.load_rules(spark, str(array), multiline=True).count() == 2


def test_load_rules_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(
        '---\n- id: y1\n  name: "N"\n  category: root\n  severity: high\n  evidence_location: dex_string\n'
        '  patterns:\n    - "/bin/su"\n  description: "d"\n  bypass_hint: k\n'
    )
    row = c.load_rules(spark, str(tmp_path / "*.yaml")).collect()[0]
    assert (row["id"], row["patterns"], row["behavior"], row["guidance_key"]) == ("y1", ["/bin/su"], "unknown", "k")


def test_empty_catalogue_is_an_error(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text("")
    with pytest.raises(c.EmptyCatalogue):
        c.load_rules(spark, str(path))
    with pytest.raises(c.EmptyCatalogue):
        c.rules_frame(spark, [])


def test_shipped_pack_is_sound(spark):
    rules = c.rules_frame(spark, pack.RULES)
    found = {(r["check"], r["subject"]) for r in c.rule_violations(rules).collect()}
    assert found == {("unclassified_behavior", "release-note")}


def test_violations(spark, make_rules):
    rules = make_rules(("a", ["x"]), ("a", ["y"]), ("b", [""], dict(behavior="unknown")))
    conditions = spark.createDataFrame([("a",), ("ghost",)], "rule_id string")
    found = {(r["check"], r["subject"]): r["n"] for r in c.rule_violations(rules, conditions).collect()}
    assert found[("duplicate_id", "a")] == 2
    assert ("unclassified_behavior", "b") in found and ("empty_pattern", "b") in found
    assert ("rule_without_condition", "b") in found and ("condition_without_rule", "ghost") in found
    assert sum(check == "empty_category" for check, _ in found) == len(schema.CATEGORIES) - 1


def test_lookup_and_listing(make_rules):
    rules = make_rules(("a", ["x", "y"]), ("b", ["x"], dict(category="anti_tamper")))
    assert [r["id"] for r in c.rules_for(rules, category="anti_tamper").collect()] == ["b"]
    assert [r["id"] for r in c.rules_for(rules, rule_id="a").collect()] == ["a"]
    assert c.rules_for(rules, rule_id="none").count() == 0
    listing = json.loads(c.list_rules(rules).where("id = 'a'").collect()[0]["listing"])
    assert listing == dict(id="a", name="rule a", category="root", severity="medium", description="about a")
    table = {r["pattern"]: r["n_rules"] for r in c.pattern_table(rules).collect()}
    assert table == {"x": 2, "y": 1}


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.apk", "sub/b.APKS", "c.zip", "apk"):
        (tmp_path / name).write_bytes(b"12345")
    df = files.package_inventory(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"], r["ext"]) for r in df.collect()) == [
        ("a.apk", 5, "apk"), ("b.APKS", 5, "apks"),
    ]
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_findings_round_trip(spark, tmp_path, make_findings, fmt):
    found = make_findings(("a", "x", "root", "low", "unknown"), ("b", "y", "app_defense", "high", "log_only"))
    path = str(tmp_path / fmt)
    files.write_findings(found, path, fmt)
    assert (tmp_path / fmt / "category=root").is_dir()
    assert sorted(map(tuple, files.read_findings(spark, path, fmt).collect()), key=str) == sorted(
        map(tuple, found.collect()), key=str
    )
    with pytest.raises(ValueError):
        files.write_findings(found, path, "docx")


def test_history(spark, tmp_path):
    def rows(*given):
        numbered = [(*r, i) for i, r in enumerate(given)]
        return spark.createDataFrame(numbered, "label string, path string, report string, created_at long, seq long")

    path = str(tmp_path / "history")
    h.append_history(rows(("a", "p1", "x" * 300, 60_000), ("b", "p2", "short", 120_000)), path, 1)
    h.append_history(rows(("first", "p9", "old", 60_000), ("a again", "p1", "new", 60_000)), path, 2)
    stored = h.read_history(spark, path)
    listed = h.history(stored).collect()
    assert [(r["label"], r["created_minute"], r["preview"]) for r in listed] == [
        ("b", "1970-01-01 00:02", "short"), ("a again", "1970-01-01 00:01", "new"),
    ]
    h.clear_history(spark, path)
    assert h.read_history(spark, path).count() == 0
    h.append_history(rows(("c", "p", "r", 1)), path, 3)
    assert h.read_history(spark, path).count() == 1


def test_preview_is_cut_without_mark(spark):
    df = spark.createDataFrame([("l", "p", "x" * 300, 0)], "label string, path string, report string, created_at long")
    assert h.history(df).collect()[0]["preview"] == "x" * 200


def test_upsert_keeps_the_last_inserted(spark):
    struct = "created_at long, report string, seq long"
    old = spark.createDataFrame([(1, "old", 1), (2, "kept", 2), (3, "first", 3), (3, "second", 4)], struct)
    new = spark.createDataFrame([(1, "new", 1), (4, "added", 2)], struct)
    rows = {r["created_at"]: r["report"] for r in h.upsert_history(old, new).collect()}
    assert rows == {1: "new", 2: "kept", 3: "second", 4: "added"}


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).collect()[0][0]


def test_text_functions(spark):
    assert one(spark, tx.fingerprint, "abc") == hashlib.sha256(b"abc").hexdigest()
    assert one(spark, tx.truncate, "x" * 200) == "x" * 200
    assert one(spark, tx.truncate, "é" * 201) == "é" * 200 + "…"
    counts = "a\n**Findings:** 27 total — 1 triggered, 26 bypassed, 0 unknown\n"
    assert tuple(one(spark, tx.parse_counts, counts)) == (27, 1, 26, 0)
    assert one(spark, tx.parse_counts, "nothing here") is None
    assert one(spark, tx.parse_counts, "1 total — 99999999999 triggered, 1 bypassed, 1 unknown") is None
    assert one(spark, tx.classify_marker, "x ⚠ INCONCLUSIVE — y ✗ FAIL — z") == "fail"
    assert one(spark, tx.classify_marker, "none") is None
    assert one(spark, tx.marker_explanation, "**✗ FAIL — at least one fires. ** more **") == "at least one fires."
    assert one(spark, tx.marker_explanation, "**✗ FAIL — open end") is None


def test_bucketed_key(spark):
    key = lambda ms: one(spark, lambda v: tx.bucketed_key(F.lit("pkg"), v), ms, "long")
    assert key(60_000) == key(119_999) == hashlib.sha256(b"pkg:1").hexdigest()
    assert key(120_000) != key(119_999)


def test_millis_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Jakarta", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-01 10:20:30.123456' AS t")
            row = df.select(tx.utc_millis(F.col("t")).alias("ms")).select("ms", tx.minute_text(F.col("ms"))).collect()[0]
            assert tuple(row) == (1719829230123, "2024-07-01 10:20")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_scratch_path_uses_the_shared_folder():
    set_conf = {"spark.checkpoint.dir": "/shared/folder/"}
    assert scratch_path(SimpleNamespace(conf=set_conf), "x").startswith("/shared/folder/x-")
    own, other = (scratch_path(SimpleNamespace(conf={"spark.master": "local[2]"}), "x") for _ in range(2))
    assert own != other and not own.startswith("/shared")
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(NoSharedFolder):
            scratch_path(SimpleNamespace(conf={"spark.master": master}), "x")


def test_scans_are_dealt_only_where_asked(spark):
    before = spark.conf.get(SCAN_PARTITIONS)
    df = spark.range(10)
    assert "RepartitionByExpression" in dealt(df, "id")._jdf.queryExecution().analyzed().toString()
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        assert dealt(df, "id") is df
    finally:
        spark.conf.set(SCAN_PARTITIONS, before)


@pytest.mark.parametrize(
    "fmt, text",
    [
        ("json", "{bad line"),
        ("json", json.dumps({**RULE, "category": "NOPE"})),
        ("json", json.dumps({**RULE, "severity": "urgent"})),
        ("json", json.dumps({**RULE, "behavior": "nuke"})),
        ("json", json.dumps({**RULE, "evidence_location": "moon"})),
        ("json", json.dumps({**RULE, "id": None})),
        ("yaml", "- id: [unclosed"),
        ("yaml", "id: not-a-list"),
    ],
)
def test_faulty_rules_are_rejected(spark, tmp_path, fmt, text):
    if fmt == "yaml":
        pytest.importorskip("yaml")
    path = tmp_path / f"rules.{fmt}"
    path.write_text(text)
    with pytest.raises(Exception) as caught:
        c.load_rules(spark, str(path))
    assert isinstance(caught.value, c.BadCatalogue) or "MALFORMED" in str(caught.value) or "yaml" in str(caught.value) or "list of rules" in str(caught.value)


def test_a_folder_needs_a_format(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.yaml").write_text(
        "- {id: y1, name: N, category: root, severity: high, evidence_location: dex_string, patterns: [x], description: d}"
    )
    with pytest.raises(c.BadCatalogue):
        c.load_rules(spark, str(tmp_path / "rules"))
    assert [r["id"] for r in c.load_rules(spark, str(tmp_path / "rules"), fmt="yaml").collect()] == ["y1"]


def test_unknown_values_are_violations(make_rules):
    rules = make_rules(("a", ["x"], dict(category="NOPE", severity="urgent")), (None, ["x"], dict(evidence_location="moon")))
    found = {(r["check"], r["subject"]) for r in c.rule_violations(rules).collect()}
    assert {("unknown_category", "a"), ("unknown_severity", "a"), ("missing_id", "rule None"), ("unknown_evidence_location", None)} <= found


def test_stream_gives_the_batch_findings(spark, tmp_path, make_rules, make_evidence):
    rules = make_rules(("A", ["x"]), ("B", ["y", "xy"]))
    source = str(tmp_path / "in")
    first = make_evidence(("a", "dex_string", "c", 0, 0, "xy x"), ("b", "dex_string", "c", 0, 0, "none"))
    second = make_evidence(("a", "dex_string", "c", 1, 0, "x again"), ("c", "dex_string", "c", 0, 0, "y"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (first, second):
        part.write.mode("append").parquet(source)
        query = start_match_stream(evidence_stream(spark, source, 1), rules, out, checkpoint)
        query.awaitTermination(120)
    got = findings_so_far(spark, out, rules)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        map(tuple, scan(first.unionByName(second), rules).collect()), key=str
    )

import random

import pytest

from rulesieve import schema
from rulesieve.operators import evidence as ev
from rulesieve.operators.findings import scan
from rulesieve.operators.matching import match_contains
from rulesieve.sources.catalogue import local_table


@pytest.fixture
def entries(spark):
    def make(*names):
        rows = [
            dict(artifact_id="a", entry_ord=i, name=n, compressed_size=1, uncompressed_size=10 * i, is_compressed=True)
            for i, n in enumerate(names)
        ]
        return local_table(spark, rows, schema.ENTRIES)

    return make


@pytest.fixture
def elements(spark):
    def make(*rows):
        full = [
            dict(artifact_id=a, elem_ord=i, tag=t, attrs=[dict(k=k, v=v) for k, v in attrs])
            for a, i, t, attrs in rows
        ]
        return local_table(spark, full, schema.MANIFEST_ELEMENTS)

    return make


def test_code_containers(entries):
    names = ["classes.dex", "classes2.dex", "xclasses.dex", "classes.dex.bak", "lib/x.dex", "classes/a.dex"]
    kept = [r["name"] for r in ev.code_containers(entries(*names)).collect()]
    assert kept == ["classes.dex", "classes2.dex", "classes/a.dex"]


def test_native_lib_names(entries):
    names = ["lib/arm64/liba.so", "lib/liba.so", "lib/x86/deep/liba.so", "libs/x86/a.so", "lib/x86/a.txt"]
    rows = ev.native_lib_names(entries(*names)).collect()
    assert [(r["abi"], r["filename"]) for r in rows] == [("arm64", "liba.so")]
    lib = ev.lib_evidence(ev.native_lib_names(entries(*names))).collect()[0]
    assert (lib["kind"], lib["container"], lib["value"]) == ("native_lib_name", "arm64", "liba.so")


def test_haystack_is_in_document_order_with_repeats(elements):
    found = ev.manifest_haystack(
        elements(
            ("a", 1, "app", [("name", "X"), ("name", "Y")]),
            ("a", 0, "manifest", [("package", "p.q")]),
            ("b", 0, "manifest", []),
        )
    ).collect()
    assert {(r["artifact_id"], r["segment"]): r["haystack"] for r in found} == {
        ("a", 0): "manifest package=p.q app name=X name=Y ",
        ("b", 0): "manifest ",
    }


@pytest.mark.parametrize("segment", [1, 2, 3, 5, 4096])
def test_segmented_haystack_finds_what_the_whole_one_does(elements, make_rules, segment):
    """Random manifests with gaps in their positions, cut anywhere."""
    rng = random.Random(segment)
    rows = []
    for artifact in ("a", "b", "c"):
        position = 0
        for _ in range(25):
            position += rng.choice([1, 1, 1, 4])
            rows.append((artifact, position, rng.choice("xyz"), [(rng.choice("k"), rng.choice("12"))] * rng.randint(0, 2)))
    table = elements(*rows)
    patterns = ["k=1 x k=2 y ", "x y z", "k=1 k=1 z x", "z ", "y k=2 k=2 x y z", "x x x x"]
    rules = make_rules(*[(p, [p], dict(evidence_location="manifest")) for p in patterns])
    whole = {r["artifact_id"]: r["haystack"] for r in ev.manifest_haystack(table).collect()}
    want = {(a, p) for a, text in whole.items() for p in patterns if p in text}
    evidence = ev.manifest_evidence(table, segment, max(map(len, patterns)) - 1)
    got = {(r["artifact_id"], r["rule_id"]) for r in match_contains(evidence, rules).collect()}
    assert got == want and want


def test_attributes(elements):
    table = elements(
        ("a", 0, "manifest", [("package", "p.a"), ("package", "again")]),
        ("a", 1, "application", [("label", "L")]),
        ("a", 2, "application", [("name", "Late")]),
        ("a", 3, "uses-permission", [("name", "INTERNET")]),
        ("a", 4, "uses-permission", [("max", "9")]),
        ("a", 5, "uses-permission", [("name", "CAMERA"), ("name", "second")]),
        ("b", 0, "manifest", []),
        ("b", 1, "application", [("name", "B")]),
    )
    first = lambda *args: {r[0]: r[1] for r in ev.first_attr(table, *args).collect()}
    assert first("package") == {"a": "p.a", "b": None}
    assert first("name", "application") == {"a": None, "b": "B"}
    assert first("name", "meta-data") == {"a": None, "b": None}
    values = ev.attr_values(table, "uses-permission", "name").collect()
    assert [(r["elem_ord"], r["value"]) for r in values] == [(3, "INTERNET"), (5, "CAMERA")]


def test_explode_strings_keeps_empty_and_position(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, "")], "id long, text string")
    rows = [(r["id"], r["ordinal"], r["value"]) for r in ev.explode_strings(df).collect()]
    assert rows == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (1, 3, ""), (2, 0, "")]
    dots = spark.createDataFrame([(1, "a.|b.|c")], "id long, text string")
    assert [r["value"] for r in ev.explode_strings(dots, separator=".|").collect()] == ["a", "b", "c"]


def test_build_evidence_unites_kinds(entries, strings):
    table = ev.build_evidence([strings("x"), ev.entry_evidence(entries("n"))])
    assert table.columns == schema.EVIDENCE.names
    assert sorted((r["kind"], r["value"]) for r in table.collect()) == [("dex_string", "x"), ("zip_entry", "n")]


def test_search(spark):
    df = spark.createDataFrame(
        [("Zed", "com.alpha", "s"), ("alpha", "com.b", "s"), ("Beta", "com.c", ""), ("Gamma", "com.ALPHA", None)],
        "label string, pkg string, source string",
    )
    find = lambda q: [r[0] for r in ev.search(df, ["label", "pkg"], q, "label", "source").collect()]
    assert find("ALPha") == ["alpha", "Zed"]
    assert find(" ") == ["alpha", "Zed"]
    assert find("nothing") == []
    assert find("ed") == ["Zed"]


def test_first_attr_is_aggregated_before_the_shuffle(elements):
    plan = ev.first_attr(elements(("a", 0, "t", [])), "k")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_a_manifest_is_whole_unless_asked(elements, make_rules):
    """A regular expression and a short literal across any cut: each found once."""
    rows = [("a", i, "t", [("k", str(i))]) for i in range(9_000)] + [("a", None, "first", []), (None, 1, "t", [])]
    table = elements(*rows)
    rules = make_rules(
        ("re", ["k=4095 +t k=4096 "], dict(evidence_location="manifest", is_regex=True)),
        ("lit", ["k=4096"], dict(evidence_location="manifest")),
    )
    evidence = ev.manifest_evidence(table)
    assert evidence.count() == 1 and evidence.collect()[0]["value"].startswith("first t k=0 ")
    found = sorted(r["rule_id"] for r in scan(evidence, rules).collect())
    assert found == ["lit", "re"]
    assert match_contains(evidence, rules).count() == 1
    with pytest.raises(ValueError):
        ev.manifest_haystack(table, 4096)

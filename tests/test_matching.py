import random

import pytest
from pyspark.sql import functions as F

from rulesieve.functions import screen
from rulesieve.operators import matching as m
from rulesieve.operators.matching import PatternSet, match, match_contains, match_longest, match_regex


def hits(df):
    rows = df.select("artifact_id", "ordinal", "match_pos", "pattern", "rule_id", "pattern_ord").collect()
    return sorted(tuple(r) for r in rows)


def fired(df):
    return sorted({(r["value"], r["rule_id"]) for r in df.collect()})


def test_nested_pattern(make_rules, strings):
    rules = make_rules(("A", ["License"]), ("B", ["MIT License"]))
    text = strings("under the MIT License")
    assert [r for _, r in fired(match_contains(text, rules))] == ["A", "B"]
    assert [r for _, r in fired(match_longest(text, rules))] == ["B"]


def test_longest_goes_on_after_a_match(make_rules, strings):
    rules = make_rules(("A", ["proxy"]), ("B", ["proxy-server"]))
    assert hits(match_longest(strings("proxy-serverproxy"), rules)) == [
        ("a", 0, 0, "proxy-server", "B", 0),
        ("a", 0, 1, "proxy", "A", 0),
    ]


def test_shared_pattern_fires_both_rules(make_rules, strings):
    rules = make_rules(("A", ["x.y"]), ("B", ["q", "x.y"]))
    assert hits(match_longest(strings("-x.y-", "xzy"), rules)) == [
        ("a", 0, 0, "x.y", "A", 0),
        ("a", 0, 0, "x.y", "B", 1),
    ]


def test_case_matters_and_substrings_count(make_rules, strings):
    rules = make_rules(("A", ["proxy"]))
    assert fired(match_longest(strings("reproxying", "PROXY"), rules)) == [("reproxying", "A")]


def test_rule_sees_only_its_kind(make_rules, make_evidence):
    rules = make_rules(("S", ["key"]), ("Z", ["key"], dict(evidence_location="zip_entry")))
    evidence = make_evidence(
        ("a", "dex_string", "c", 0, 0, "key one"),
        ("a", "zip_entry", "c", 0, 0, "key two"),
        ("a", "manifest", "c", 0, 0, "key three"),
    )
    expected = [("key one", "S"), ("key two", "Z")]
    assert fired(match_contains(evidence, rules)) == expected
    assert fired(match(evidence, rules, longest=["dex_string"], contains=["zip_entry"])) == expected


def test_regex_rules(make_rules, strings):
    rules = make_rules(
        ("R", ["[a-z]+@[a-z]+", "^no"], dict(is_regex=True)), ("L", ["[a-z]+@[a-z]+"]), ("M", ["mail"])
    )
    text = strings("send mail to me@host", "no", "[a-z]+@[a-z]+ as text")
    assert fired(match_regex(text, rules)) == [("no", "R"), ("send mail to me@host", "R")]
    assert fired(match_longest(text, rules)) == [("[a-z]+@[a-z]+ as text", "L"), ("send mail to me@host", "M")]


def test_quotes_and_specials_are_literal(make_rules, strings):
    patterns = ["a.b*", "\\Q[x]\\E", "$(y)", "tab\there", "été", "{1,2}", "'quoted'"]
    rules = make_rules(("A", patterns))
    text = strings(*[f"<{p}>" for p in patterns], "aXbbb", "x", "y")
    expected = sorted((f"<{p}>", "A") for p in patterns)
    assert fired(match_longest(text, rules)) == expected
    assert fired(match_contains(text, rules)) == expected
    assert fired(match_longest(text, PatternSet.distributed(rules))) == expected
    assert fired(match_contains(text, PatternSet.distributed(rules))) == expected


def test_no_pattern_of_the_kind_gives_no_rows(make_rules, strings):
    rules = make_rules(("Z", ["x"], dict(evidence_location="zip_entry")))
    for found in (match_longest, match_contains, match_regex):
        assert found(strings("x"), rules, ["dex_string"]).count() == 0
        assert found(strings("x"), PatternSet.distributed(rules), ["dex_string"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_equals_compiled(make_rules, make_evidence, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc.") for _ in range(n))
    rules = make_rules(*[(f"r{i}", [word(rng.choice([1, 2, 3, 4, 5, 8, 11])) for _ in range(3)]) for i in range(12)])
    evidence = make_evidence(
        *[(f"a{i % 3}", "dex_string", f"c{i % 2}", i % 2, i, word(rng.randint(0, 60))) for i in range(120)]
    )
    for found in (match_longest, match_contains):
        compiled = hits(found(evidence, rules))
        assert compiled and compiled == hits(found(evidence, PatternSet.distributed(rules)))


def test_repeated_rows_stay_apart(make_rules, make_evidence):
    """Equal rows, a null value and several kinds: both ways give the same matches."""
    rules = make_rules(("A", ["abc", "b"]), ("B", ["bc"]), ("Z", ["abc"], dict(evidence_location="zip_entry")))
    row = ("a", "dex_string", "c", 0, 0, "xabcb")
    evidence = make_evidence(row, row, row, ("a", "dex_string", "c", 0, 1, None), ("a", "zip_entry", "c", 0, 0, "abc"), ("a", "zip_entry", "c", 0, 0, "abc"))
    for found in (match_longest, match_contains):
        compiled = hits(found(evidence, rules))
        assert len(compiled) >= 8 and compiled == hits(found(evidence, PatternSet.distributed(rules)))
    assert match(evidence, PatternSet.distributed(rules)).count() == 0  # no kind is named


def test_distributed_against_brute_force(make_rules, make_evidence):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(50)]
    patterns = ["".join(rng.choice("ab") for _ in range(n)) for n in (3, 5, 8, 9, 12, 14)]
    evidence = make_evidence(*[("a", "dex_string", "c", 0, i, t) for i, t in enumerate(texts)])
    rules = make_rules(*[(p, [p]) for p in sorted(set(patterns))])
    want = sorted((i, p) for i, t in enumerate(texts) for p in set(patterns) if p in t)
    for patterns_in in (rules, PatternSet.distributed(rules)):
        got = match_contains(evidence, patterns_in).select("ordinal", "pattern").collect()
        assert sorted(map(tuple, got)) == want


def test_too_large_a_catalogue_stays_distributed(make_rules, strings, monkeypatch):
    rules = make_rules(("A", ["abc", "bcd"]), ("B", ["cde"]), ("R", ["a.c", "^b"], dict(is_regex=True)))
    text = strings("abcde", "bcd", "zzz")
    expected = [hits(f(text, rules)) for f in (match_longest, match_contains, match_regex)]
    monkeypatch.setattr(m, "MAX_PATTERNS", 2)
    monkeypatch.setattr(m, "REGEX_BLOCK", 1)
    assert PatternSet.of(rules).rows is None
    assert [hits(f(text, rules)) for f in (match_longest, match_contains, match_regex)] == expected


def test_deeply_nested_literals(make_rules, strings):
    """Too deep for one folded expression; each row then gets its own."""
    rules = make_rules(("A", ["a" * n for n in range(1, 230)]), ("B", ["aab"]))
    found = match_longest(strings("a" * 240 + "b", "xaaby"), rules)
    assert [(o, p, len(t)) for _, o, p, t, _, _ in hits(found)] == [(0, 0, 229), (0, 1, 11), (1, 0, 3)]


def test_over_long_pattern_stays_distributed(make_rules, strings):
    long = "x" * (m.MAX_PATTERN_CHARS + 1)
    rules = make_rules(("A", [long]), ("B", ["yy"]))
    assert PatternSet.of(rules).rows is None
    assert fired(match_longest(strings(long + "yy"), rules)) == [(long + "yy", "A"), (long + "yy", "B")]


def test_compiled_plan_has_one_pass_and_no_nested_loop(make_rules, strings):
    df = match_longest(strings("a"), make_rules(("A", ["a", "b"]), ("B", ["c"])))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Exchange hashpartitioning" not in plan
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Generate inline") == 1


@pytest.mark.parametrize("limit", [7, 7_000])
def test_many_literals_are_screened_the_same(make_rules, make_evidence, monkeypatch, limit):
    """Beyond one alternation, and within it."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé\n.") for _ in range(n))
    rules = make_rules(*[(f"r{i}", [word(rng.choice([2, 3, 4, 6])) for _ in range(3)]) for i in range(20)])
    evidence = make_evidence(*[("a", "dex_string", "c", 0, i, word(rng.randint(0, 50))) for i in range(150)])
    want = [hits(f(evidence, rules)) for f in (match_longest, match_contains)]
    monkeypatch.setattr(screen, "ALTERNATION_LIMIT", limit)
    monkeypatch.setattr(m, "FOLDED_LITERALS", 7)
    monkeypatch.setattr(screen, "SCREENED_CHARS", 3)
    assert [hits(f(evidence, rules)) for f in (match_longest, match_contains)] == want and want[0]


def test_missing_values_match_nothing(make_rules, make_evidence):
    rules = make_rules(("A", ["x"]), ("R", ["x|^$"], dict(is_regex=True)))
    evidence = make_evidence(
        ("a", "dex_string", "c", 0, 0, None), ("a", None, "c", 0, 1, "x"), ("a", "dex_string", "c", 0, 2, "x")
    )
    for found in (match_longest, match_contains, match_regex):
        assert {r["ordinal"] for r in found(evidence, rules).collect()} == {2}


def test_faulty_expression_fails_before_the_job(make_rules, strings):
    with pytest.raises(Exception, match="regular expression"):
        match_regex(strings("x"), make_rules(("R", ["(x"], dict(is_regex=True))))


def test_a_hot_artifact_sends_few_rows_to_the_cap(spark, make_rules):
    """The cap is applied before the shuffle as well as after it."""
    from rulesieve.operators.findings import cap_evidence

    rows = spark.range(100).select(
        F.lit("hot").alias("artifact_id"), F.lit("dex_string").alias("kind"), F.lit("c").alias("container"),
        F.col("id").alias("container_ord"), F.lit(0).alias("ordinal"), F.lit("needle").alias("value"),
    )
    capped = cap_evidence(match_longest(rows, make_rules(("A", ["needle"]))))
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [r["container_ord"] for r in capped.orderBy("evidence_rank").collect()] == [0, 1, 2]


def test_expressions_together_and_each(make_rules, strings, monkeypatch):
    """Groups of any size, a group too large for the engine, flags and groups inside expressions."""
    rules = make_rules(
        ("A", ["a.c", "^b", "(?i)XyZ", "(q)(r)", "é+$"], dict(is_regex=True)),
        ("B", ["(?:ab){400}(?:cd){400}[a-z]{500}", "(?:xy){500}[a-f]{500}"], dict(is_regex=True)),
    )
    text = strings("abc", "bcd", "xxYZ xyz", "qr éé", "none", None, "ab" * 400 + "cd" * 400 + "z" * 500)
    found = []
    for size in (1, 2, 64):
        monkeypatch.setattr(screen, "EXPRESSIONS_TOGETHER", size)
        found.append(hits(match_regex(text, rules)))
    assert found[0] == found[1] == found[2] and len(found[0]) == 7

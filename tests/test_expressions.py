"""Literals that expressions need, and matching by them."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st

from rulesieve.functions.expressions import needed_literals, required_literals
from rulesieve.operators import matching as m
from rulesieve.operators.matching import PatternSet, match_regex


@pytest.mark.parametrize(
    ("expression", "literals"),
    [
        ("^The thing\\b", ["The thing"]),
        ("abc.*defgh", ["defgh"]),
        ("(?:cat|dog)s+", ["cat", "dog"]),
        ("gr[ae]y", ["gray", "grey"]),
        ("x(?:ab)?yz", ["yz"]),
        ("(foo|ba[rz])+!", ["bar", "baz", "foo"]),
        ("a{0,3}", []),
        ("[0-9]{16}", []),
        ("(?i)abc", []),
        ("(?i:abc)def", ["def"]),
        ("cat|", []),
        ("[^a]b", ["b"]),
        ("\\Qa.b\\E", []),
        ("\\pLabc", []),
        ("[[:alpha:]]+x", []),
        ("(", []),
        ("a\\.b\\x41", ["a.bA"]),
        ("", []),
        ("é{2,}zz", ["zz"]),
    ],
)
def test_known_expressions(expression, literals):
    assert required_literals(expression) == literals


atoms = st.sampled_from(["a", "b", "ab", "ba", ".", "[ab]", "[^a]", "\\b", "^", "$", "c", "é", "a?", "\\."])
expressions = st.recursive(
    atoms,
    lambda inner: st.one_of(
        st.tuples(inner, inner).map("".join),
        st.tuples(inner, inner).map(lambda p: f"(?:{p[0]}|{p[1]})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{0,2}", "{1,}", "+?", "{,2}"])).map(lambda p: f"(?:{p[0]}){p[1]}"),
        inner.map(lambda e: f"({e})"),
        inner.map(lambda e: f"(?i:{e})"),
    ),
    max_leaves=8,
)


@given(expressions, st.lists(st.text("abcAB.é {,2}", max_size=14), min_size=1, max_size=20))
@settings(max_examples=600, deadline=None)
def test_every_match_holds_a_needed_literal(expression, texts):
    try:
        hits = pc.match_substring_regex(pa.array(texts), pattern=expression).to_pylist()
    except pa.ArrowInvalid:
        return
    literals = required_literals(expression)
    assert all(any(w in t for w in literals) for t, hit in zip(texts, hits) if hit and literals)


def some_expressions(rng, n):
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    shapes = [
        lambda: f"^{word(3)}\\b",
        lambda: f"{word(2)}.{word(3)}",
        lambda: f"(?:{word(3)}|{word(4)})[a-h]?{word(1)}",
        lambda: f"{word(2)}+[ab]{word(2)}",
        lambda: f"(?i){word(3).upper()}",
        lambda: f"[a-d]{{4}}{word(1)}$",
        lambda: f"({word(2)}){{2}}",
    ]
    return sorted({rng.choice(shapes)() for _ in range(n)})


def hits(df):
    return sorted(map(tuple, df.select("artifact_id", "ordinal", "value", "pattern", "rule_id").collect()))


def test_a_thousand_expressions_equal_the_compiled_path(make_rules, make_evidence, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(m, "REGEX_BLOCK", 100)
    rules = make_rules(*[(f"r{i}", [e], dict(is_regex=True)) for i, e in enumerate(some_expressions(rng, 1_900))])
    assert rules.count() >= 1_000
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6)))
    values = [text() for _ in range(60)] + [None, "", "ABC abc"]
    evidence = make_evidence(*[("a", "dex_string", "c", 0, i // 2, v) for i, v in enumerate(values + values[:5])])
    compiled = hits(match_regex(evidence, rules))
    assert len(compiled) > 200 and compiled == hits(match_regex(evidence, PatternSet.distributed(rules)))


def test_rows_meet_few_expressions(spark, make_rules, make_evidence):
    """Candidates are near the hits, and no expression meets a row twice."""
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    openings = sorted({word(5) for _ in range(200)})
    evidence = make_evidence(*[("a", "dex_string", "c", 0, i, f"{rng.choice(openings)} {word(30)}") for i in range(300)])
    listed = spark.createDataFrame([("dex_string", f"^{w}\\b") for w in openings], "kind string, pattern string")
    listed = listed.withColumn("literals", needed_literals(listed["pattern"]))
    met = m.regex_candidates(evidence, listed).select("ordinal", "pattern").collect()
    assert len(met) == len(set(met)) and 300 <= len(met) <= 5 * 300


def test_several_literals_of_one_expression(make_rules, strings):
    rules = PatternSet.distributed(make_rules(("A", ["(?:one|two|three)x?", "[0-9]+"], dict(is_regex=True)), ("B", [""], dict(is_regex=True))))
    found = match_regex(strings("one two three", "none 7", "x", None, "one two three"), rules).collect()
    assert sorted((r.ordinal, r.pattern) for r in found if r.pattern) == [
        (0, "(?:one|two|three)x?"), (1, "(?:one|two|three)x?"), (1, "[0-9]+"), (4, "(?:one|two|three)x?")
    ]

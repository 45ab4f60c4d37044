"""The folded expression must match like a longest-first alternation."""

import re

import pytest
from hypothesis import given, settings, strategies as st

from rulesieve.functions.literals import TooDeep, literal_regex

words = st.lists(st.text("ab.(-", min_size=1, max_size=5), min_size=1, max_size=30)


@given(words, st.text("ab.(- ", max_size=60))
@settings(max_examples=400, deadline=None)
def test_same_matches_as_longest_first_alternation(literals, text):
    plain = "|".join(re.escape(w) for w in sorted(set(literals), key=lambda w: (-len(w), w)))
    found = [m.group(0) for m in re.finditer(literal_regex(literals), text)]
    assert found == re.findall(plain, text)


@given(words, st.text("ab.(- ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_shortest_finds_something_exactly_when_a_literal_occurs(literals, text):
    assert bool(re.search(literal_regex(literals, shortest=True), text)) == any(w in text for w in literals)


def test_many_first_characters():
    literals = [chr(c) + "x" for c in range(33, 127)] + ["été", "ß"]
    regex = re.compile(literal_regex(literals))
    assert all(regex.fullmatch(w) for w in literals)
    assert not regex.search("x y z")


def test_empty_literal_and_deep_nesting_are_refused():
    with pytest.raises(ValueError):
        literal_regex(["a", ""])
    with pytest.raises(TooDeep):
        literal_regex(["a" * n for n in range(1, 400)])

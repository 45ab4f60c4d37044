"""A vectorised look at evidence: which rows can match at all, and by what.

Most evidence matches nothing. The screen tells so for whole Arrow batches, at
a few nanoseconds per character, and only the few remaining rows are matched
exactly. Regular expressions are decided here, in linear time, in the dialect
of RE2 (as rule catalogues are written for automaton engines).
"""

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from rulesieve.functions.occurrences import literal_finder

# Up to this many literals an alternation looks first, which is fastest where
# hardly anything occurs; above, it would outgrow the engine's state cache. For
# the same reason an alternation holds only the beginnings of the literals.
ALTERNATION_LIMIT = 400
# (A beginning that occurs only says that the literal may: the screen drops no row.)
SCREENED_CHARS = 16
# Regular expressions tried together first; most rows match none of them.
EXPRESSIONS_TOGETHER = 64

FOUND_TYPE = "array<struct<is_regex: boolean, pattern: string>>"


def evidence_screen(
    literals: Mapping[str, Sequence[str]],
    listed: Sequence[str] = (),
    expressions: Sequence[tuple[str, str]] = (),
) -> Callable[[Column, Column], Column]:
    """Function of ``(kind, value)`` giving what was found, as ``FOUND_TYPE``.

    ``literals`` are given per kind; an entry with a null pattern says that some
    literal of the row's kind may occur (no entry: that none does). For the
    kinds in ``listed`` every literal that occurs is an entry of its own
    instead. ``expressions`` are ``(kind, expression)``; each one found is an
    entry.
    """
    tests = []  # (kind, expression that some literal's beginning matches)
    named = {}
    for kind, values in literals.items():
        if kind in listed or len(values) > ALTERNATION_LIMIT:
            named[kind] = (list(values), literal_finder(values))
            if len(values) > ALTERNATION_LIMIT:
                continue
        for start in range(0, len(values), ALTERNATION_LIMIT):
            part = sorted({v[:SCREENED_CHARS] for v in values[start : start + ALTERNATION_LIMIT]})
            tests.append((kind, "|".join(re2_quote(v) for v in part)))
    for _, expression in [*tests, *expressions]:  # a faulty expression fails here, not in a task
        pc.match_substring_regex(pa.array([""]), pattern=expression)
    grouped = _grouped(expressions)
    kinds = sorted({test[0] for test in tests} | set(named) | {kind for kind, *_ in grouped})
    listed_kinds = set(listed)
    screened_kinds = {kind for kind, *_ in tests}

    # Everything below is shipped by value: it uses only what it closes over.
    def matching(values: pa.Array, expression: str) -> np.ndarray:
        hit = pc.fill_null(pc.match_substring_regex(values, pattern=expression), False)
        return hit.to_numpy(zero_copy_only=False)

    def found(kind: pa.Array, value: pa.Array) -> pa.Array:
        rows, is_regex, patterns = [np.empty(0, np.int64)], [np.empty(0, bool)], []
        for name in kinds:
            of_kind = np.flatnonzero(pc.fill_null(pc.equal(kind, name), False))
            if not len(of_kind):
                continue
            values = value if len(of_kind) == len(value) else value.take(pa.array(of_kind))
            some_literal = np.zeros(len(of_kind), bool)
            for test_kind, expression in tests:
                if test_kind == name:
                    some_literal |= matching(values, expression)
            for group_kind, union, group in grouped:
                if group_kind != name:
                    continue
                near = np.flatnonzero(matching(values, union))
                some = values.take(pa.array(near)) if len(near) else None
                for expression in group if len(near) else ():
                    hit = of_kind[near[matching(some, expression)]]
                    rows.append(hit)
                    is_regex.append(np.full(len(hit), True))
                    patterns += [expression] * len(hit)
            if name in named:
                if name in screened_kinds:  # the finder need only see what the alternation found
                    of_kind, values = of_kind[some_literal], values.filter(pa.array(some_literal))
                texts, find = named[name]
                hits, which = find(values)
                if name in listed_kinds:
                    patterns += [texts[i] for i in which.tolist()]
                else:
                    hits = np.unique(hits)
                    patterns += [None] * len(hits)
            else:
                hits = np.flatnonzero(some_literal)
                patterns += [None] * len(hits)
            rows.append(of_kind[hits])
            is_regex.append(np.zeros(len(hits), bool))
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        entries = pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(is_regex)[order]),
                pa.array(patterns, pa.string()).take(pa.array(order)),
            ],
            names=["is_regex", "pattern"],
        )
        offsets = np.searchsorted(row[order], np.arange(len(value) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    return F.arrow_udf(found, FOUND_TYPE)


def _grouped(expressions: Sequence[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
    """Expressions of a kind in groups, each with one that matches where any of them does."""
    of_kind: dict[str, list[str]] = {}
    for kind, expression in expressions:
        of_kind.setdefault(kind, []).append(expression)
    out = []
    for kind, own in sorted(of_kind.items()):
        for start in range(0, len(own), EXPRESSIONS_TOGETHER):
            group = own[start : start + EXPRESSIONS_TOGETHER]
            union = "|".join(f"(?:{e})" for e in group)
            try:
                pc.match_substring_regex(pa.array([""]), pattern=union)
                out.append((kind, union, group))
            except pa.ArrowInvalid:  # together they are too large for the engine
                out += [(kind, e, [e]) for e in group]
    return out


def regex_found(value: Column, pattern: Column) -> Column:
    """Whether ``pattern`` occurs in ``value``, both columns, in the same dialect."""

    def found(values: pa.Array, patterns: pa.Array) -> pa.Array:
        encoded = patterns.dictionary_encode()
        which = encoded.indices.to_numpy(zero_copy_only=False)
        out = np.zeros(len(values), bool)
        for i, expression in enumerate(encoded.dictionary.to_pylist()):
            rows = np.flatnonzero(which == i)
            hit = pc.match_substring_regex(values.take(pa.array(rows)), pattern=expression)
            out[rows] = pc.fill_null(hit, False).to_numpy(zero_copy_only=False)
        return pa.array(out)

    return F.arrow_udf(found, "boolean")(value, pattern)


def re2_quote(literal: str) -> str:
    """``literal`` as a regular expression that matches just it."""
    special = "\\^$.|?*+()[]{}-"
    return "".join("\\" + c if c in special else "\\x00" if c == "\0" else c for c in literal)

"""What a regular expression needs: literals of which every match holds one.

An expression is parsed; its tree becomes an and / or tree of literals. A
sequence needs all of its parts, so its best part stands for it; a branch needs
what any of its sides needs, so their literals stand for it together. The result
is a list of literals, of which at least one occurs wherever the expression
matches. An expression that promises none (``a*``, ``[0-9]{16}``) gives an empty
list.
"""

import re
import warnings
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: More alternatives than this are no filter any more.
MAX_ALTERNATIVES = 64
#: Characters of a class that are tried one by one as parts of a literal.
CLASS_SIZE = 4


def required_literals(expression: str) -> list[str]:
    """Distinct literals, one of which every text holds that ``expression`` matches; [] if none is sure.

    Whatever the parser does not know, or reads in another way than the engine
    that matches might, promises nothing.
    """
    import re._parser as parser

    if re.search(r"\\[QEGzZCpPXRKN]|\(\?[^:imsPUu<=!]|\[\[:|\(\?[imsu]*U", expression):
        return []  # other dialects' escapes, classes and flags
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(expression)
    except (re.error, RecursionError, OverflowError):
        return []
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []
    try:
        return sorted(_needed(tree) or [])
    except RecursionError:
        return []


def _better(one: set[str] | None, other: set[str] | None) -> set[str] | None:
    """Of two sets that are both needed, the one that fewer texts hold."""
    if one is None or other is None:
        return one or other
    return max(one, other, key=lambda s: (min(map(len, s)), -len(s), sorted(s)))


def _texts(node: tuple) -> list[str] | None:
    """All texts that a node matches, if they are few and literal."""
    import re._constants as c

    kind, value = node
    if kind is c.LITERAL:
        return [chr(value)]
    if kind is c.IN and value[0][0] is not c.NEGATE:
        out = []
        for what, item in value:
            if what is c.LITERAL:
                out.append(chr(item))
            elif what is c.RANGE and item[1] - item[0] < CLASS_SIZE:
                out += [chr(i) for i in range(item[0], item[1] + 1)]
            else:
                return None
        return sorted(set(out)) if len(set(out)) <= CLASS_SIZE else None
    return None


def _needed(nodes: Sequence[tuple]) -> set[str] | None:
    """Literals for a sequence; None if nothing is sure."""
    import re._constants as c

    best: set[str] | None = None
    runs = [""]  # all texts of the literal part that is being read

    def close() -> None:
        nonlocal best, runs
        if all(runs):
            best = _better(best, set(runs))
        runs = [""]

    for node in nodes:
        kind, value = node
        texts = _texts(node)
        if texts is not None:
            if len(runs) * len(texts) > MAX_ALTERNATIVES:
                close()
            runs = [r + t for r in runs for t in texts]
            continue
        close()
        found = None
        if kind is c.SUBPATTERN:
            _, on, off, inner = value
            found = None if (on | off) & (re.IGNORECASE | re.VERBOSE) else _needed(inner)
        elif kind is c.BRANCH:
            sides = [_needed(side) for side in value[1]]
            found = set().union(*sides) if all(sides) else None
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            least, _, inner = value
            found = _needed(inner) if least else None
        elif kind is c.ATOMIC_GROUP:
            found = _needed(value)
        elif kind is c.AT and value in (c.AT_BEGINNING, c.AT_END):
            continue
        if found and len(found) <= MAX_ALTERNATIVES:
            best = _better(best, found)
    close()
    return best


def needed_literals(expression: Column) -> Column:
    """:func:`required_literals` of a column, as an array."""
    parse = required_literals

    def of(column: pa.Array) -> pa.Array:
        return pa.array([parse(e) for e in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(of, "array<string>")(expression)

"""One regular expression for a set of literal patterns.

The literals are folded by shared prefix, so at any text position at most one
path can match and the cost of a scan hardly grows with the number of literals
(a plain ``a|b|c`` alternation tries every literal at every position). Longer
literals are tried before their own prefixes, so ``regexp_extract_all`` yields
leftmost-longest, non-overlapping matches.
"""

from collections.abc import Iterable

_META = set("\\^$.|?*+()[]{}&-#~")
_END = ""  # key that marks the end of a literal in the prefix tree
_FAN_OUT = 8  # more alternatives than this are grouped behind character classes
MAX_DEPTH = 200


class TooDeep(ValueError):
    """The literals nest deeper than a regular expression should."""


def literal_regex(literals: Iterable[str], shortest: bool = False) -> str:
    """Expression that matches any of the non-empty ``literals``.

    ``shortest`` stops at the shortest literal, which is enough (and cheaper)
    when only the fact of a match matters.
    """
    root: dict = {}
    for literal in literals:
        if not literal:
            raise ValueError("an empty literal matches everywhere")
        node = root
        for char in literal:
            node = node.setdefault(char, {})
        node[_END] = {}
    first = sorted(root)
    body = _emit(root, shortest, 0)
    return _lookahead(first) + body if len(first) > 1 else body


def _emit(node: dict, shortest: bool, depth: int) -> str:
    if depth > MAX_DEPTH:
        raise TooDeep
    text = []
    while True:
        ends = _END in node
        chars = sorted(c for c in node if c != _END)
        if not chars or (ends and shortest):
            return "".join(text)
        if len(chars) == 1 and not ends:
            text.append(escape_char(chars[0]))
            node = node[chars[0]]
            continue
        branches = [(c, escape_char(c) + _emit(node[c], shortest, depth + 1)) for c in chars]
        text.append(f"(?:{_choice(branches)})?" if ends else _choice(branches))
        return "".join(text)


def _choice(branches: list[tuple[str, str]]) -> str:
    if len(branches) == 1:
        return branches[0][1]
    if len(branches) <= _FAN_OUT:
        return "(?:" + "|".join(body for _, body in branches) + ")"
    size = -(-len(branches) // _FAN_OUT)
    groups = [branches[i : i + size] for i in range(0, len(branches), size)]
    return "(?:" + "|".join(_lookahead([c for c, _ in g]) + _choice(g) for g in groups) + ")"


def _lookahead(chars: list[str]) -> str:
    return "(?=[" + "".join(escape_char(c) for c in chars) + "])"


def escape_char(char: str) -> str:
    """``char`` as it has to stand in a Java regular expression."""
    return "\\" + char if char in _META else char

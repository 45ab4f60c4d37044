"""SentencePiece encoding and decoding as a weighted transducer.

The transducer is compiled from a model file: the normaliser as the file states
it (a dummy prefix or none, blanks become a mark), a trie of arcs for the pieces,
and arcs that spell a character without piece as its bytes. Composed with a text
it is a lattice of positions, and the encoding is its shortest path in the
tropical semiring: weights along a path are added, and a position keeps the least.

In a byte-pair model a path is the result of merging exactly if every two
neighbours are what merging their joined text gives. So an arc weighs nothing
after a piece with which it stays apart, and infinity otherwise; spelling a
character weighs one, so bytes are only taken where nothing else is. One path of
finite weight remains for every prefix, so each position keeps one state. Models
of another kind, with a character map, or that drop or keep blanks otherwise are
refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from rulesieve.llm.common import per_process

MARK = "▁"
# A run that no piece reaches beyond: marks with what follows them, or a line feed;
# where no piece holds a letter before a stop, letters end before it too.
_RUNS = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
_STOPS = ".,;:!?#$%&*|"
_LETTER = "[A-Za-z\u00c0-\u024f]"
_RUNS_TO_STOPS = f"{MARK}*{_LETTER}+(?=[{_STOPS}])|" + _RUNS
_LONGEST_KEPT = 64  # characters of a run that is remembered
_RUNS_KEPT, _PAIRS_KEPT = 250_000, 500_000


_BPE = 2  # fixed value: the kind of a byte-pair model


def _fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of every field of a message in the wire format that model files have."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = message[at]
            out, shift, at = out | (byte & 0x7F) << shift, shift + 7, at + 1
            if byte < 0x80:
                return out, at

    found: dict[int, int | bytes] = {}
    at = 0
    while at < len(message):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = message[at : at + size], at + size
        found[key >> 3] = value
    return found


class Transducer:
    """Compiled from the path of a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = _fields(model.serialized_model_proto())
        trained, normaliser = _fields(spec.get(2, b"")), _fields(spec.get(3, b""))
        if trained.get(3, 1) != _BPE:
            raise ValueError("only byte-pair models are compiled")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("the model's normaliser maps characters, or drops or keeps blanks")
        self.prefix = MARK if normaliser.get(3, 1) else ""
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.size = size
        self.bytes = {int(names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.piece = {names[i]: i for i in plain}
        self.score = {names[i]: model.get_score(i) for i in plain}
        self.name = names
        # Arcs: a trie of nodes, each with the piece that ends there or -1.
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for name, i in self.piece.items():
            node = 0
            for c in name:
                if c not in self.arcs[node]:
                    self.arcs[node][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(-1)
                node = self.arcs[node][c]
            self.ends[node] = i
        inner = [name for name in self.piece if MARK in name.lstrip(MARK) or "\n" in name]
        if inner or len(self.bytes) != 256:
            raise ValueError("the model needs byte fallback and marks only at the beginning of pieces")
        joined = re.compile(f"{_LETTER}[{_STOPS}]")
        self.runs = re.compile(_RUNS if any(map(joined.search, self.piece)) else _RUNS_TO_STOPS)
        self.spelled = [b""] * size
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        for name, i in self.piece.items():
            self.spelled[i] = name.replace(MARK, " ").encode()
        self.apart: dict[int, bool] = {}
        self.made: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.known: dict[str, bytes] = {}

    def merges(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How merging (best score first, ties to the left) makes a piece from its characters.

        The scores in turn, and the first and the last part before each merge
        and at the end; nothing if merging makes something else of it.
        """
        if piece not in self.made:
            parts, score = list(self.name[piece]), self.score
            scores, first, last = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                found = [(score.get(x + y), -i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
                found = [f for f in found if f[0] is not None]
                if not found:
                    break
                best, at = max(found)
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                scores.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            self.made[piece] = (scores, first, last) if len(parts) == 1 else None
        return self.made[piece]

    def stays_apart(self, before: int, piece: int) -> bool:
        """Whether ``piece`` may follow ``before`` (-1: the beginning).

        Both are merged side by side; they come together if at some time the
        parts that touch are the best pair.
        """
        key = (before + 1) * self.size + piece
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= _PAIRS_KEPT:
                _halve(self.apart)
            found = self.apart[key] = self._merge_apart(before, piece)
        return found

    def _merge_apart(self, before: int, piece: int) -> bool:
        right = self.merges(piece)
        if before < 0 or right is None:
            return right is not None
        left = self.merges(before)
        if left is None:
            return False
        (left_scores, _, ends), (right_scores, begins, _) = left, right
        i = j = 0
        while True:
            across = self.score.get(ends[i] + begins[j])
            inside_left = left_scores[i] if i < len(left_scores) else None
            inside_right = right_scores[j] if j < len(right_scores) else None
            if across is not None and (inside_left is None or across > inside_left):
                if inside_right is None or across >= inside_right:
                    return False
            if inside_left is None and inside_right is None:
                return True
            if inside_right is None or inside_left is not None and inside_left >= inside_right:
                i += 1
            else:
                j += 1

    def shortest_path(self, run: str) -> list[int]:
        """Ids of the path of least weight through the lattice of a run."""
        n, arcs, ends, apart, size = len(run), self.arcs, self.ends, self.apart, self.size
        weight = [n + 1] * (n + 1)  # more than any path, so infinity
        last = [-1] * (n + 1)  # the piece that ends here, -1 if none restrains the next
        back = [0] * (n + 1)
        weight[0] = 0
        for i in range(n):
            own = weight[i]
            if own > n:
                continue
            before = (last[i] + 1) * size
            node = arcs[0].get(run[i])
            if (node is None or ends[node] < 0) and own + 1 < weight[i + 1]:
                weight[i + 1], last[i + 1], back[i + 1] = own + 1, -1, i  # spelled as bytes
            end = i
            while node is not None:
                end += 1
                piece = ends[node]
                if piece >= 0 and own < weight[end]:
                    found = apart.get(before + piece)
                    if found is None:
                        found = self.stays_apart(last[i], piece)
                    if found:
                        weight[end], last[end], back[end] = own, piece, i
                node = arcs[node].get(run[end]) if end < n else None
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.bytes[b] for b in reversed(run[back[at] : at].encode())]
            at = back[at]
        return out[::-1]

    def ids(self, run: str) -> bytes:
        found = self.known.get(run)
        if found is None:
            found = np.array(self.shortest_path(run), "<i4").tobytes()
            if len(run) <= _LONGEST_KEPT:
                if len(self.known) >= _RUNS_KEPT:
                    _halve(self.known)
                self.known[run] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; an empty text has none."""
        if not text:
            return b""
        return b"".join(map(self.ids, self.runs.findall(self.prefix + text.replace(" ", MARK))))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        spelled = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (spelled.removeprefix(b" ") if self.prefix else spelled).decode("utf-8", "replace")


def _halve(kept: dict) -> None:
    """Drop the older half of what is remembered."""
    for key in list(islice(kept, len(kept) // 2)):
        del kept[key]


def encoded(text: Column, model: str) -> Column:
    """Ids of a text column as bytes of little-endian 32-bit numbers; null and empty texts have none."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = per_process(("transducer", model), lambda: Transducer(model))
        for texts in batches:
            yield pa.array([transducer.encode(t or "") for t in texts.to_pylist()], pa.binary())

    return run(text)


def decoded(ids: Column, model: str) -> Column:
    """Texts of a column as from :func:`encoded`; null stays null.

    Gives the encoded text back, but for the mark U+2581, which becomes a blank.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = per_process(("transducer", model), lambda: Transducer(model))
        for column in batches:
            yield pa.array([None if x is None else transducer.decode(x) for x in column.to_pylist()], pa.string())

    return run(ids)

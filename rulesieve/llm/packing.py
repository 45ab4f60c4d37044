"""Packing of token pieces into windows by minimum bin slack.

Every document is cut into full windows and one remainder. How many pieces of
each length there are is a histogram of ``window`` numbers at most, whatever
the size of the input, so the windows are composed on the driver: a bitset
subset-sum over the remaining lengths gives the fill closest to capacity, the
counts are traced back, and the composition is used as often as the histogram
allows. Pieces find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulesieve.llm.common import CACHE_ENTRIES, batches, stored

#: Pieces ranked together in one task.
RANKED_TOGETHER = 1_000_000

PIECES = "id long, start long, length long, ids binary, doc_tokens long"

# Runs between which a byte-level BPE never merges, for texts whose only white
# space is blanks and line feeds: a word with the one blank or line feed before
# it, blanks but the last before a word, blanks at the end.
_RUNS = re.compile(r"[ \n]?[^ \n]+|[ \n]+(?=[ \n][^ \n])|[ \n]+")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
# Runs that both libraries split alike: ASCII and Latin, without other white space.
_LATIN = re.compile("[ \\n!-~\u00a1-\u024f]*")


class NotByRuns(Exception):
    """A text with other white space or special tokens has to be encoded whole."""


class RunIds(dict):
    """Token ids of runs as little-endian 32-bit numbers, remembered for a while.

    Only runs that stand for themselves are remembered. ``ranks`` names the same
    vocabulary as a list of ranks; with it, the new Latin runs of a text are
    encoded together by the faster library, with equal ids, and cut apart by
    the lengths of their tokens.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.latin = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = [s for s in self.special if len(_RUNS.findall(s)) > 1]  # would be cut by runs
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.latin = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.sizes = np.zeros(max(table.values()) + 1, np.int64)
            for token, rank in table.items():
                self.sizes[rank] = len(token)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, runs: set[str]) -> None:
        # A word after one blank or line feed begins a token, whatever stands before it.
        words = [r for r in runs if self.latin and len(r) > 1 and r[0] in " \n" and r[1] not in " \n"]
        text = "".join(words)
        if not _LATIN.fullmatch(text) or any(s in text for s in self.special):
            words = [r for r in words if _LATIN.fullmatch(r) and not any(s in r for s in self.special)]
            text = "".join(words)
        for run in runs.difference(words):
            if _OTHER_SPACE.search(run) or any(s in run for s in self.special):
                raise NotByRuns
            self[run] = self.whole(run)
        if words:
            ids = np.array(self.latin.encode_ordinary(text), "<u4")
            ends = np.cumsum([len(r.encode()) for r in words])
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1).tolist()
            data = ids.tobytes()
            for run, start, end in zip(words, [0, *cuts], cuts):
                self[run] = data[4 * start : 4 * end]

    def of(self, text: str) -> bytes:
        if self.spaced and any(s in text for s in self.spaced):
            return self.whole(text)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        runs = _RUNS.findall(text)
        new = set(filterfalse(self.__contains__, set(runs)))
        try:
            if new:
                self.learn(new)
        except NotByRuns:
            return self.whole(text)
        return b"".join(map(self.__getitem__, runs))


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    window: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of at most ``window`` ids, from ``docs(id, text)``, as ``PIECES``.

    ``tokenizer`` is the path of a byte-level BPE file, ``ranks`` and
    ``pattern`` (optional) the same vocabulary as ranks and its pattern of
    words. ``ids`` holds little-endian unsigned 32-bit numbers. Each document
    ends with ``end_id``; a null text is empty, so it is one piece of that id
    alone. Rows that repeat are documents of their own; a null id stays null.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, end, step = RunIds(tokenizer, ranks, pattern), np.array([end_id], "<u4").tobytes(), 4 * window
        for batch in batches(rows, 200):
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = runs.of(text or "") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for column, value in zip(out, (doc_id, at // 4, len(piece) // 4, piece, len(ids) // 4)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["id", "start", "length", "ids", "doc_tokens"]
            )

    return docs.mapInArrow(run, PIECES)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The lengths, each with how often, whose sum is the largest up to ``capacity``.

    Bounded subset-sum: bit ``s`` of ``reach`` says that sum ``s`` can be made.
    Counts are split into powers of two; long lengths come first, so that short
    ones are left for later windows.
    """
    reach, steps = 1, []
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left and not reach & full:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach & full:
            break
    total, used = reach.bit_length() - 1, {}
    for earlier, length, take in reversed(steps):
        if not (earlier >> total) & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def compositions(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Windows by minimum bin slack: ``(lengths with counts, how often)``.

    Each window starts with the longest piece left and is filled with what
    comes closest to capacity. A composition repeats until a length runs short.
    """
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill(left, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((used, times))
    return out


def assign_sequences(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Needs columns ``id``, ``start`` and ``length`` (1 to ``window``); others
    pass through. Pieces of equal length are told apart by rank only, so ties
    and repeated rows may change places between them. The pieces are stored
    once; an empty table gives an empty result.
    """
    pieces = stored(pieces, "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = 1 + sum(counts.values()) // RANKED_TOGETHER
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)))
    firsts = (
        salted.groupBy("length", "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    in_salt = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("id", "start"))
    ranked = (
        salted.withColumn("_rank", in_salt - F.lit(1))
        .join(firsts, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_first"))
        .drop("_salt", "_first")
    )
    # Per length: where each composition's share of the ranks begins.
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = dict.fromkeys(counts, 0), 0
    for used, times in compositions(counts, window):
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            plan.setdefault(length, []).append((taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    tables = {length: np.array(rows, np.int64).T for length, rows in plan.items()}

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("_rank").to_numpy()
            sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                first, sequence_of, n, offset = tables[int(length)]
                at = np.searchsorted(first, ranks[own], side="right") - 1
                inside = ranks[own] - first[at]
                sequences[own] = sequence_of[at] + inside // n[at]
                offsets[own] = offset[at] + inside % n[at] * length
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(sequences), pa.array(offsets)],
                [*names, "sequence_id", "offset"],
            )

    names = [c for c in ranked.columns if c != "_rank"]
    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")

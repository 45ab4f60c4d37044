"""Fill-in-middle transformation by an indexable skip list.

A text is cut into units (code points, or what a pattern matches). The skip
list holds them in its lowest lane; every express lane above spans a fixed
number of nodes of the one below and carries the width of each span both in
units and in code points. Descending by the accumulated unit widths reaches a
rank after a few steps a lane, and the code-point widths passed on the way are
the place of the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulesieve.llm.common import batches, id_text

#: The marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Nodes of a lane that one node of the next lane spans.
SPAN = 16

INFILLED = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Units of a text by rank; ``widths`` are their sizes in code points, in order."""

    def __init__(self, widths: np.ndarray):
        lane = (np.ones(len(widths), np.int32), widths)
        self.units, self.chars = len(widths), int(widths.sum())
        self.lanes = [lane]
        while len(lane[0]) > SPAN:
            at = np.arange(0, len(lane[0]), SPAN)
            lane = (np.add.reduceat(lane[0], at), np.add.reduceat(lane[1], at))
            self.lanes.append(lane)

    def place(self, rank: int) -> int:
        """Code points in front of the unit of ``rank``, that is in the first ``rank`` units."""
        if rank >= self.units:
            return self.chars
        node, chars = 0, 0
        for units, widths in reversed(self.lanes):
            while units[node] <= rank:
                rank -= int(units[node])
                chars += int(widths[node])
                node += 1
            node *= SPAN
        return chars


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Sizes of the units: single code points, or from one match of ``unit`` to the next.

    What stands before the first match belongs to it; a text without a match is one unit.
    """
    if unit is None:
        return np.ones(len(text), np.int32)
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()][1:]
    return np.diff(np.array([0, *starts, len(text)])) if text else np.zeros(0, np.int64)


def infilled(
    docs: DataFrame,
    unit: str | None = None,
    seed: int = 1,
    plain_from: int = 90,
    suffix_first_below: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every text with its middle moved to the end, as ``INFILLED``.

    Four numbers are drawn from the SHA-256 of the seed and the id: the first
    two cut the ``n`` units (see :func:`unit_widths`; ``unit`` is a pattern, None
    for code points), the third leaves texts plain from ``plain_from`` of a
    hundred on, the fourth puts the suffix first below ``suffix_first_below`` of a
    hundred. ``form`` is ``plain``, ``psm`` or ``spm``; :func:`restored` turns the
    output back into the text.

    A null text is empty. Empty texts and texts that hold a mark stay plain, and
    plain texts have null cuts. A null id draws like an empty one and stays
    null; rows that repeat give equal rows; other columns are left out.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        for batch in batches(rows, 500):
            out = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}
            for text, *h in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4"))):
                text = text or ""
                units = SkipList(unit_widths(text, pattern))
                if not text or h[2] % 100 >= plain_from or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    row = (units.units, "plain", None, None, text)
                else:
                    start, end = (units.place(r) for r in sorted((h[0] % (units.units + 1), h[1] % (units.units + 1))))
                    before, middle, after = text[:start], text[start:end], text[end:]
                    if h[3] % 100 < suffix_first_below:
                        form, output = "spm", f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
                    else:
                        form, output = "psm", f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"
                    row = (units.units, form, start, end - start, output)
                for column, value in zip(out.values(), row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [batch.column("id"), *(pa.array(c, k) for c, k in zip(out.values(), kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *out])

    return id_text(docs, id_col, text_col).select("id", "text", *numbers).mapInArrow(run, INFILLED)


def restored(output: Column, form: Column) -> Column:
    """The text of an output and its form; null where either is null.

    Marks are unambiguous: a text that holds one is plain, and no part that ends
    in front of a mark can complete another one with it.
    """
    parts = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def of(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(parts[0], second, 1)
        return _from(head, len(first)), F.substring_index(parts[0], second, -1)

    before, after = of(PREFIX, SUFFIX)
    psm = F.concat(before, parts[1], after)
    after, before = of(SUFFIX, PREFIX)
    spm = F.concat(before, parts[1], after)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def _from(text: Column, skipped: int) -> Column:
    """``text`` without its first ``skipped`` code points."""
    return F.right(text, F.length(text) - skipped)

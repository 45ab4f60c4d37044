"""Near duplicates by SimHash, found with covering codes.

The 64 bits are cut into segments with one threshold each, so that two
fingerprints within the whole threshold are within that of some segment. In a
segment the codewords of a linear code are the anchors: every value is within
the covering radius of one anchor, its home. A value within the threshold of
another is then within radius plus threshold of the other's home. So each
fingerprint goes once to its home and, as a copy, to every anchor within radius
plus threshold; at an anchor the copies are compared with those at home.

The default is two segments of 24 bits (a Hamming code of 15 bits and 9 free
bits: radius 1, threshold 1, 18.8 copies on average) and one of 16 bits that
must agree. Of random pairs, one in 20,000 is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rulesieve.llm.common import batches, connected_components, id_text, stored, text_bytes

#: Shingles hashed at once; bounds the memory that a long text takes.
SHINGLES_AT_ONCE = 50_000


@dataclass(frozen=True)
class Segment:
    """Bits ``shift`` to ``shift + bits`` with a linear code on them.

    ``checks`` are the parity checks as bit masks (none: every value is an
    anchor), ``radius`` the covering radius, ``threshold`` the differing bits
    to be found.
    """

    shift: int
    bits: int
    checks: tuple[int, ...]
    radius: int
    threshold: int

    def syndrome_of(self, value: int) -> int:
        return sum((value & check).bit_count() % 2 << i for i, check in enumerate(self.checks))

    def flips(self) -> list[list[int]]:
        """Per syndrome, the flips of up to radius plus threshold bits that lead to an anchor, the fewest bits first."""
        out: list[list[int]] = [[] for _ in range(1 << len(self.checks))]
        for weight in range(self.radius + self.threshold + 1):
            for places in combinations(range(self.bits), weight):
                flip = sum(1 << p for p in places)
                out[self.syndrome_of(flip)].append(flip)
        if any(not own or own[0].bit_count() > self.radius for own in out):
            raise ValueError("the code does not cover the segment within the radius")
        return out


def hamming_checks(parity_bits: int) -> tuple[int, ...]:
    """Parity checks of the Hamming code of ``2 ** parity_bits - 1`` bits."""
    places = range(1, 1 << parity_bits)
    return tuple(sum(1 << (p - 1) for p in places if p >> i & 1) for i in range(parity_bits))


SEGMENTS = (
    Segment(0, 24, hamming_checks(4), 1, 1),
    Segment(24, 24, hamming_checks(4), 1, 1),
    Segment(48, 16, (), 0, 0),
)


def simhash(words: list[bytes], shingle: int, seed: int) -> int:
    """Bit b is 1 if it is set in over half of the hashes of all shingles."""
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, n, SHINGLES_AT_ONCE):
        hashes = np.fromiter(
            (
                xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed)
                for i in range(start, min(n, start + SHINGLES_AT_ONCE))
            ),
            "<u8",
        )
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs(id, text)`` as ``(id, fp)``, A to Z lower-cased; no words: zero."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 500):
            found = [simhash(t.lower().split(), shingle, seed) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    return docs.mapInArrow(run, "id long, fp long")


def _anchors(segments: tuple[Segment, ...], home: bool) -> Column:
    """All (segment, anchor) of a fingerprint in column ``fp``."""
    out = []
    for number, seg in enumerate(segments):
        value = F.shiftrightunsigned("fp", seg.shift).bitwiseAND(F.lit((1 << seg.bits) - 1))
        syndrome = F.lit(0)
        for i, check in enumerate(seg.checks):
            parity = F.bit_count(value.bitwiseAND(F.lit(check))).bitwiseAND(F.lit(1))
            syndrome = syndrome.bitwiseOR(F.shiftleft(parity, i))
        flips = [own[:1] if home else own for own in seg.flips()]
        table = F.array(*[F.array(*[F.lit(f).cast("long") for f in own]) for own in flips])
        # One long names segment and anchor together.
        start = value.bitwiseOR(F.lit(number << 32))
        out.append(F.transform(F.element_at(table, syndrome + 1), start.bitwiseXOR))
    return F.flatten(F.array(*out))


def _at_anchors(nodes: DataFrame, threshold: int, segments: tuple[Segment, ...]) -> tuple[DataFrame, DataFrame]:
    """``(anchor, node, fp)`` at home, and the copies as ``(anchor, other, fp2)``.

    Spark takes an exploded table to be as large as the one before, so it would
    send some forty rows for each node to the driver and broadcast them; the
    copies ask for a merge join.
    """
    if sum(s.threshold + 1 for s in segments) <= threshold:
        raise ValueError("the segments' thresholds do not cover the whole threshold")
    homes = nodes.select(F.explode(_anchors(segments, True)).alias("anchor"), "node", "fp")
    copies = nodes.select(
        F.explode(_anchors(segments, False)).alias("anchor"), F.col("node").alias("other"), F.col("fp").alias("fp2")
    )
    return homes, copies.hint("merge")


def home_links(nodes: DataFrame, threshold: int = 4, segments: tuple[Segment, ...] = SEGMENTS) -> DataFrame:
    """Pairs ``(u, v)`` within ``threshold`` bits where ``u`` is the first node at home at an anchor that ``v`` comes to.

    At most one pair for each copy, however many nodes an anchor is home to. A
    pair of two others at a home is not compared, so this is a first step, before
    a search that looks at all pairs that are still apart.
    """
    homes, copies = _at_anchors(nodes, threshold, segments)
    first = homes.groupBy("anchor").agg(F.min(F.struct("node", "fp")).alias("u"))
    near = (F.col("u.node") != F.col("other")) & (F.bit_count(F.col("u.fp").bitwiseXOR(F.col("fp2"))) <= threshold)
    return first.join(copies, "anchor").where(near).select(F.col("u.node").alias("u"), F.col("other").alias("v")).distinct()


def links(nodes: DataFrame, threshold: int = 4, segments: tuple[Segment, ...] = SEGMENTS) -> DataFrame:
    """Pairs ``(u, v)`` of ``nodes(node, fp)``, distinct in fp, within ``threshold`` bits."""
    homes, copies = _at_anchors(nodes, threshold, segments)
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= threshold)
    return homes.join(copies, "anchor").where(near).select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    seed: int = 42,
    threshold: int = 4,
    segments: tuple[Segment, ...] = SEGMENTS,
) -> DataFrame:
    """``(doc_id, fp, n_links, component_id)``, one row per input row.

    Equal fingerprints are one node before anything is compared, so copies are
    never paired. ``n_links`` counts the other nodes that the row's node is
    linked with, ``component_id`` is the smallest id that links lead to. A null
    or wordless text has fingerprint zero and is linked like any other. A row
    with a null id keeps its fingerprint, has a null component and links
    nothing. Rows that repeat stay. An empty table gives an empty result.
    """
    prints = stored(fingerprints(id_text(docs, id_col, text_col), shingle, seed), "fingerprints")
    nodes = prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node"))
    pairs = stored(links(nodes, threshold, segments), "links")
    found = connected_components(pairs)
    degrees = pairs.union(pairs.select("v", "u")).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    of_fp = (
        nodes.join(found, "node", "left")
        .join(degrees, "node", "left")
        .select("fp", F.coalesce("component", "node").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    known = F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(of_fp, "fp", "left").select(F.col("id").alias("doc_id"), "fp", "n_links", known)

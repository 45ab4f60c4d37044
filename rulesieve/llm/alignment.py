"""Alignment of the tokens of two tokenizers by pointer jumping.

Both cut the same bytes. Tokens whose byte ranges overlap belong together; a
group is a connected component of that relation, which lies between two byte
offsets where tokens of both end. Every token points to its farthest-right
overlapping token (itself included, the second tokenizer's where both end at
the same byte). Doubling the successors of all tokens of a slice at once
converges, after as many rounds as the logarithm of the longest chain, to each
group's terminal token, which labels it.

Linked are the pairs of tokens that share a group. Pairs are counted within
blocks of documents, blocks send each distinct pair once to a shuffle that adds
them up, and get the totals of their own pairs back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rulesieve.llm.common import batches, id_text, per_process, stored, text_bytes
from rulesieve.llm.packing import RunIds

#: Distinct pairs of all documents of a block, in one task's memory.
BLOCK_PAIRS = 3_000_000
#: Bytes of text and links worked on at once.
SLICE_BYTES, SLICE_LINKS = 1 << 20, 1 << 21
#: A group with more links than this has repeated ids merged before pairs are formed.
PLAIN_LINKS = 64

BLOCKS = (
    "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups array<string>, n_pairs array<long>, keys binary, held binary, refs binary, times binary"
)
_KINDS = dict(
    block=pa.int64(), ids=pa.list_(pa.int64()), n_a=pa.list_(pa.int64()), n_b=pa.list_(pa.int64()),
    n_groups=pa.list_(pa.int64()), n_links=pa.list_(pa.int64()), groups=pa.list_(pa.string()),
    n_pairs=pa.list_(pa.int64()), keys=pa.binary(), held=pa.binary(), refs=pa.binary(), times=pa.binary(),
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


class PlainIds(RunIds):
    """Ids of a byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        super().__init__(path, ranks, pattern)
        self.tokenizer.encode_special_tokens = True
        self.special, self.spaced = [], []


class Vocabularies:
    """Both tokenizers, and the bytes and printed forms of their tokens."""

    def __init__(self, first: str, second: str, ranks: str | None, pattern: str | None):
        import sentencepiece

        self.first, self.second = PlainIds(first, ranks, pattern), sentencepiece.SentencePieceProcessor(second)
        shown = [b for b in range(256) if 32 < b < 127 or 160 < b < 173 or b > 173]
        hidden = (b for b in range(256) if b not in set(shown))
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = self.first.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            plain = any(c not in byte_of for c in token)
            self.bytes_a[number] = token.encode() if plain else bytes(map(byte_of.__getitem__, token))
        pieces, sp = range(self.second.get_piece_size()), self.second
        self.bytes_b = [
            bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            for i in pieces
        ]
        self.size_a, self.size_b = (np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b))
        n_a, n_b = range(len(self.bytes_a)), range(len(self.bytes_b))
        # A token and the mark after it: within its side, at the end of its side.
        self.printed = [b"%d," % i for i in n_a] + [b"%d|" % i for i in n_a]
        self.printed += [b"%d," % i for i in n_b] + [b"%d;" % i for i in n_b]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for each text; None where there are no tokens."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        plain = [t.decode() for t in texts]
        for raw, text, b in zip(texts, plain, self.second.encode(plain, num_threads=1)):
            a = np.frombuffer(self.first.of(" " + text), "<u4").astype(np.int64) if text else ()
            spaced = b" " + raw
            # A byte-level BPE neither changes nor moves bytes, so its tokens' sizes tell.
            same = text and int(self.size_a[a].sum()) == len(spaced) and spaced == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((a, np.array(b, np.int64)) if same else None)
        return out


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token of each token's group, tokens of B numbered after those of A.

    ``ends_a`` and ``ends_b`` are the ascending end offsets of the tokens; both
    end at the same last byte.
    """
    n_a = len(ends_a)
    over = np.searchsorted(ends_a, ends_b)
    at = np.arange(n_a, n_a + len(ends_b))
    successor = np.concatenate([n_a + np.searchsorted(ends_b, ends_a), np.where(ends_a[over] == ends_b, at, over)])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return farther
        successor = farther


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _merged(groups: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) in order of the groups; ids that repeat within ``large`` groups are merged."""
    chosen = large[groups]
    if not chosen.any():
        return groups, ids, np.ones(len(ids), np.int64)
    keys, times = np.unique(groups[chosen] << 32 | ids[chosen], return_counts=True)
    of = np.concatenate([groups[~chosen], keys >> 32])
    order = np.argsort(of, kind="stable")
    ids = np.concatenate([ids[~chosen], keys & 0xFFFFFFFF])[order]
    return of[order], ids, np.concatenate([np.ones(len(of) - len(keys), np.int64), times])[order]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys) or times.max() == 1:
        return np.unique(keys, return_counts=True)
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=times).astype(np.int64)


def linked_pairs(
    group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, doc_of: np.ndarray, n_b: int, base: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``doc * base + a * n_b + b`` of all links, ascending, and how often each occurs."""
    links = np.bincount(group_a, minlength=len(doc_of)) * np.bincount(group_b, minlength=len(doc_of))
    large = links > PLAIN_LINKS
    group_a, ids_a, times_a = _merged(group_a, ids_a, large)
    group_b, ids_b, times_b = _merged(group_b, ids_b, large)
    size_b = np.bincount(group_b, minlength=len(doc_of))
    first_b, each = _starts(size_b)[group_a], size_b[group_a]
    total, parts, at = np.cumsum(each), [], 0
    while at < len(ids_a):
        end = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_LINKS)))
        n = each[at:end]
        a = np.repeat(np.arange(at, end), n)
        b = first_b[a] + np.arange(len(a)) - np.repeat(_starts(n), n)
        parts.append(_summed(doc_of[group_a[a]] * base + ids_a[a] * n_b + ids_b[b], times_a[a] * times_b[b]))
        at = end
    if len(parts) == 1:
        return parts[0]
    return _summed(*(np.concatenate(column) for column in zip(*parts))) if parts else (ids_a, ids_a)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Block:
    """Documents of one task and the distinct pairs they link."""

    def __init__(self):
        self.rows: dict[str, list] = {c: [] for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "groups", "n_pairs")}
        self.pairs, self.times, self.n = [], [], 0

    def add(self, vocabularies: Vocabularies, ids: list, texts: list[bytes], digest: bool) -> None:
        v, n, n_b = vocabularies, len(ids), len(vocabularies.bytes_b)
        encoded = v.encode(texts)
        kept = [i for i, e in enumerate(encoded) if e]
        counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
        groups = [""] * n
        if kept:
            a, b = (np.concatenate([encoded[i][side] for i in kept]) for side in (0, 1))
            doc_a, doc_b = (np.repeat(kept, [len(encoded[i][side]) for i in kept]) for side in (0, 1))
            label = terminals(np.cumsum(v.size_a[a]), np.cumsum(v.size_b[b])) - len(a)
            last = np.zeros(len(b), bool)
            last[label[len(a) :]] = True
            number, doc_of = np.cumsum(last) - 1, doc_b[last]
            group_a, group_b = number[label[: len(a)]], number[label[len(a) :]]
            in_a, in_b = np.bincount(group_a), np.bincount(group_b)
            counts["n_a"], counts["n_b"] = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
            counts["n_groups"] = np.bincount(doc_of, minlength=n)
            np.add.at(counts["n_links"], doc_of, in_a * in_b)
            base = len(v.bytes_a) * n_b
            keys, times = linked_pairs(group_a, a, group_b, b, doc_of, n_b, base)
            counts["n_pairs"] = np.bincount(keys // base, minlength=n)
            self.pairs.append(keys % base)
            self.times.append(times)
            self.n += len(keys)
            # Each group prints its tokens of A, then those of B.
            end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
            shown = np.empty(len(a) + len(b), np.int64)
            at_a, at_b = np.arange(len(a)), np.arange(len(b))
            shown[at_a + (end_b - in_b)[group_a]] = a + len(v.bytes_a) * (at_a + 1 == end_a[group_a])
            shown[at_b + end_a[group_b]] = 2 * len(v.bytes_a) + b + n_b * (at_b + 1 == end_b[group_b])
            ends = np.cumsum(counts["n_a"] + counts["n_b"])
            for i in kept:
                tokens = shown[ends[i] - counts["n_a"][i] - counts["n_b"][i] : ends[i]].tolist()
                text = b"".join(map(v.printed.__getitem__, tokens))[:-1]
                groups[i] = hashlib.sha256(text).hexdigest() if digest else text.decode()
        self.rows["ids"] += ids
        self.rows["groups"] += groups
        for column, values in counts.items():
            self.rows[column] += values.tolist()

    def close(self) -> pa.RecordBatch:
        pairs = np.concatenate([*self.pairs, np.zeros(0, np.int64)])
        keys = np.unique(pairs)
        refs = np.searchsorted(keys, pairs)
        held = np.bincount(refs, minlength=len(keys))
        row = dict(
            self.rows,
            keys=keys.astype("<i8").tobytes(),
            held=held.astype("<i8").tobytes(),
            refs=_packed(np.diff(refs, prepend=0) & 0xFFFFFFFF),
            times=_packed(np.concatenate([*self.times, np.zeros(0, np.int64)])),
        )
        name = xxhash.xxh64(repr(self.rows["ids"]).encode() + row["keys"] + row["refs"]).intdigest()
        row["block"] = name - (1 << 63)
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in _KINDS.items()], list(_KINDS))


def _blocks(docs: DataFrame, loaded: tuple, digest: bool) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies, block = per_process(("alignment", *loaded), lambda: Vocabularies(*loaded)), Block()
        for batch in batches(rows, 2_000):
            ids, texts = batch.column("id").to_pylist(), text_bytes(batch.column("text"))
            slices = np.cumsum([len(t) for t in texts]) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(ids)]
            for start, end in zip(cuts, cuts[1:]):
                block.add(vocabularies, ids[start:end], texts[start:end], digest)
                if block.n >= BLOCK_PAIRS:
                    yield block.close()
        if block.rows["ids"]:
            yield block.close()

    return docs.mapInArrow(run, BLOCKS)


def _pair_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct pair of a block."""
    for batch in rows:
        for block, keys, held in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "held"))):
            keys, held = np.frombuffer(keys, "<i8"), np.frombuffer(held, "<i8")
            for at in range(0, len(keys), 100_000):
                k, h = keys[at : at + 100_000], held[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), block)), pa.array(k), pa.array(h)], ["block", "pair", "held"]
                )


def _scored(blocks: pa.Table, totals: pa.Table) -> pa.Table:
    """The rows of the documents of blocks, from their pairs and these pairs' totals."""
    pair, at = np.unique(totals.column("pair").to_numpy(), return_index=True)
    total, best = totals.column("total").to_numpy()[at], totals.column("best").to_numpy()[at]
    out = []
    for row in blocks.to_pylist():
        n_pairs = np.array(row["n_pairs"], np.int64)
        n, doc = int(n_pairs.sum()), np.repeat(np.arange(len(n_pairs)), n_pairs)
        keys = np.searchsorted(pair, np.frombuffer(row["keys"], "<i8"))
        refs = keys[np.cumsum(_unpacked(row["refs"], n)) & 0xFFFFFFFF]
        times = _unpacked(row["times"], n)
        sums = np.zeros((2, len(n_pairs)), np.int64)
        np.add.at(sums[0], doc, times * (total[refs] == best[refs]))
        np.add.at(sums[1], doc, times * total[refs])
        names = ("ids", "n_a", "n_b", "n_groups", "n_links", "groups")
        columns = [pa.array(row[c], _KINDS[c].value_type) for c in names] + [pa.array(s) for s in sums]
        out.append(pa.table(columns, names=["doc_id", *names[1:], "n_best", "count_sum"]))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], k) for c, k in _ALIGNED_KINDS.items()})


_ALIGNED_KINDS = {c: pa.string() if c == "groups" else pa.int64() for c in "doc_id n_a n_b n_groups n_links groups n_best count_sum".split()}


def aligned(
    docs: DataFrame,
    first: str,
    second: str,
    ranks: str | None = None,
    pattern: str | None = None,
    digest: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every text by two tokenizers, grouped and linked, as ``ALIGNED``.

    ``first`` is the path of a byte-level BPE file, which encodes the text after
    a blank, ``second`` that of a SentencePiece model that adds the blank itself;
    ``ranks`` and ``pattern`` (optional) are the first vocabulary as ranks and its
    pattern of words. ``groups`` reads ``a1,a2|b1;a3|b2,b3``; with ``digest``, its
    SHA-256 takes its place. ``n_links`` counts pairs of occurrences, ``n_best``
    those whose count, the number of rows of ``docs`` that link the two ids, is
    the highest of their first id, and ``count_sum`` adds up their counts.

    Texts that are null or empty, or that either tokenizer does not give back
    byte for byte, have no tokens: numbers are 0 and ``groups`` is ''. Rows that
    repeat count as documents of their own, a null id stays null, other columns
    are left out. A task's memory grows with its longest text, not with its rows.
    """
    spark = docs.sparkSession
    blocks = stored(_blocks(id_text(docs, id_col, text_col), (first, second, ranks, pattern), digest), "aligned")
    rows = blocks.select("block", "keys", "held").mapInArrow(_pair_rows, "block long, pair long, held long")
    totals = rows.groupBy("pair").agg(F.sum("held").alias("total"))
    n_b = _pieces(second)
    totals = stored(totals.withColumn("a", F.expr(f"pair div {n_b}")), "totals")
    # One row per token of the first vocabulary at most.
    best = totals.groupBy("a").agg(F.max("total").alias("best"))
    known = totals.join(F.broadcast(best), "a").select("pair", "total", "best")
    found = rows.select("block", "pair").join(known, "pair")
    out = blocks.drop("held").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scored, ALIGNED)
    return out


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(path).get_piece_size()

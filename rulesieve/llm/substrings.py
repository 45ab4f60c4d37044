"""Removal of passages that earlier documents hold too.

A window is a fixed number of consecutive words. Its Rabin-Karp hashes (two
polynomials over independent word hashes, 96 bits together) are counted in
Spark: a window whose smallest document is not its own is repeated, and
repeated windows merge into maximal intervals of words.

Most windows occur once, and shipping all of them would cost several times the
input. Equal windows have equal minimisers (the smallest hash among their runs
of ``gram`` words), so a window whose minimiser occurs once cannot repeat. The
minimisers, a fifth as many, are counted first; those that occur again become a
bitmap of bounded size, and only windows that pass it are counted in full. What
the bitmap lets through in error, or all windows where it is too small for the
data, is settled by that count: the bitmap only saves work. Of texts that are
equal as a whole only the smallest id has windows at all; the others are
repeated from end to end. Another bitmap tells which documents lose words, so
that only their texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rulesieve.llm.common import CACHE_ENTRIES, WordHashes, by_bytes, fresh, id_text, stored, text_bytes

#: Largest size of a bitmap, in bits (16 MiB).
MAX_BITMAP_BITS = 1 << 27
#: Bytes of text whose windows are laid out at once, and words whose hashes are remembered.
SLICE_BYTES, WORDS_KEPT = 1 << 20, CACHE_ENTRIES // 4
_BITMAP_BUCKET = 1 << 15  # bits per row of Spark's bitmap aggregate

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two polynomials


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values, modulo 2 ** 64."""
    n, out = max(0, len(words) - width + 1), None
    for j in range(width):
        part = words[j : j + n]
        out = part.copy() if out is None else out * np.uint64(base) + part
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    n, span = len(values) - width + 1, 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[:n], values[width - span : width - span + n])


class Windows:
    """The windows of a batch of texts, laid out as one array of words."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, window: int, gram: int):
        words = [t.split() for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        self.hashes = np.concatenate([hashes.of(w) for w in words]) if len(words) else np.empty(0, np.uint64)
        ends = np.cumsum(lengths)
        count = np.maximum(lengths - window + 1, 0)  # windows per text
        self.text = np.repeat(np.arange(len(words)), count)
        first = np.repeat(ends - lengths, count)
        self.position = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        self.start = first + self.position
        self.words = words
        if len(self.start):
            grams = rolling(self.hashes, gram, _BASES[0])
            grams ^= grams >> np.uint64(29)
            grams *= np.uint64(_BASES[1])
            self.least = sliding_min(grams, window - gram + 1)[self.start]
        else:
            self.least = np.empty(0, np.uint64)


class Bitmap:
    """A set of numbers by their lowest bits: never denies a member, may take others for one."""

    def __init__(self, numbers: DataFrame, spare: int = 64):
        """Of the one column of ``numbers``, with ``spare`` bits a row if that is not over the bound."""
        bits = _BITMAP_BUCKET
        while bits < min(spare * numbers.count(), MAX_BITMAP_BITS):
            bits *= 2
        bit = F.col(numbers.columns[0]).bitwiseAND(F.lit(bits - 1)) + F.lit(1)
        # Spark's bucket n holds the places (n - 1) * 32768 + 1 to n * 32768.
        rows = (
            numbers.select(bit.alias("bit"))
            .groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("set"))
            .collect()
        )
        table = np.zeros((bits // _BITMAP_BUCKET, _BITMAP_BUCKET // 8), np.uint8)
        for row in rows:
            table[row["bucket"] - 1] = np.frombuffer(row["set"], np.uint8)
        self.bits, self.table = bits, table.reshape(-1)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        bit = (numbers.astype(np.uint64, copy=False) & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

    def column(self, numbers: Column) -> Column:
        """Whether a column's numbers are in; a null is not."""

        @F.arrow_udf("boolean")
        def run(column: pa.Array) -> pa.Array:
            found = self.has(column.fill_null(0).to_numpy(zero_copy_only=False))
            return pa.array(found & column.is_valid().to_numpy(zero_copy_only=False))

        return run(numbers)


def _unlisted(rows: Iterator[pa.RecordBatch], listed: Bitmap | None) -> Iterator[pa.RecordBatch]:
    """Rows whose ``d1`` is not in the bitmap, if there is one."""
    for batch in rows:
        yield batch if listed is None else batch.filter(pa.array(~listed.has(batch.column("d1").to_numpy())))


def _minimisers(docs: DataFrame, window: int, gram: int, listed: Bitmap | None = None) -> DataFrame:
    """``m``: every minimiser of every document (but ``listed`` ones) to 40 bits, runs of equal ones once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(0, WORDS_KEPT)
        for batch in by_bytes(_unlisted(rows, listed), "text", SLICE_BYTES):
            w = Windows(text_bytes(batch.column("text")), hashes, window, gram)
            new = np.ones(len(w.least), bool)
            new[1:] = (w.least[1:] != w.least[:-1]) | (w.text[1:] != w.text[:-1])
            own = (w.least[new] & np.uint64((1 << 40) - 1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own)], ["m"])

    return docs.mapInArrow(run, "m long")


def _windows(docs: DataFrame, window: int, gram: int, repeated: Bitmap, listed: Bitmap | None = None) -> DataFrame:
    """``(h1, h2, id, place)`` of windows whose minimiser is in the bitmap (but of ``listed`` documents).

    ``place`` holds 16 bits of the text's hash above 40 bits of the position.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = WordHashes(0, WORDS_KEPT), WordHashes(1, WORDS_KEPT)
        for batch in by_bytes(_unlisted(rows, listed), "text", SLICE_BYTES):
            texts = text_bytes(batch.column("text"))
            w = Windows(texts, first, window, gram)
            keep = repeated.has(w.least)
            if not keep.any():
                continue
            other = np.zeros(len(w.hashes), np.uint64)
            offsets = np.cumsum([0] + [len(x) for x in w.words])
            digests = np.zeros(len(texts), np.int64)
            for i in np.unique(w.text[keep]):
                other[offsets[i] : offsets[i + 1]] = second.of(w.words[i])
                digests[i] = xxhash.xxh64_intdigest(texts[i], 42) & 0xFFFF
            start, text = w.start[keep], w.text[keep]
            h1 = rolling(w.hashes, window, _BASES[0])[start].view(np.int64)
            h2 = (rolling(other, window, _BASES[1])[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            place = digests[text] << 40 | w.position[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), batch.column("id").take(pa.array(text)), pa.array(place)],
                ["h1", "h2", "id", "place"],
            )

    return docs.mapInArrow(run, "h1 long, h2 int, id long, place long")


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5
) -> DataFrame:
    """``(id, digest, positions, whole)`` of rows that hold windows of a smaller id.

    ``positions`` are the first words of these windows; ``whole`` says that the
    whole text is that of a smaller id, so all windows are. ``digest`` is the
    low 16 bits of Spark's ``xxhash64`` of the text, which keeps rows apart that
    share an id. Null and short texts have no windows; a null id is not
    smaller or larger than any. Windows are judged on the input, not on what is
    left of it.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    rows = id_text(docs, id_col, text_col).where("id is not null and text is not null")
    named = rows.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    names = stored(named.select("id", "d1", "d2"), "names")
    several = stored(
        names.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").drop("last"),
        "several",
    )
    # Each text once. Most are told by the bitmap, in the task that needs them; of the
    # others, the rows to be taken are settled by names alone and their texts put
    # aside, so that no task runs one Python worker behind another.
    listed = Bitmap(several.select("d1"))

    def within(bitmap: Bitmap, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                yield batch.filter(pa.array(bitmap.has(batch.column(column).to_numpy())))

        return run

    looked_up = names.mapInArrow(within(listed, "d1"), names.schema).join(several, ["d1", "d2"], "left")
    owners = looked_up.where("least is null or id = least").select("id", "d1", "d2").distinct()
    owners = stored(owners.withColumn("owner", F.xxhash64("id", "d1")), "owners")
    possible = named.withColumn("owner", F.xxhash64("id", "d1"))
    possible = possible.mapInArrow(within(Bitmap(owners.select("owner")), "owner"), possible.schema)
    copied = stored(possible.join(owners, ["id", "d1", "d2"], "left_semi").select("id", "text"), "copied")
    single = named.select("id", "text", "d1")

    minimisers = _minimisers(single, window, gram, listed).union(_minimisers(copied, window, gram))
    again = stored(minimisers.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m"), "minimisers")
    known = Bitmap(again)
    windows = _windows(single, window, gram, known, listed).union(_windows(copied, window, gram, known))
    windows = stored(windows, "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # Stored, so that both sides of the join are plain shuffles and a passage that very many hold can be split.
    first = stored(first.where("first < last").drop("last"), "first")
    repeated = windows.join(first, ["h1", "h2"]).where("id > first")
    digest, position = F.shiftright("place", 40).alias("digest"), F.col("place").bitwiseAND(F.lit((1 << 40) - 1))
    parts = (
        repeated.groupBy("id", digest)
        .agg(F.collect_set(position).alias("positions"))
        .withColumn("whole", F.lit(False))
    )
    copies = names.join(several, ["d1", "d2"]).where("id > least")
    whole = copies.select(
        "id",
        F.col("d1").bitwiseAND(F.lit(0xFFFF)).alias("digest"),
        F.array().cast("array<long>").alias("positions"),
        F.lit(True).alias("whole"),
    )
    return parts.union(whole.distinct())


def cut(text: Column, positions: Column, whole: Column, window: int = 13) -> Column:
    """What is left of a text without the words that the windows at ``positions`` cover.

    ``whole`` stands for all positions.

    A struct: ``n_words``, ``removed`` (maximal intervals of removed words, ends
    exclusive), ``n_removed``, ``kept`` (kept words joined by one blank). Words
    are runs without ASCII white space. A null text is empty.
    """

    def of_text(text: bytes, at: list[int] | None, every: bool | None) -> tuple[int, list[dict], int, bytes]:
        words = text.split()
        if every:
            at = range(len(words) - window + 1)
        if not at:
            return len(words), [], 0, b" ".join(words)
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, np.asarray(at) + window, -1)
        gone = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        starts, ends = edges[::2].tolist(), edges[1::2].tolist()
        kept = [w for a, b in zip([0, *ends], [*starts, len(words)]) for w in words[a:b]]
        return len(words), [{"start": a, "end": b} for a, b in zip(starts, ends)], len(words) - len(kept), b" ".join(kept)

    interval = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kinds = {"n_words": pa.int64(), "removed": pa.list_(interval), "n_removed": pa.int64(), "kept": pa.string()}

    @F.arrow_udf("n_words long, removed array<struct<start: int, end: int>>, n_removed long, kept string")
    def run(texts: pa.Array, places: pa.Array, every: pa.Array) -> pa.Array:
        found = [of_text(t, p, e) for t, p, e in zip(text_bytes(texts), places.to_pylist(), every.to_pylist())]
        columns = list(zip(*found)) or [[]] * 4
        arrays = [pa.array(c, pa.binary()).cast(k) if k == pa.string() else pa.array(c, k) for c, k in zip(columns, kinds.values())]
        return pa.StructArray.from_arrays(arrays, list(kinds))

    return run(text, positions, whole)


def uncut(text: Column) -> Column:
    """What :func:`cut` gives for a text that loses nothing."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.array().cast("array<struct<start: int, end: int>>").alias("removed"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array_join(words, " ").alias("kept"),
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, into: str = "cut"
) -> DataFrame:
    """``docs`` with a struct column ``into`` as from :func:`cut`; every row stays.

    Other columns pass through. An empty table gives an empty result.
    """
    own = [fresh(docs, c) for c in ("_id", "_digest", "_positions", "_whole")]
    found = stored(repeated_windows(docs, id_col, text_col, window, gram), "repeated").toDF(*own)
    key, digest, positions, whole = map(F.col, own)
    text, doc_id = docs[text_col].cast("string"), docs[id_col].cast("long")
    maybe = Bitmap(found.select(F.xxhash64(key))).column(F.xxhash64(doc_id))
    same = (doc_id == key) & (F.xxhash64(text).bitwiseAND(F.lit(0xFFFF)) == digest)
    touched = docs.where(maybe).join(found, same, "left").withColumn(into, cut(text, positions, whole, window)).drop(*own)
    return touched.union(docs.where(~maybe).withColumn(into, uncut(text)))

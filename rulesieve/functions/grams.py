"""Fixed-length byte pieces of strings, for joining texts with patterns by key.

A pattern is represented by pieces of 8, 4, 2 or 1 bytes, the largest size it
has room for; a text that contains the pattern contains each of its pieces. The
pieces of a text are pruned by a bitmap of the pieces that patterns have, whose
size is bounded however many patterns there are.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SIZES = (8, 4, 2, 1)
PIECES_TYPE = "array<struct<size: int, piece: bigint, slot: bigint>>"
_MIN_BITS, _MAX_BITS = 16, 27  # 8 KiB to 16 MiB
_BITS_PER_BUCKET = 32_768  # of a bitmap built by bitmap_construct_agg
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BYTES = 4 << 20


def bitmap_bits(n_pieces: int) -> int:
    """Bitmap size (as a power of two) that leaves few false hits, if it may."""
    return min(max((64 * max(n_pieces, 1)).bit_length(), _MIN_BITS), _MAX_BITS)


def pattern_pieces(pattern: Column) -> Column:
    """All pieces of a pattern, of the largest size that fits."""
    return F.arrow_udf(_cutter(SIZES, True, None), PIECES_TYPE)(pattern)


def text_pieces(text: Column, sizes: Sequence[int], bits: int, bitmap: np.ndarray) -> Column:
    """Distinct pieces of a text, of every size in use, that the bitmap knows."""
    return F.arrow_udf(_cutter(tuple(sizes), False, (bits, bitmap)), PIECES_TYPE)(text)


def piece_bitmap(pieces: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the slots in ``pieces(slot)``: at most 2^bits / 8 bytes are collected."""
    slot = F.shiftrightunsigned("slot", 64 - bits)
    rows = (
        pieces.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / _BITS_PER_BUCKET).cast("int").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % _BITS_PER_BUCKET).alias("bitmap"))
        .collect()
    )
    out = np.zeros(max(1, (1 << bits) // _BITS_PER_BUCKET) * _BITS_PER_BUCKET // 8, np.uint8)
    for row in rows:
        start = row["bucket"] * _BITS_PER_BUCKET // 8
        out[start : start + len(row["bitmap"])] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def _cutter(sizes: tuple[int, ...], largest_only: bool, known: tuple[int, np.ndarray] | None):
    spread, chunk_bytes = _SPREAD, _CHUNK_BYTES

    # Shipped by value: it uses only what it closes over.
    def cut_chunk(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
        """(row, size, piece, slot) of a run of rows laid end to end."""
        window, width = data.astype(np.uint64), 1  # the bytes from each position on, as a number
        for size in sorted(sizes):
            while width < size:
                window = window[:-width] | (window[width:] << np.uint64(8 * width))
                width *= 2
            if not len(window):
                return
            slot = (window + np.uint64(size)) * spread
            if known is None:
                at = np.arange(len(window))
            else:
                bits, bitmap = known
                index = slot >> np.uint64(64 - bits)
                bit = bitmap[index >> np.uint64(3)] >> (index & np.uint64(7)).astype(np.uint8)
                at = np.flatnonzero(bit & 1)
            row = np.searchsorted(ends, at, "right")
            fits = at + size <= ends[row]
            larger = [s for s in sizes if s > size]
            if largest_only and larger:
                fits &= lengths[row] < min(larger)
            row, at = row[fits], at[fits]
            piece, slot = window[at], slot[at]
            order = np.lexsort((piece, row))
            row, piece, slot = row[order], piece[order], slot[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
            yield row[new], np.full(new.sum(), size, np.int32), piece[new], slot[new]

    def cut(texts: pa.Array) -> pa.Array:
        binary = texts.cast(pa.large_binary())
        _, offset_buffer, data_buffer = binary.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
        found, start = [], 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + chunk_bytes, "right"))
            stop = min(max(stop - 1, start + 1), len(texts))
            span = offsets[start : stop + 1]
            chunk = data[span[0] : span[-1]]
            for row, size, piece, slot in cut_chunk(chunk, span[1:] - span[0], np.diff(span)):
                found.append((row + start, size, piece, slot))
            start = stop
        nothing = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint64))
        row, size, piece, slot = map(np.concatenate, zip(*(found or [nothing])))
        order = np.argsort(row, kind="stable")
        entries = pa.StructArray.from_arrays(
            [
                pa.array(size[order]),
                pa.array(piece[order].view(np.int64)),
                pa.array(slot[order].view(np.int64)),
            ],
            names=["size", "piece", "slot"],
        )
        starts = np.searchsorted(row[order], np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), entries)

    return cut

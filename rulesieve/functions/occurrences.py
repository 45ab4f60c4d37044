"""Which of many literals occur in each text of an Arrow batch, without a loop over rows.

Every literal has an anchor: a piece of 8, 4, 2 or 1 of its bytes, the largest
size it has room for, at the place where the piece is rarest among all literals.
The bytes of a batch are looked at as one array of overlapping numbers. A bitmap
drops nearly all positions; the rest are looked up among the anchors, and the
literals found there are compared whole, eight bytes of all candidates at a time.
"""

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

_SIZES = (8, 4, 2, 1)
_SPREAD = 0x9E3779B97F4A7C15
_CHUNK_BYTES = 1 << 20
# Places of a literal that are looked at for its anchor; any place gives the same result.
_PLACES = 32
_MIN_BITS, _MAX_BITS = 13, 24  # 1 KiB to 2 MiB: the bitmap stays in a core's cache


def literal_finder(literals: Sequence[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Function of an array of strings giving ``(row, literal)``, the pairs that occur.

    Pairs are distinct and ordered; ``literal`` is a place in ``literals``, whose
    entries are distinct and not empty. A null holds nothing.
    """
    raw = [literal.encode() for literal in literals]
    lengths = np.array([len(r) for r in raw], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    spread, chunk_bytes, sizes = np.uint64(_SPREAD), _CHUNK_BYTES, _SIZES
    bits = min(max((64 * max(len(raw), 1)).bit_length(), _MIN_BITS), _MAX_BITS)

    # Shipped by value: everything below uses only what it closes over.
    def windows(data: np.ndarray) -> dict[int, np.ndarray]:
        """The bytes from each position on as one number, per size; zero bytes follow the end."""
        at, width = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64), 1
        out = {1: at}
        while width < 8:
            at = at[:-width] | (at[width:] << np.uint64(8 * width))
            width *= 2
            out[width] = at
        return out

    def hashed(piece: np.ndarray, size: int) -> np.ndarray:
        return ((piece + np.uint64(size)) * spread) >> np.uint64(64 - bits)

    joined = b"".join(raw)
    text_of = windows(np.frombuffer(joined, np.uint8))
    anchors, bitmaps = {}, {}
    for size in sizes:
        fit = np.flatnonzero((lengths >= size) & (lengths < (2 * size if size < 8 else 1 << 62)))
        if not len(fit):
            continue
        room = np.minimum(lengths[fit] - size + 1, _PLACES)
        which = np.repeat(fit, room)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(room) - room, room)
        piece = text_of[size][starts[which] + offset]
        _, inverse, shared = np.unique(piece, return_inverse=True, return_counts=True)
        # The rarest piece of each literal, ties by a hash.
        order = np.lexsort((piece * spread, shared[inverse], which))
        first = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])]
        chosen = first[np.argsort(piece[first], kind="stable")]
        values, begin = np.unique(piece[chosen], return_index=True)
        anchors[size] = (values, np.append(begin, len(chosen)), which[chosen], offset[chosen])
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        slot = hashed(values, size)
        np.bitwise_or.at(bitmap, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        bitmaps[size] = bitmap
    literal_windows = {}  # eight times the literals' size, so made where it is used

    def in_chunk(data: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not literal_windows:
            literal_windows.update(windows(np.frombuffer(joined, np.uint8)))
        of, found = windows(data), []
        for size, (values, begin, which, offset) in anchors.items():
            piece = of[size][: len(data)]
            slot = hashed(piece, size)
            known = bitmaps[size][slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)
            at = np.flatnonzero(known & 1)
            near = np.minimum(np.searchsorted(values, piece[at]), len(values) - 1)
            hit = values[near] == piece[at]
            at, near = at[hit], near[hit]
            n = begin[near + 1] - begin[near]
            entry = np.repeat(begin[near], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            literal, start = which[entry], np.repeat(at, n) - offset[entry]
            row = np.searchsorted(ends, np.repeat(at, n), "right")
            length = lengths[literal]
            inside = np.flatnonzero((start >= begins[row]) & (start + length <= ends[row]))
            row, literal, start, length = row[inside], literal[inside], start[inside], length[inside]
            # Steps of ``size`` bytes, the last one moved back so that it ends with the literal.
            step = 0
            while len(row):
                check = np.minimum(step, length - size)
                same = of[size][start + check] == literal_windows[size][starts[literal] + check]
                done = same & (step >= length - size)
                found.append((row[done], literal[done]))
                go_on = same & ~done
                row, literal, start, length = row[go_on], literal[go_on], start[go_on], length[go_on]
                step += size
        nothing = np.empty(0, np.int64)
        rows, literals_found = map(np.concatenate, zip(*(found or [(nothing, nothing)])))
        pairs = np.unique(rows.astype(np.int64) * len(lengths) + literals_found)
        return pairs // max(1, len(lengths)), pairs % max(1, len(lengths))

    def find(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        binary = texts.cast(pa.large_binary()).fill_null(b"")
        _, offset_buffer, data_buffer = binary.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
        rows, found, start = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + chunk_bytes, "right"))
            stop = min(max(stop - 1, start + 1), len(texts))
            span = offsets[start : stop + 1] - offsets[start]
            row, literal = in_chunk(data[offsets[start] : offsets[stop]], span[1:], span[:-1])
            rows.append(row + start)
            found.append(literal)
            start = stop
        return np.concatenate(rows), np.concatenate(found)

    return find

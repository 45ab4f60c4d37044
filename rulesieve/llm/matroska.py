"""Matroska as a column: bytes stored as tracks, and files parsed into packets.

``media`` stores a payload as 8-bit samples in clusters of laced blocks with
cues. ``parsed`` reads any such file: EBML elements of variable length, of known
or unknown size, clusters, blocks and block groups with all kinds of lacing, and
cues, into packets with track, timestamp and byte range. ``samples`` reads
payloads back by these byte ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the format: element ids.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC, DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE_BLOCK, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

#: Bytes of a frame, samples a second, frames of a block, blocks of a cluster.
FRAME, SAMPLE_RATE, FRAMES, BLOCKS = 576, 8000, 8, 32

PARSED = (
    "codec string, error string, clusters array<long>, cues array<struct<time: long, track: long, cluster: long>>, "
    "packets array<struct<track: int, timestamp_ns: long, offset: long, size: int, lacing: int, keyframe: boolean>>"
)
_CUE = pa.struct([("time", pa.int64()), ("track", pa.int64()), ("cluster", pa.int64())])
_PACKET = pa.struct(
    [("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()),
     ("lacing", pa.int32()), ("keyframe", pa.bool_())]
)
_PARSED = pa.struct(
    [("codec", pa.string()), ("error", pa.string()), ("clusters", pa.list_(pa.int64())), ("cues", pa.list_(_CUE)),
     ("packets", pa.list_(_PACKET))]
)


def vint(value: int, least: int = 1) -> bytes:
    """A size in as few bytes as hold it; all ones is kept for unknown sizes."""
    n = max(least, 1)
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """Sizes and frames of a block: 1 Xiph, 2 fixed, 3 EBML lacing (0: one frame)."""
    if lacing == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == 3 and len(sizes) > 1:
        head += vint(sizes[0])
        for before, size in zip(sizes, sizes[1:-1]):
            n = 1
            while not -(1 << 7 * n - 1) < size - before < (1 << 7 * n - 1):
                n += 1
            head += (size - before + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


def muxed(payload: bytes, lacing: int = 2) -> bytes:
    """A file with one track of 8-bit samples that holds ``payload``, frame by frame."""
    step_ms = FRAME * 1000 // SAMPLE_RATE
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(SCALE, 1_000_000) + element(MUXER, b"columns") + element(WRITER, b"columns"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(
        TRACKS,
        element(
            TRACK,
            number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(DURATION, step_ms * 1_000_000)
            + element(CODEC, b"A_PCM/INT/LIT") + audio,
        ),
    )
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for start in range(0, len(payload), FRAME * FRAMES * BLOCKS):
        time, content = start // FRAME * step_ms, b""
        blocks = []
        end = min(len(payload), start + FRAME * FRAMES * BLOCKS)
        for a in range(start, end, FRAME * FRAMES):
            frames = [payload[x : x + FRAME] for x in range(a, min(end, a + FRAME * FRAMES), FRAME)]
            kind = lacing if len(frames) > 1 else 0
            flags = 0x80 | kind << 1
            relative = (a - start) // FRAME * step_ms
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, flags) + laced(frames, kind)))
        content = element(CLUSTER, number(TIME, time) + b"".join(blocks))
        cues.append(
            element(CUE, number(CUE_TIME, time) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at)))
        )
        parts.append(content)
        at += len(content)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


class Broken(ValueError):
    """The bytes are not what the format asks for."""


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """Value, its number of bytes, and the position after it."""
    if at >= end or not data[at]:
        raise Broken(f"no variable-length number at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Broken(f"cut short at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep_marker else value & (1 << 7 * n) - 1), n, at + n


def elements(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, position, begin and end of content) one after the other.

    An element of unknown size reaches to the next of its parent's or its own
    level, as far as ``TOP`` tells, else to the end.
    """
    while at < end:
        place = at
        name, _, at = read_vint(data, at, end, True)
        if name in stop:
            return
        size, n, at = read_vint(data, at, end)
        if size == (1 << 7 * n) - 1:
            last = end
            if name == CLUSTER:
                last = at
                for *_, last in elements(data, at, end, TOP):
                    pass
        else:
            last = at + size
            if last > end:
                raise Broken(f"element {name:X} at {place} is cut short")
        yield name, place, at, last
        at = last


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise Broken(f"no lacing head at {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise Broken(f"frames of one size do not fill the block at {at}")
        return [(end - at) // count] * count, at
    for i in range(count - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Broken(f"lacing is cut short at {at}")
                size, more, at = size + data[at], data[at] == 255, at + 1
                if not more:
                    break
        else:
            value, n, at = read_vint(data, at, end)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * n - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken(f"frames exceed the block at {at}")
    return sizes, at


def demuxed(data: bytes | None) -> dict:
    """A file as codec, clusters, cues and packets; ``error`` says where it broke off.

    What was read before a fault is kept. Null or empty bytes have no packets
    and the error ``empty``.
    """
    out = {"codec": None, "error": None, "clusters": [], "cues": [], "packets": []}
    if not data:
        return {**out, "error": "empty"}
    scale, durations = 1_000_000, {}

    def block(a: int, b: int, time: int, key: bool | None) -> None:
        track, _, at = read_vint(data, a, b)
        if at + 3 > b:
            raise Broken(f"block at {a} is cut short")
        relative, flags = struct.unpack(">hB", data[at : at + 3])
        lacing = flags >> 1 & 3
        sizes, at = frame_sizes(data, at + 3, b, lacing)
        keyframe = bool(flags & 0x80) if key is None else key
        for i, size in enumerate(sizes):
            out["packets"].append(
                {"track": track, "timestamp_ns": (time + relative) * scale + i * durations.get(track, 0),
                 "offset": at, "size": size, "lacing": lacing, "keyframe": keyframe}
            )
            at += size

    try:
        for name, _, a, b in elements(data, 0, len(data)):
            if name != SEGMENT:
                continue
            segment = a
            for name, place, a, b in elements(data, a, b):
                if name == INFO:
                    for inner, _, c, d in elements(data, a, b):
                        scale = _uint(data, c, d) if inner == SCALE else scale
                elif name == TRACKS:
                    for inner, _, c, d in elements(data, a, b):
                        if inner == TRACK:
                            own = {x: (e, f) for x, _, e, f in elements(data, c, d)}
                            track = _uint(data, *own.get(NUMBER, (0, 0)))
                            durations[track] = _uint(data, *own.get(DURATION, (0, 0)))
                            codec = data[slice(*own.get(CODEC, (0, 0)))].decode("ascii", "replace")
                            out["codec"] = codec if out["codec"] is None else f"{out['codec']},{codec}"
                elif name == CLUSTER:
                    out["clusters"].append(place - segment)
                    time = 0
                    for inner, _, c, d in elements(data, a, b, TOP):
                        if inner == TIME:
                            time = _uint(data, c, d)
                        elif inner == SIMPLE_BLOCK:
                            block(c, d, time, None)
                        elif inner == GROUP:
                            own = [(x, e, f) for x, _, e, f in elements(data, c, d)]
                            plain = all(x != 0xFB for x, *_ in own)  # refers to no other block
                            for x, e, f in own:
                                if x == BLOCK:
                                    block(e, f, time, plain)
                elif name == CUES:
                    for inner, _, c, d in elements(data, a, b):
                        own = list(elements(data, c, d)) if inner == CUE else []
                        when = next((_uint(data, e, f) for x, _, e, f in own if x == CUE_TIME), 0)
                        for x, _, e, f in own:
                            if x == CUE_PLACES:
                                at = {y: _uint(data, g, h) for y, _, g, h in elements(data, e, f)}
                                out["cues"].append({"time": when, "track": at.get(CUE_TRACK), "cluster": at.get(CUE_CLUSTER)})
    except Broken as fault:
        out["error"] = str(fault)
    return out


def padded_payload(text: Column, frame: int = FRAME) -> Column:
    """The text's UTF-8 with bytes 255 up to a positive multiple of ``frame``; null is empty."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        rows = (t or b"" for t in texts.cast(pa.binary()).to_pylist())
        return pa.array([t + b"\xff" * (-len(t) % frame if t else frame) for t in rows], pa.binary())

    return run(text)


def media(payload: Column, lacing: int = 2) -> Column:
    """Files that hold the payloads (null: empty, so no cluster)."""

    @F.arrow_udf("binary")
    def run(payloads: pa.Array) -> pa.Array:
        return pa.array([muxed(p or b"", lacing) for p in payloads.to_pylist()], pa.binary())

    return run(payload)


def parsed(files: Column) -> Column:
    """Files as ``PARSED``; see :func:`demuxed`."""

    @F.arrow_udf(PARSED)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([demuxed(f) for f in column.to_pylist()], _PARSED)

    return run(files)


def samples(files: Column, packets: Column) -> Column:
    """The bytes of all packets in order, read from the files by offset and size."""

    @F.arrow_udf("binary")
    def run(column: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array(
            [
                b"".join(f[p["offset"] : p["offset"] + p["size"]] for p in own or ()) if f is not None else None
                for f, own in zip(column.to_pylist(), ranges.to_pylist())
            ],
            pa.binary(),
        )

    return run(files, packets)


def packet_table(df: DataFrame, id_col: str, files: str) -> DataFrame:
    """One row per packet: the id, its number in the file, and what ``PARSED`` says of it."""
    found = df.select(df[id_col], parsed(df[files])["packets"].alias("_packets"))
    return found.select(id_col, F.posexplode("_packets").alias("packet", "_p")).select(id_col, "packet", "_p.*")

import random

import pytest
from pyspark.sql import functions as F

from rulesieve.llm import matroska as mk
from tests.llm.conftest import plain


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_round_trip(lacing):
    rng = random.Random(lacing)
    for size in (0, 1, 575, 576, 577, 576 * 8 * 32, 576 * 8 * 32 + 1, 300_000):
        payload = rng.randbytes(size)
        if lacing == 2:
            payload = payload[: len(payload) // 576 * 576]
        data = mk.muxed(payload, lacing) if lacing else mk.muxed(payload[:576], 2)
        found = mk.demuxed(data)
        assert found["error"] is None and found["codec"] == "A_PCM/INT/LIT"
        assert b"".join(data[p["offset"] : p["offset"] + p["size"]] for p in found["packets"]) == (payload if lacing else payload[:576])
        assert [p["timestamp_ns"] for p in found["packets"]] == [i * 72_000_000 for i in range(len(found["packets"]))]
        assert [c["cluster"] for c in found["cues"]] == found["clusters"]


@pytest.mark.parametrize("sizes", [[1], [300, 10, 700], [0, 0, 5], [70_000, 1, 70_000, 255, 256], [127] * 9])
@pytest.mark.parametrize("lacing", [1, 3])
def test_lacing_of_uneven_frames(sizes, lacing):
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    block = mk.laced(frames, lacing)
    got, at = mk.frame_sizes(block, 0, len(block), lacing)
    assert got == sizes and block[at:] == b"".join(frames)


def test_groups_unknown_sizes_and_tracks():
    """A live file: segment and clusters of unknown size, block groups, two tracks, a void element."""
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    track = lambda n, codec: mk.element(mk.TRACK, mk.number(mk.NUMBER, n) + mk.element(mk.CODEC, codec))
    tracks = mk.element(mk.TRACKS, track(1, b"V_X") + track(200, b"A_Y"))
    simple = mk.element(mk.SIMPLE_BLOCK, b"\x81\xff\xff\x80abc")  # one tick before the cluster
    group = mk.element(mk.GROUP, mk.element(mk.BLOCK, b"\x40\xc8\x00\x05\x00de") + mk.number(0xFB, 1))
    cluster = lambda t: (mk.CLUSTER).to_bytes(4, "big") + unknown + mk.number(mk.TIME, t) + simple + group
    data = mk.element(mk.EBML, b"") + (mk.SEGMENT).to_bytes(4, "big") + unknown + mk.element(0xEC, b"\0\0") + tracks + cluster(10) + cluster(20)
    found = mk.demuxed(data)
    assert found["error"] is None and found["codec"] == "V_X,A_Y" and len(found["clusters"]) == 2
    got = [(p["track"], p["timestamp_ns"] // 1_000_000, data[p["offset"] : p["offset"] + p["size"]], p["keyframe"]) for p in found["packets"]]
    assert got == [(1, 9, b"abc", True), (200, 15, b"de", False), (1, 19, b"abc", True), (200, 25, b"de", False)]


def test_broken_files_keep_what_was_read():
    data = mk.muxed(b"x" * 576 * 8 * 40)
    for cut in (3, 50, 200, len(data) // 2, len(data) - 1):
        assert mk.demuxed(data[:cut])["error"]
    rng = random.Random(0)
    for _ in range(300):
        noise = bytearray(data[:900])
        for _ in range(5):
            noise[rng.randrange(900)] = rng.randrange(256)
        mk.demuxed(bytes(noise))  # no crash
    assert mk.demuxed(None)["error"] == mk.demuxed(b"")["error"] == "empty"


def read_back(df):
    files = df.withColumn("media", mk.media(mk.padded_payload(F.col("text")))).withColumn("file", mk.parsed(F.col("media")))
    return files.withColumn("payload", mk.samples(F.col("media"), F.col("file.packets")))


def test_columns(docs, rows, no_docs, clashing):
    found = read_back(docs).collect()
    want = []
    for _, t, *_ in rows:
        raw = (t or "").encode()
        want.append(raw + b"\xff" * (-len(raw) % 576 if raw else 576))
    assert sorted(bytes(r["payload"]) for r in found) == sorted(want)
    assert read_back(no_docs).collect() == []
    keep = ["doc_id", "media", "payload"]
    assert plain(read_back(clashing(docs)).select(keep)) == plain(read_back(docs).select(keep))
    table = mk.packet_table(read_back(docs).select("doc_id", "media"), "doc_id", "media")
    assert table.count() == sum(len(w) // 576 for w in want)


def test_null_files(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"no file"))], "doc_id long, media binary")
    assert mk.packet_table(df, "doc_id", "media").count() == 0
    found = {r["doc_id"]: r["p"] for r in df.select("doc_id", mk.samples(F.col("media"), mk.parsed(F.col("media"))["packets"]).alias("p")).collect()}
    assert found == {1: None, 2: b""}

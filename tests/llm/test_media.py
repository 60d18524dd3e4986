"""ISO media: exact round trips, nested boxes, and features."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import media, queries
from tracewell.llm.shared import table


@pytest.mark.parametrize("frames", [1, 2, 63, 64, 65, 200, 1024])
def test_round_trip(frames):
    payload = bytes(i * 7 % 251 for i in range(576 * frames))
    data = media.mux(payload)
    (t,) = media.tracks(data)
    assert media.demux(data, t) == payload
    assert (t["codec"], t["handler"], t["timescale"], t["duration"]) == ("raw ", "soun", 48000, 576 * frames)
    assert t["times"].tolist() == [576] * frames
    for k in t["sync"]:
        assert data[t["offsets"][k] :][:576] == payload[576 * k :][:576]
    assert t["sync"].tolist() == list(range(0, frames, 16))


def test_other_files():
    """Tables of single sizes and 32-bit offsets, boxes with 64-bit sizes or up to the end, and unknown boxes."""
    samples = [b"abc", b"", b"defgh", b"i"]
    stbl = media.box(b"stbl", media.full(b"stsz", struct.pack(">II4I", 0, 4, *map(len, samples))), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)), media.full(b"stco", struct.pack(">III", 2, 24, 34)), media.full(b"stts", struct.pack(">III", 1, 4, 10)))
    moov = media.box(b"moov", media.box(b"free", bytes(5)), media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + 8 + 8 + 2 + 1) + bytes(8) + b"abcdefgh" + b"??" + b"i" + moov[:0]
    data = data + struct.pack(">I4s", 0, b"moov") + moov[8:]
    (t,) = media.tracks(data)
    assert media.demux(data, t) == b"abcdefghi"
    assert t["sync"].tolist() == [0, 1, 2, 3]
    for cut in range(0, len(data), 7):
        for t in media.tracks(data[:cut]):
            media.demux(data[:cut], t)


def test_counts_beyond_the_file():
    """Every four bytes of a file set to large, small and negative numbers, within bounded memory."""
    import resource

    payload = bytes(range(256)) * 27
    data = media.mux(payload[: 576 * 12], keyframe_every=4, chunk_frames=5)
    soft, hard = resource.getrlimit(resource.RLIMIT_AS)
    used = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
    resource.setrlimit(resource.RLIMIT_AS, (used + (256 << 20), hard))
    try:
        head = len(data) - 576 * 12
        for at in range(0, head, 1):
            for value in (b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff", b"\0\0\0\0", b"\0\0\0\1", b"\0\1\0\0"):
                broken = data[:at] + value + data[at + 4 :]
                for t in media.tracks(broken):
                    assert len(media.demux(broken, t)) == t["sizes"].sum() <= len(broken)
                    assert len(t["times"]) <= len(t["sizes"]) and (t["offsets"] >= 0).all()
    finally:
        resource.setrlimit(resource.RLIMIT_AS, (soft, hard))


def test_compact_sizes_and_fragments():
    sizes = [3, 0, 5, 1]
    for width, table in ((4, bytes([0x30, 0x51])), (8, bytes(sizes)), (16, struct.pack(">4H", *sizes))):
        stbl = media.box(b"stbl", media.full(b"stz2", bytes([0, 0, 0, width]), struct.pack(">I", 4), table), media.full(b"stsc", struct.pack(">IIII", 1, 1, 4, 1)), media.full(b"stco", struct.pack(">II", 1, 8)))
        data = media.box(b"mdat", b"abcdefghi") + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"hdlr", bytes(4), b"vide"), media.box(b"minf", stbl)))) + media.box(b"moof")
        (t,) = media.tracks(data)
        assert media.demux(data, t) == b"abcdefghi" and t["sizes"].tolist() == sizes
        assert t["fragmented"] and t["handler"] == "vide"


def test_mux_rejects_partial_frames():
    for bad in (b"", b"x" * 575):
        with pytest.raises(ValueError):
            media.mux(bad)


def test_columns(spark):
    df = spark.createDataFrame([(1, "abc", "m"), (2, None, "m"), (3, "", None), (None, "é" * 288, "m"), (5, "x" * 100_000, "m"), (1, "abc", "m")], "doc_id long, text string, media string")
    out = media.with_media(df, F.col("text"))
    assert out.columns == df.columns
    got = {(r["doc_id"], r["text"]): r for r in out.select("doc_id", "text", "media", media.probe(F.col("media")).alias("i")).collect()}
    for (_, text), r in got.items():
        data = (text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (r["i"]["payload_sha256"], r["i"]["tail_crc32"], r["i"]["payload_bytes"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload))
        assert r["i"]["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        first = r["i"]["keyframes"][0]
        assert bytes(r["media"])[first["start"] : first["end"]] == payload[:576]
    broken = spark.createDataFrame([(b"",), (None,), (b"junk" * 9,)], "media binary").select(media.probe(F.col("media")).alias("i")).collect()
    assert {(r["i"]["codec"], r["i"]["n_samples"]) for r in broken} == {("", 0)}
    assert media.with_media(df.limit(0), F.col("text")).collect() == []


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op7_media(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for k, data in docs.items():
        payload = media.padded(data)
        file = media.mux(payload)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert r["feature"].startswith(f"raw/soun;{len(payload) / 48000:.6f}s;{len(payload) // 576};")

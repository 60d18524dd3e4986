"""Media columns in ISO base media containers.

`mux` stores bytes losslessly as 8-bit samples of a raw track; `probe` walks the boxes of any such file and reads its sample
tables. Payloads are never decoded: a sample is a byte range."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts_of

FRAME = 576  # bytes, and samples, of a frame
RATE = 48_000
#: Fixed values of the format: boxes that hold boxes, with the bytes of their own fields before those.
NESTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE, keyframe_every: int = 16, chunk_frames: int = 64) -> bytes:
    """A file with one audio track of codec "raw " (8-bit unsigned mono), `frame` payload bytes to a sample; every
    keyframe_every-th sample is marked as a sync sample. The payload must be a positive multiple of `frame` bytes."""
    n, rest = divmod(len(payload), frame)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the frame")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    ticks = n * frame
    chunks = -(-n // chunk_frames)
    last = n - (chunks - 1) * chunk_frames
    runs = [(1, chunk_frames if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != chunk_frames else [])
    sync = range(1, n + 1, keyframe_every)

    def moov(first: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
        offsets = [first + k * chunk_frames * frame for k in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, frame)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", frame, n)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        data = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, ticks & 0xFFFFFFFF, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), data, table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), MATRIX, bytes(8), flags=7), media)
        head = full(b"mvhd", struct.pack(">IIII", 0, 0, rate, ticks & 0xFFFFFFFF), struct.pack(">IHH", 0x10000, 256, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, track)

    first = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return b"".join((ftyp, moov(first), box(b"mdat", payload)))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end of the content) of every box in data[start:end], outer boxes first. Sizes of 0 (to the end) and 1
    (64 bits) are known; a box that would pass the end of the one around it ends the walk there."""
    stack = [(start, end, ())]
    while stack:
        at, end, path = stack.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            continue
        own = (*path, kind)
        yield own, at + head, at + size
        stack.append((at + size, end, path))
        if kind in NESTS:
            stack.append((at + head + NESTS[kind], at + size, own))


def numbers(data: memoryview, at: int, end: int, kind: str, n: int) -> np.ndarray:
    """n numbers of a table, fewer if the box ends before."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, max(0, min(n, (end - at) // size)), at).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """For each track: handler, codec, timescale, duration (ticks), and its samples' byte offsets, sizes, durations and the
    numbers, from 0, of its sync samples (all, if it has no table of those). Samples of movie fragments aren't read: a file
    that has some is told by `fragmented` on each track."""
    view, out, fragmented = memoryview(data), [], False
    for path, at, end in walk(view, 0, len(view)):
        kind = path[-1]
        fragmented |= kind == b"moof"
        if kind == b"trak":
            out.append({"handler": "", "codec": "", "timescale": 0, "duration": 0})
        if not out or b"trak" not in path:
            continue
        t = out[-1]
        if kind == b"hdlr" and end - at >= 12 and path[-2] == b"mdia":
            t["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"mdhd" and end - at >= 24:
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if view[at] else ">II", view, at + (20 if view[at] else 12)) if not view[at] or end - at >= 32 else (0, 0)
        elif kind == b"stsd" and end - at >= 16:
            t["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stsz" and end - at >= 12:
            size, n = struct.unpack_from(">II", view, at + 4)
            t["sizes"] = np.full(min(n, len(view) // size), size, np.int64) if size else numbers(view, at + 12, end, ">u4", n)
        elif kind == b"stz2" and end - at >= 12:
            n, width = struct.unpack_from(">I", view, at + 8)[0], view[at + 7]
            if width in (8, 16):
                t["sizes"] = numbers(view, at + 12, end, f">u{width // 8}", n)
            elif width == 4:
                pairs = numbers(view, at + 12, end, "u1", (n + 1) // 2)
                t["sizes"] = np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n]
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64") and end - at >= 8:
            width = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            n = struct.unpack_from(">I", view, at + 4)[0] * width
            t[kind.decode()] = numbers(view, at + 8, end, ">u8" if kind == b"co64" else ">u4", n)
    for t in out:
        lay_out(t, len(view))
        t["fragmented"] = fragmented
    return out


def lay_out(t: dict, file_bytes: int) -> None:
    """Offsets, sizes, times and sync samples of a track from its tables. Counts are taken from the file, so nothing is
    expanded before it is held to what the file can have: samples to the chunks' own and to the table of sizes, chunks to the
    table of offsets. Samples end before the first that doesn't lie in the file, or with which they would be larger than it."""
    nothing = np.zeros(0, np.int64)
    sizes, chunk = t.get("sizes", nothing), t.get("co64", t.get("stco", nothing))
    runs = t.get("stsc", nothing)
    runs = runs[: len(runs) // 3 * 3].reshape(-1, 3)
    begin = np.maximum.accumulate(np.append(runs[:, 0] - 1, len(chunk)).clip(0, len(chunk)))
    per = np.zeros(len(chunk), np.int64)
    per[begin[0] :] = np.repeat(runs[:, 1], np.diff(begin))
    stops = np.minimum(np.cumsum(np.minimum(per, len(sizes))), len(sizes))
    n = int(stops[-1]) if len(stops) else 0
    owner, sizes = np.searchsorted(stops, np.arange(n), side="right"), sizes[:n]
    before = np.cumsum(sizes) - sizes
    firsts = np.minimum(np.concatenate([[0], stops[:-1]]), max(0, n - 1)).astype(np.int64)
    offsets = chunk[owner] + before - before[firsts[owner]] if n else nothing
    bad = np.flatnonzero((offsets < 0) | (offsets > file_bytes - sizes) | (before > file_bytes - sizes))
    n = int(bad[0]) if len(bad) else n
    stts = t.get("stts", nothing)
    stts = stts[: len(stts) // 2 * 2].reshape(-1, 2)
    until = np.minimum(np.cumsum(np.minimum(stts[:, 0], n)), n)
    sync = t["stss"] - 1 if "stss" in t else np.arange(n)
    t["offsets"], t["sizes"] = offsets[:n], sizes[:n]
    t["times"] = np.repeat(stts[:, 1], np.diff(until, prepend=0))
    t["sync"] = sync[(sync >= 0) & (sync < n)]


def demux(data: bytes, track: dict) -> bytes:
    """The track's samples, in order, as they are stored."""
    at, end = track["offsets"], track["offsets"] + track["sizes"]
    if not len(at):
        return b""
    cut = np.flatnonzero(at[1:] != end[:-1])  # neighbours in the file are read as one range
    starts, ends = at[np.concatenate([[0], cut + 1])], end[np.concatenate([cut, [len(end) - 1]])]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def padded(data: bytes, unit: int = FRAME) -> bytes:
    return data + b"\xff" * (-len(data) % unit if data else unit)


def with_media(df: DataFrame, data: Column, name: str = "media") -> DataFrame:
    """df with a binary column of ISO media that stores `data` (text or bytes; null: empty), padded by bytes 255 to a
    positive multiple of a frame. A column of that name is replaced. Equal data give equal media."""
    small_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([mux(padded(x)) for x in texts_of(column).cast(pa.binary()).to_pylist()], pa.binary())

    return df.withColumn(name, run(data.cast("string")))


MEDIA = "struct<tracks int, fragmented boolean, codec string, handler string, timescale long, duration_s double, n_samples long, keyframes array<struct<start long, end long>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long>"


NO_TRACK = {"codec": "", "handler": "", "timescale": 0, "duration": 0, "fragmented": False, **{k: np.zeros(0, np.int64) for k in ("sizes", "offsets", "sync")}}


def probe(media: Column, tail: int = 32, handler: str | None = None) -> Column:
    """Struct of the first track of ISO media, or of the first with the named handler ("vide", "soun"): number of tracks,
    whether there are movie fragments (whose samples aren't read), codec, handler, timescale, duration in seconds, samples,
    the byte range of each keyframe in the file, digests of the file and of the track's samples, and the CRC of the samples'
    last bytes.

    Null, empty or broken media, or none of that handler, give codec '' and no samples. A file that ends early, or whose
    tables name more than it holds, gives the samples before the first that doesn't lie in it. Memory is bounded by a small
    multiple of the file, whatever its tables say."""

    @F.arrow_udf(MEDIA)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = []
            for data in column.to_pylist():
                data = data or b""
                found = tracks(data)
                t = next((x for x in found if handler in (None, x["handler"])), NO_TRACK)
                payload = demux(data, t)
                starts = t["offsets"][t["sync"]]
                ranges = [{"start": a, "end": b} for a, b in zip(starts.tolist(), (starts + t["sizes"][t["sync"]]).tolist(), strict=True)]
                rows.append({"tracks": len(found), "fragmented": t["fragmented"], "codec": t["codec"], "handler": t["handler"], "timescale": t["timescale"], "duration_s": t["duration"] / t["timescale"] if t["timescale"] else 0.0, "n_samples": len(t["sizes"]), "keyframes": ranges, "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-tail:])})
            yield pa.array(rows, pa.struct([("tracks", pa.int32()), ("fragmented", pa.bool_()), ("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]))

    return run(media)


def feature(info: Column) -> Column:
    """Codec, duration and keyframe ranges in one line of text: codec/handler, seconds, samples, keyframes, and the digest
    of all keyframe ranges."""
    ranges = F.sha2(F.array_join(F.transform(info["keyframes"], lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ","), 256)
    return F.concat_ws(";", F.concat(F.trim(info["codec"]), F.lit("/"), info["handler"]), F.format_string("%.6fs", info["duration_s"]), info["n_samples"].cast("string"), F.size(info["keyframes"]).cast("string"), F.substring(ranges, 1, 16))

"""BPE encoding by content-defined chunks, and decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .distinct import answer, bucket_count, bundles, pack_numbers, unpack, unpack_numbers
from .shared import by_bytes, small_batches, texts_of
from .units import UnitEncoder, encoder, gather

#: Bytes that the rolling hash sees; a power of two.
WINDOW = 16
LEVEL = 6  # of compression of what is moved: chunks and ids weigh more than the time to compress them
MULTIPLIER = np.uint32(0x9E3779B1)


def chunk_ends(data: np.ndarray, mean: int = 1024) -> np.ndarray:
    """Places after which content alone, not position, cuts: the polynomial hash of the WINDOW bytes before them has no
    bits under `mean`, a power of two. Only starts of UTF-8 characters are places. The hash of 2k bytes is made of those
    of k, so whole buffers are hashed by a few vector operations."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    h, power, span = (data.astype(np.uint32) + 1) * MULTIPLIER, MULTIPLIER, 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] * power).astype(np.uint32)
        power, span = np.uint32(int(power) ** 2 & 0xFFFFFFFF), span * 2
    ends = np.flatnonzero((h[WINDOW - 1 :] >> np.uint32(7)) & np.uint32(mean - 1) == 0) + WINDOW
    ends = ends[ends < len(data)]
    return ends[(data[ends] & 0xC0) != 0x80]


def cut_texts(texts: pa.Array, mean: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(chunks of each text, the chunk at each place as its row of the distinct ones, distinct chunks); an empty text has none."""
    texts = pa.concat_arrays([texts])
    at = np.asarray(pa.Array.from_buffers(pa.int32(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset)).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    ends = np.union1d(at, chunk_ends(data, mean))
    chunks = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)) if len(ends) > 1 else pa.array([], pa.string())
    coded = chunks.dictionary_encode()
    owner = np.searchsorted(at, ends[:-1], side="right") - 1
    return np.bincount(owner, minlength=len(texts)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


#: An encoded chunk: bytes of its head, tail, first and last closed unit; ids of those two units; 1 if it has no cut.
PARTS = struct.Struct("<IIIIIIB")


def encode_chunks(units: UnitEncoder, chunks: list[bytes]) -> list[bytes]:
    """Each chunk on its own: its head and tail, the open units before the first and after the last safe cut, as text; the
    units between, which are closed, as ids. The first and the last closed unit are also given as text."""
    lists = units.cut(pa.array(chunks, pa.binary()).cast(pa.string()))
    off, values = np.asarray(lists.offsets).astype(np.int64), lists.flatten()
    n = np.diff(off)
    inner = np.ones(len(values), bool)
    inner[off[:-1]] = inner[off[1:] - 1] = False
    body = values.filter(pa.array(inner)).dictionary_encode()
    first = np.concatenate([[0], np.cumsum(np.maximum(n - 2, 0))])
    table, row = units.table(body.dictionary), body.indices.to_numpy(zero_copy_only=False)
    at, ids = gather(table, row, first)
    sizes = np.diff(np.asarray(table.offsets)).astype(np.int64)[row]
    ids = ids.astype(units.id_type)
    text = values.cast(pa.binary())
    pick = lambda places: text.take(pa.array(places)).to_pylist()
    heads, tails = pick(off[:-1]), pick(off[1:] - 1)
    closed = n > 2
    begin, end = pick(np.where(closed, off[:-1] + 1, off[:-1])), pick(np.where(closed, off[1:] - 2, off[:-1]))
    out = []
    for k in range(len(n)):
        if closed[k]:
            b, e, x, y = begin[k], end[k], int(sizes[first[k]]), int(sizes[first[k + 1] - 1])
        else:
            b, e, x, y = b"", b"", 0, 0
        head, tail, single = heads[k], tails[k], int(n[k] == 1)
        out.append(b"".join((PARTS.pack(len(head), len(tail), len(b), len(e), x, y, single), head, tail, b, e, ids[at[k] : at[k + 1]].tobytes())))
    return out


class Encoded:
    """A chunk as encode_chunks() gives it."""

    def __init__(self, data: bytes, id_type: str):
        h, t, b, e, x, y, self.single = PARTS.unpack_from(data)
        at = PARTS.size
        self.head, self.tail, self.first, self.last = data[at : at + h], data[at + h : at + h + t], data[at + h + t : at + h + t + b], data[at + h + t + b : at + h + t + b + e]
        self.ids = np.frombuffer(data, id_type, -1, at + h + t + b + e) if len(data) > at + h + t + b + e else np.zeros(0, id_type)
        self.first_ids, self.last_ids = self.ids[:x], self.ids[len(self.ids) - y :]


def join_chunks(units: UnitEncoder, counts: np.ndarray, which: np.ndarray, chunks: list[Encoded]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of texts made of so many chunks each.

    A cut may fall inside a token, or between two that would merge. So the open units on both sides of a cut are put
    together, over as many chunks as it takes to reach a safe cut on either side, and encoded again by the library in one
    stretch with the closed unit that stands on each side. The new ids must begin and end with those that the chunks have
    for these two units: then both sides agree exactly, and what lies between is the repair. A text is an open unit, a
    chunk's body, an open unit, ... , an open unit."""
    space = b" " if units.kind == "spaced" else b""
    joints: dict[tuple, int] = {}
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    order: list[int] = []  # a chunk's number, or -1 - a joint's

    def close(left: Encoded | None, parts: list[bytes], right: Encoded | None) -> None:
        before, after = left.last if left is not None and len(left.ids) else None, right.first if right is not None and len(right.ids) else None
        key = (left is None, before, b"".join(parts), after)
        if key not in joints:
            joints[key] = len(joints)
            edges.append((left.last_ids if before is not None else NONE, right.first_ids if after is not None else NONE))
        order.append(-1 - joints[key])

    sizes, at, places = [], 0, which.tolist()
    for n in counts.tolist():
        left, parts, size = None, [], 1
        for k in places[at : at + n]:
            c = chunks[k]
            parts.append(c.head)
            if not c.single:
                close(left, parts, c)
                order.append(k)
                left, parts, size = c, [c.tail], size + 2
        close(left, parts, None)
        sizes.append(size)
        at += n
    windows = []
    for first, before, opened, after in joints:
        windows.append(((b"" if first else space) if before is None else space + before + b" ") + opened + (b"" if after is None else b" " + after))
    repaired = []
    for ids, (x, y) in zip(units.by_library([w.decode() for w in windows]), edges, strict=True):
        ids = ids.values.to_numpy()
        if len(ids) < len(x) + len(y) or (ids[: len(x)] != x).any() or (ids[len(ids) - len(y) :] != y).any():
            raise ValueError("a repaired join doesn't agree with its chunks: this file has no safe cuts at single spaces")
        repaired.append(ids[len(x) : len(ids) - len(y)])
    tables = [c.ids for c in chunks] + repaired
    off = np.concatenate([[0], np.cumsum([len(x) for x in tables])])
    table = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(np.concatenate(tables).astype(np.int32) if tables else NONE.astype(np.int32)))
    row = np.array(order, np.int64)
    return gather(table, np.where(row < 0, len(chunks) - 1 - row, row), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


NONE = np.zeros(0, np.int64)


class ChunkEncoder:
    """Encodes texts of one block chunk by chunk: what encode_documents does over a table."""

    def __init__(self, units: UnitEncoder, mean: int = 1024):
        self.units, self.mean = units, mean

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text k has ids[offsets[k]:offsets[k + 1]]. A file without safe cuts is encoded text by text."""
        if self.units.kind == "whole":
            return self.units.encode(texts)
        counts, which, distinct = cut_texts(texts, self.mean)
        chunks = [Encoded(x, self.units.id_type) for x in encode_chunks(self.units, distinct.cast(pa.binary()).to_pylist())]
        return join_chunks(self.units, counts, which, chunks)


def decode_ids(units: UnitEncoder, lists: pa.ListArray) -> pa.Array:
    """Texts of lists of ids as the library's decode(ids, skip_special_tokens=False) gives them."""
    if units.library.decoder is None:  # then tokens, as they are written in the vocabulary, joined by a space
        off = np.asarray(lists.offsets).astype(np.int32)
        tokens = units.vocabulary.take(lists.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(off - off[0]), tokens), " ")
    return pa.array(units.library.decode_batch(lists.to_pylist(), skip_special_tokens=False), pa.string())


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mean_chunk: int = 1024) -> DataFrame:
    """id_col, ids array<int>, decoded string: the ids of each whole text by the tokenizer file at `path`, without added
    special tokens, and the text that they decode to.

    One row per input row, repeated rows included; a null text counts as empty: no ids, decoded to ''. An empty table
    gives an empty one. Only the two named columns are read, so others can't clash.

    Each block of texts is cut where content says so (a rolling hash) and asks for its distinct chunks. Each distinct chunk of
    the table is encoded once (distinct.py); its ids return to the blocks, where the joins are repaired. Two shuffles move
    compressed chunks and ids. A file whose cuts aren't known to be safe (another normalizer or pattern than the two that
    units.py knows) is encoded text by text in its task, without chunks."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = f"id {kind}, ids array<int>, decoded string"

    def decoded(units: UnitEncoder, ids: pa.Array, off: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), 1000):  # smaller batches, as the ids and two texts of each row are held
            part = off[at : at + 1001]
            lists = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(flat[part[0] : part[-1]]))
            yield pa.RecordBatch.from_arrays([ids[at : at + 1000], lists, decode_ids(units, lists)], ["id", "ids", "decoded"])

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in by_bytes(texts, 8 << 20):
                yield from decoded(units, batch.column(0)[a:b], *units.encode(texts[a:b]))

    if encoder(path).kind == "whole":
        return rows.mapInArrow(one_by_one, schema).withColumnRenamed("id", id_col)
    buckets = bucket_count(df, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in by_bytes(texts):
                counts, which, chunks = cut_texts(texts[a:b], mean_chunk)
                place, asked = bundles(chunks, buckets, LEVEL)
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0)[a:b])
                for bucket, data, own in ((-1, pack_numbers(counts, place[which]), ids), *((k, x, pa.nulls(1, ids.type)) for k, x in asked)):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), own], ["block", "bucket", "data", "ids"])
                block += 1

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held = encoder(path), None

        def close() -> Iterator[pa.RecordBatch]:
            ids, data, parts = held
            counts, which = unpack_numbers(data)
            yield from decoded(units, ids, *join_chunks(units, counts, which, [Encoded(x, units.id_type) for part in parts for x in unpack(part).to_pylist()]))

        for batch in batches:
            for bucket, data, ids in zip(batch.column("bucket").to_pylist(), batch.column("data"), batch.column("ids"), strict=True):
                if bucket < 0:
                    if held:
                        yield from close()
                    held = ids.values, data.as_py(), []
                else:
                    held[2].append(data.as_py())
        if held:
            yield from close()

    asked = rows.mapInArrow(cut, f"block long, bucket int, data binary, ids array<{kind}>")
    return answer(asked, buckets, lambda keys: encode_chunks(encoder(path), keys), LEVEL).mapInArrow(assemble, schema).withColumnRenamed("id", id_col)

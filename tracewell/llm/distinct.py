"""Work done once for each distinct key of a whole table, with the answers brought back to the blocks that asked.

A block is a slice of a task's rows. It asks for each of its distinct keys once, in bundles: one for every bucket, which
is a hash of the key. A bundle is one row with all its keys compressed, so two shuffles (to the buckets, and back to the
blocks) move a few large rows. A key that a third of all texts hold is asked for once by a block: no bucket is hot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text for which there is a bucket: the answers to a bucket's keys are held by one task.
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 32


def bucket_count(df: DataFrame, text_col: str) -> int:
    return max(LEAST_BUCKETS, -(-(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // BUCKET_BYTES))


def pack(items: pa.Array, level: int = 1) -> bytes:
    """Strings or binaries as one piece, compressed at a level of zstandard."""
    import zstandard

    items = pa.concat_arrays([items.cast(pa.binary())])
    sizes = pc.binary_length(items).to_numpy(zero_copy_only=False).astype("<u4")
    data = items.buffers()[2]
    return zstandard.ZstdCompressor(level).compress(b"".join((np.array([len(sizes)], "<u4").tobytes(), sizes.tobytes(), data.to_pybytes()[: int(sizes.sum(dtype=np.int64))] if data else b"")))


def unpack(data: bytes) -> pa.BinaryArray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[4 + 4 * n :])])


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 to 2**32 - 1."""
    return pack(pa.array([np.asarray(c).astype("<u4").tobytes() for c in columns], pa.binary()))


def unpack_numbers(data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4").astype(np.int64) for x in unpack(data).to_pylist()]


def bundles(keys: pa.Array, buckets: int, level: int = 1) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """(place of each key once all are ordered by bucket, the bundles in that order) of distinct keys."""
    from xxhash import xxh3_64_intdigest

    bucket = np.array([xxh3_64_intdigest(k, 42) for k in keys.cast(pa.binary()).to_pylist()], np.uint64) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sorted_keys, which = keys.take(pa.array(order)), bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
    stops = np.append(starts[1:], len(which)) if len(which) else starts
    return place, [(int(which[a]), pack(sorted_keys[a:b], level)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def answer(rows: DataFrame, buckets: int, work: Callable[[list[bytes]], list[bytes]], level: int = 1) -> DataFrame:
    """rows, sorted by block and bucket, in which the data of bundles (bucket from 0) are the packed answers to their keys;
    other rows (bucket -1: a block's own data) pass through. work gets keys that its bucket hasn't had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                bucket = row.column("bucket")[0].as_py()
                if bucket >= 0:
                    if bucket != current:
                        current, known = bucket, {}
                    keys = unpack(row.column("data")[0].as_py()).to_pylist()
                    new = [x for x in keys if x not in known]
                    known.update(zip(new, work(new), strict=True))
                    data = pa.array([pack(pa.array([known[x] for x in keys], pa.binary()), level)], pa.binary())
                    row = row.set_column(row.schema.get_field_index("data"), "data", data)
                yield row

    at = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("block"), F.lit(buckets))).otherwise(F.col("bucket"))
    asked = rows.repartition(at).sortWithinPartitions("bucket")
    return asked.mapInArrow(run, rows.schema).repartition("block").sortWithinPartitions("block", "bucket")

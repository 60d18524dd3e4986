"""Token counts: pieces once per distinct pre-token of the table, joined to each document's pre-token frequencies, summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .distinct import answer, bucket_count, bundles, pack_numbers, unpack, unpack_numbers
from .shared import by_bytes, small_batches, texts_of
from .units import encoder


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes long (of the UTF-8 text), n_tokens long, by the tokenizer file at `path`, without added tokens.

    One row per input row, repeated rows included, whatever their id; a null text counts as empty (0 bytes, 0
    tokens); an empty table gives an empty one. Only the two named columns are read, so others can't clash.

    Each block of texts is turned into its documents' pre-token frequencies and asks for its distinct pre-tokens. Each
    distinct pre-token of the table is counted once (distinct.py), the counts return to the blocks, and are summed there
    by frequency. No ids are kept or moved: a pre-token's answer is a number. Two shuffles move the frequencies, about
    two bytes for a document's distinct pre-token, and the blocks' distinct pre-tokens."""
    small_batches(df.sparkSession)
    buckets = bucket_count(df, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"block long, bucket int, data binary, ids array<{kind}>, n_bytes array<long>"
    names = ["block", "bucket", "data", "ids", "n_bytes"]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, block = encoder(path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in by_bytes(texts):
                ends, piece, times, pieces = coder.frequencies(texts[a:b])
                place, asked = bundles(pieces, buckets)
                sizes = np.diff(ends)
                owner = np.repeat(np.arange(b - a), sizes)
                order = np.argsort(owner << 32 | place[piece])
                piece = place[piece][order]
                step = np.diff(piece, prepend=0)
                step[ends[:-1][sizes > 0]] = piece[ends[:-1][sizes > 0]]  # each document's first pre-token, then steps to the next
                own = [block, -1, pack_numbers(sizes, step, times[order]), batch.column(0)[a:b], pc.binary_length(texts[a:b])]
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), x) for x in (own[3], own[4].cast(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([-1], pa.int32()), pa.array([own[2]], pa.binary()), *lists], names)
                for bucket, data in asked:
                    nothing = [pa.nulls(1, x.type) for x in lists]
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), *nothing], names)
                block += 1

    def sizes_of(keys: list[bytes]) -> list[bytes]:
        return [n.to_bytes(4, "little") for n in encoder(path).piece_sizes([k.decode() for k in keys])]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def close() -> pa.RecordBatch:
            ids, n_bytes, data, parts = held
            sizes, step, times = unpack_numbers(data)
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            total = np.concatenate([[0], np.cumsum(step)])
            first = np.repeat(total[ends[:-1]], sizes)
            counted = np.concatenate([[0], np.cumsum(n[total[1:] - first] * times)])
            return pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(counted[ends[1:]] - counted[ends[:-1]], pa.int64())], ["id", "n_bytes", "n_tokens"])

        for batch in batches:
            bucket, data = batch.column("bucket").to_pylist(), batch.column("data")
            for k, own in enumerate(b < 0 for b in bucket):
                if own:
                    if held:
                        yield close()
                    held = batch.column("ids")[k].values, batch.column("n_bytes")[k].values, data[k].as_py(), []
                else:
                    held[3].append(np.frombuffer(unpack(data[k].as_py()).buffers()[2], "<u4").astype(np.int64))
        if held:
            yield close()

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(frequencies, schema)
    return answer(rows, buckets, sizes_of).mapInArrow(sums, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)

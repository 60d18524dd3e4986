"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


def whole_vectors(vector: Column) -> Column:
    """True for arrays without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


LONG = (1 << 63) - 1


def whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers in float64, inf where that is beyond its range."""
    with np.errstate(over="ignore"):
        return np.floor(rows * scale)


def product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, each under the square root of 2**63 / their number: in float32 or float64 while
    every partial sum is one of its whole numbers, else in 64-bit integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return queries.astype(kind) @ rows.astype(kind).T


def inner(queries: np.ndarray, rows: np.ndarray, scale: int) -> np.ndarray:
    """Exact inner products of floor(scale * x). Vectors whose products might pass 64 bits are
    multiplied as integers without bounds, and held to 2**63 - 1 on either side."""
    a, b = whole(queries, scale), whole(rows, scale)
    limit = np.sqrt(2.0**62 / max(1, a.shape[1]))
    large_a, large_b = (np.abs(x).max(1, initial=0) > limit for x in (a, b))
    if not (large_a.any() or large_b.any()):
        return product(a, b)
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(~large_a, ~large_b)] = product(a[~large_a], b[~large_b])
    exact = lambda x: [[int(c * scale // 1) if abs(c) < 2**53 else int(c) * scale for c in row] for row in x.tolist()]
    for i, j in ((large_a, np.ones(len(b), bool)), (~large_a, large_b)):
        other = exact(rows[j])
        for k, q in zip(np.flatnonzero(i), exact(queries[i]), strict=True):
            out[k, j] = [min(LONG, max(-LONG, sum(x * y for x, y in zip(q, r, strict=True)))) for r in other]
    return out


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of scores the k highest, ties to the smaller id, without the row's own id: (scores, ids)."""
    out = []
    for row, q in zip(scores.astype(np.float64 if scores.dtype != np.int64 else np.int64), own, strict=True):
        places = np.flatnonzero(ids != q)  # first: its id may repeat any number of times
        if len(places) > k:
            others = row[places]
            places = places[others >= np.partition(others, len(others) - k)[len(others) - k]]
        places = places[np.lexsort((ids[places], -row[places]))[:k]]
        out.append((row[places].astype(np.int64), ids[places]))
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, tile: int = 4096, fan_in: int = 16) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score long: for each row of is_query its k best other rows by the
    inner product of floor(scale * x), x as double, all if there are fewer, ties to the smaller id. The products are exact;
    one beyond 2**63 - 1, or below its negative, counts and is ranked as that number.

    Null ids, and vectors that are null or hold null or non-finite components, take no part; vectors are compared with
    those of their own length. Of rows that repeat an id each is a candidate for others, and each of a query's repeats is
    a query of the same name, so results hold the id once for each. An empty table gives an empty one.

    Queries and rows are packed into blocks of up to `tile` vectors. Each query block is sent to every row block of its
    length, a block at a time: a stated query set against all rows. A tile gives at most k rows per query; per-query
    lists are merged in a tree, fan_in tiles at a time."""
    ok = df.where(whole_vectors(F.col(vector_col)) & F.col(id_col).isNotNull())
    ints = ok.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.col(vector_col).cast("array<double>").alias("v"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, {}

        def close(key):
            nonlocal number
            ids, rows = zip(*held.pop(key), strict=True)
            number += 1
            row = [key[0], key[1], (part << 32) + number, np.array(ids, "<i8").tobytes(), np.concatenate(rows).astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["q", "dim", "block", "ids", "rows"])

        for batch in batches:
            flat, off = batch.column(2).flatten().to_numpy(), np.asarray(batch.column(2).offsets)
            for i, (x, q) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                v = flat[off[i] - off[0] : off[i + 1] - off[0]]
                for as_query in (True, False) if q else (False,):
                    held.setdefault(key := (as_query, len(v)), []).append((x, v))
                    if len(held[key]) >= tile:
                        yield close(key)
        for key in list(held):
            yield close(key)

    packed = stored(ints.mapInArrow(blocks, "q boolean, dim int, block long, ids binary, rows binary"))
    rows = packed.where("not q").select("dim", F.col("block").alias("row_block"), F.col("ids").alias("row_ids"), "rows")
    queries = packed.where("q").select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("rows").alias("queries"))
    # Row blocks are dealt to groups by name, and a copy of each query block is sent to each group.
    n_blocks = rows.count()
    groups = max(1, -(-n_blocks // 4))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row_block"), F.lit(groups)))
    tiles = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("group", F.col("group").cast("long")).join(rows, ["dim", "group"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                own, ids = np.frombuffer(t["query_ids"], "<i8"), np.frombuffer(t["row_ids"], "<i8")
                a, b = np.frombuffer(t["queries"], "<f8").reshape(len(own), -1), np.frombuffer(t["rows"], "<f8").reshape(len(ids), -1)
                for at in range(0, len(own), 256):
                    found = select(inner(a[at : at + 256], b, scale), ids, own[at : at + 256], k)
                    off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int32))
                    minus, near = (pa.ListArray.from_arrays(off, pa.array(np.concatenate(x))) for x in ([-s for s, _ in found], [i for _, i in found]))
                    const = lambda x: pa.array([x] * len(found), pa.int64())  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([const(t["query_block"]), pa.array(np.arange(at, at + len(found))), pa.array(own[at : at + 256]), const(t["row_block"]), minus, near], ["query_block", "place", "query_id", "node", "minus", "vec_id"])

    lists = tiles.mapInArrow(score, "query_block long, place long, query_id long, node long, minus array<long>, vec_id array<long>")
    merged = lists.select("query_block", "place", "query_id", "node", F.arrays_zip("minus", "vec_id").alias("best"))
    while n_blocks > 1:  # a tree: fan_in lists of a query become one
        n_blocks = -(-n_blocks // fan_in)
        node = F.pmod(F.xxhash64("node"), F.lit(n_blocks)).alias("node")
        merged = merged.groupBy("query_block", "place", "query_id", node).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))

"""Hard negatives of anchors by threshold joins over vectors with an inverted index bounded by norms.

Each block of rows is indexed by dimension, those of most weight first. A row is left out of the lists of the dimensions at
its end where the norm of that suffix, times the largest anchor norm, stays under the threshold. Partial scores are
accumulated list by list; after each the pairs go whose partial score and the product of their remaining norms stay under
the anchor's threshold, and what the index left out of the others is added from the rows themselves. Thresholds
start high and are lowered, a job each, for the anchors whose windows aren't full yet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .topk import LONG, inner, whole, whole_vectors

#: Dimensions in one step of the accumulation.
STEP = 8
#: Bounds are in floating point; they are taken this much higher.
SLACK = 1 + 1e-9


def tails(rows: np.ndarray) -> np.ndarray:
    """For each row the norm of what is left from each step on; the last is 0."""
    squares = np.add.reduceat(rows**2, np.arange(0, rows.shape[1], STEP), axis=1)
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([left, np.zeros((len(rows), 1))], axis=1))


def pairs(anchors: np.ndarray, rows: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs of whole numbers whose inner product is at least the anchor's bar."""
    by_weight = np.argsort(-(rows**2).sum(0), kind="stable")
    a, b = anchors[:, by_weight], rows[:, by_weight]
    a_left, b_left = tails(a), tails(b)
    # Steps in which a row is indexed: as long as what is left of it could reach the lowest bar by itself.
    indexed = (b_left[:, :-1] * (a_left[:, 0].max() * SLACK) >= bars.min()).sum(1)
    place = np.argsort(-indexed, kind="stable")
    b, b_left, indexed = b[place], b_left[place], indexed[place]
    score, limit = np.zeros((len(a), len(b))), bars[:, None]
    for step in range(int(indexed.max(initial=0))):
        listed, dims = int((indexed > step).sum()), slice(step * STEP, (step + 1) * STEP)
        score[:, :listed] += a[:, dims] @ b[:listed, dims].T
        done = np.minimum(indexed, step + 1)
        alive = ((score + a_left[:, done] * b_left[np.arange(len(b)), done]) * SLACK >= limit).any(0) if bars.min() > 0 else np.ones(len(b), bool)
        if 4 * alive.sum() < 3 * len(b):
            score, b, b_left, indexed, place = score[:, alive], b[alive], b_left[alive], indexed[alive], place[alive]
    i, j = np.nonzero((score + a_left[:, indexed] * b_left[np.arange(len(b)), indexed]) * SLACK >= np.minimum(limit, limit * SLACK**2))
    out = score[i, j]
    rest = np.where(np.arange(b.shape[1]) // STEP < indexed[:, None], 0.0, b)
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] += np.einsum("pd,pd->p", a[i[part]], rest[j[part]])
    keep = out >= bars[i]
    return i[keep], place[j[keep]], out[keep].astype(np.int64)


def exact_pairs(anchors: np.ndarray, rows: np.ndarray, bars: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pairs() of floor(scale * x); of vectors whose products pass 2**53, where floats aren't exact, without an index."""
    a, b = whole(anchors, scale), whole(rows, scale)
    if not a.shape[1] or float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= 2.0**53:
        score = inner(anchors, rows, scale)
        i, j = np.nonzero(score >= bars[:, None])
        return i, j, score[i, j].astype(np.int64)
    return pairs(a, b, bars)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return places[np.lexsort((ids[places], -scores[places]))[:k]]
    return np.lexsort((ids, -scores))


ROWS = "dim int, block long, ids array<long>, labels array<string>, vectors binary"
BEST = "key long, slot int, node long, best array<struct<minus long, id long>>"


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, label, v) packed by length into blocks of up to `size`, written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, {}

        def close(dim):
            nonlocal number
            ids, labels, vectors = zip(*held.pop(dim), strict=True)
            number += 1
            row = [dim, (part << 32) + number, ids, labels, np.concatenate(vectors).astype("<f8").tobytes()]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([list(x) if isinstance(x, tuple) else x], t) for x, t in zip(row, kinds, strict=True)], ["dim", "block", "ids", "labels", "vectors"])

        for batch in batches:
            flat, off = batch.column(2).flatten().to_numpy(), np.asarray(batch.column(2).offsets)
            for k, (x, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                v = flat[off[k] - off[0] : off[k + 1] - off[0]]
                held.setdefault(len(v), []).append((x, label, v))
                if len(held[len(v)]) >= size:
                    yield close(len(v))
        for dim in list(held):
            yield close(dim)

    return stored(rows.select("id", "label", "v").mapInArrow(pack, ROWS))


def window_best(anchors: DataFrame, n_anchors: int, blocks: DataFrame, n_blocks: int, same: bool, k: int, scale: int, fan_in: int = 16) -> DataFrame:
    """key, slot, best: for each window (slot, low, high) of an anchor the k best rows with low <= score <= high and score
    >= the anchor's bar, of the anchor's label (same) or of others, but not of its own id.

    anchors: key, dim, id, label, v, bar, windows. A copy of each bundle of anchors goes to each group of row blocks; a tile
    gives at most k rows for each window, and lists are merged in a tree."""
    groups = max(1, -(-n_blocks // 4))
    rows = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    bundle = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n_anchors // 256)))).alias("bundle")
    bundles = anchors.groupBy("dim", bundle).agg(F.collect_list(F.struct("key", "id", "label", "v", "bar", "windows")).alias("anchors"))
    tiles = bundles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("group", F.col("group").cast("long")).join(rows.hint("merge"), ["dim", "group"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                ids, labels = np.array(t["ids"]), np.array(t["labels"])
                b = np.frombuffer(t["vectors"], "<f8").reshape(len(ids), t["dim"])
                for at in range(0, len(t["anchors"]), 256):
                    part = t["anchors"][at : at + 256]
                    vectors = np.array([x["v"] for x in part], float).reshape(len(part), t["dim"])
                    i, j, s = exact_pairs(vectors, b, np.array([x["bar"] for x in part]), scale)
                    fits = ((labels[j] == np.array([x["label"] for x in part])[i]) == same) & (ids[j] != np.array([x["id"] for x in part])[i])
                    i, j, s = i[fits], j[fits], s[fits]
                    begin = np.searchsorted(i, np.arange(len(part) + 1))
                    out = []
                    for n, x in enumerate(part):
                        own, names = s[begin[n] : begin[n + 1]], ids[j[begin[n] : begin[n + 1]]]
                        for w in x["windows"] if len(own) else ():
                            inside = np.flatnonzero((own >= w["low"]) & (own <= w["high"]))
                            got = inside[first(own[inside], names[inside], k)]
                            if len(got):
                                out.append({"key": x["key"], "slot": w["slot"], "node": t["block"], "best": [{"minus": -m, "id": y} for m, y in zip(own[got].tolist(), names[got].tolist(), strict=True)]})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("node", pa.int64()), ("best", pa.list_(pa.struct([("minus", pa.int64()), ("id", pa.int64())])))]))

    merged = tiles.select("dim", "anchors", "block", "ids", "labels", "vectors").mapInArrow(score, BEST)
    while True:  # a tree: fan_in lists of a window become one
        n_blocks = -(-n_blocks // fan_in)
        node = F.pmod(F.xxhash64("node"), F.lit(max(1, n_blocks))).alias("node")
        merged = merged.groupBy("key", "slot", node).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if n_blocks <= 1:
            return merged.select("key", "slot", "best")


def filled(anchors: DataFrame, blocks: DataFrame, n_blocks: int, same: bool, k: int, scale: int, bars: list[Column]) -> DataFrame:
    """key, slot, best of all windows of the anchors (key, dim, id, label, v, norm, windows), under one bar after another: a
    window is done when it has k rows, or when the bar is at its low end; the last bar must be under all windows.

    What grows with the anchors is joined by merging here and in mine(): a broadcast of it would go through the driver."""
    spark, done, pending = anchors.sparkSession, [], anchors
    for bar in bars:
        pending = stored(pending.withColumn("bar", bar.cast("double")))
        n = pending.count()
        if not n:
            break
        best = stored(window_best(pending, n, blocks, n_blocks, same, k, scale))
        state = pending.select("key", "bar", F.explode("windows").alias("w")).select("key", "w", F.col("w.slot").alias("slot"), (F.col("bar") <= F.col("w.low")).alias("whole"))
        state = state.join(best.hint("merge"), ["key", "slot"], "left").withColumn("full", F.col("whole") | (F.coalesce(F.size("best"), F.lit(0)) >= k))
        done.append(state.where("full and best is not null").select("key", "slot", "best"))
        left = state.where("not full").groupBy("key").agg(F.sort_array(F.collect_list("w")).alias("windows"))
        pending = pending.drop("bar", "windows").join(left.hint("merge"), "key")
    out = spark.createDataFrame([], "key long, slot int, best array<struct<minus long, id long>>")
    for rows in done:
        out = out.unionByName(rows)
    return out


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", k_positive: int = 5, k_negative: int = 5, least_percent: int = 80, scale: int = 256, block: int = 2048) -> DataFrame:
    """anchor_id, positive_id long, rank int (from 1), negative_id, positive_score, negative_score long.

    A score is the inner product of floor(scale * x) of two vectors of one length, exact; beyond 2**63 - 1 it counts as that.
    An anchor's positives are its k_positive best other rows of its label, ties to the smaller id. For each come the
    k_negative best rows of other labels with least_percent / 100 * positive_score <= score <= positive_score; all, if there
    are fewer, and no row for a negative positive_score, whose window is empty.

    Null ids and labels, and vectors that are null or hold null or non-finite components, take no part. Rows of the
    anchor's id aren't its neighbours; of other rows that repeat an id each counts, and each repeat of an anchor is an anchor of its
    own. An empty table gives an empty one; other columns aren't read.

    Thresholds: a half, a quarter and an eighth of the anchor's norm times the largest, then none; for negatives a quarter, a
    half and all of the windows. Only anchors with a window that isn't full go on to the next."""
    ok = df.where(whole_vectors(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = ok.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), is_anchor.alias("anchor"))
    blocks = blocks_of(rows, block)
    n_blocks = blocks.count()
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double")))
    largest = rows.groupBy(F.size("v").alias("dim")).agg(F.max(size).alias("largest"))
    # Keys are fixed by being written.
    anchors = rows.where("anchor").select("id", "label", "v", F.size("v").alias("dim"), size.alias("norm"), F.monotonically_increasing_id().alias("key"))
    anchors = stored(anchors.join(largest, "dim"))
    lowest = F.lit(-LONG).cast("long")
    every = F.array(F.struct(F.lit(0).alias("slot"), lowest.alias("low"), F.lit(LONG).cast("long").alias("high")))
    reach = F.col("norm") * F.col("largest")
    positives = filled(anchors.withColumn("windows", every), blocks, n_blocks, True, k_positive, scale, [reach / 2, reach / 4, reach / 8, F.lit(-float("inf"))])
    positives = stored(positives.select("key", F.posexplode("best").alias("slot", "b")).select("key", "slot", F.col("b.id").alias("positive_id"), (-F.col("b.minus")).alias("positive_score")))
    least = F.expr(f"positive_score - (cast(positive_score as decimal(20, 0)) * {100 - least_percent}) div 100")
    windows = positives.where("positive_score >= 0").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", least.alias("low"), F.col("positive_score").alias("high")))).alias("windows"))
    at = lambda share: F.array_min(F.transform("windows", lambda w: w["high"].cast("double") - (w["high"] - w["low"]).cast("double") * share))
    negatives = filled(anchors.join(windows.hint("merge"), "key"), blocks, n_blocks, False, k_negative, scale, [at(0.25), at(0.5), F.array_min(F.transform("windows", lambda w: w["low"].cast("double")))])
    ranked = negatives.select("key", "slot", F.posexplode("best").alias("pos", "b"))
    out = ranked.join(positives.hint("merge"), ["key", "slot"]).join(anchors.select("key", F.col("id").alias("anchor_id")).hint("merge"), "key")
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), "positive_score", (-F.col("b.minus")).alias("negative_score"))

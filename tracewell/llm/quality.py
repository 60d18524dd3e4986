"""Quality by the votes of near labelled neighbours in a latent space.

A text is described by counts of hashed byte triples, counts of triples of character classes, and the share of words that
repeat the word before. A truncated singular value decomposition, fitted on the labelled sample, maps these to latent
vectors. The sample's vectors are sent to all tasks, as their number is bounded by a parameter; each text is compared
with every one of them by exact cosine products, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, small_batches, texts_of

TRIPLES, SHAPES, REPEATS = 1024, 512, 16
FEATURES = TRIPLES + SHAPES + REPEATS
WEIGHTS = (0.5, 1.0, 0.5)  # of the three groups


@dataclass
class Model:
    mean: np.ndarray
    axes: np.ndarray  # features by latent dimensions
    vectors: np.ndarray  # of the labelled texts, of length 1
    labels: np.ndarray
    neighbours: int
    sharpness: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        z = unit((x - self.mean) @ self.axes)
        out, k = [], min(self.neighbours, len(self.labels))
        for at in range(0, len(z), 512):
            cosine = z[at : at + 512] @ self.vectors.T
            least = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            row, near = np.nonzero(cosine >= least[:, None])
            weight = np.maximum(cosine[row, near], 1e-6).astype(np.float64) ** self.sharpness
            out.append(np.bincount(row, weight * self.labels[near], len(cosine)) / np.bincount(row, weight, len(cosine)))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def classes() -> np.ndarray:
    """Class of a byte: letters by case, digits, spaces, line ends, and each sign for itself."""
    out = np.arange(256, dtype=np.uint32)
    out[:32], out[128:] = 1, 2
    for kind, chars in ((2, range(97, 123)), (3, range(65, 91)), (4, range(48, 58)), (5, (9, 32)), (6, (10, 13))):
        out[list(chars)] = kind
    return out


CLASSES = classes()


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


def describe(texts: pa.Array) -> np.ndarray:
    """Features of whole texts, one row each; all zero but for the repeats group if a text has under three bytes."""
    texts = pa.concat_arrays([texts])
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    owner = np.repeat(np.arange(n), np.diff(at))
    groups = []
    whole = np.flatnonzero(owner[:-2] == owner[2:]) if len(data) > 2 else np.zeros(0, np.int64)
    for codes, size in ((data.astype(np.uint32), TRIPLES), (CLASSES[data], SHAPES)):
        triple = ((codes[:-2] << np.uint32(16)) | (codes[1:-1] << np.uint32(8)) | codes[2:])[whole] if len(whole) else np.zeros(0, np.uint32)
        slot = (triple * np.uint32(0x9E3779B1)) >> np.uint32(32 - size.bit_length() + 1)
        counts = np.bincount(owner[whole] * size + slot, minlength=n * size).reshape(n, size)
        groups.append(unit(np.log1p(counts.astype(np.float32))))
    repeats = np.zeros((n, REPEATS), np.float32)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(begins)
    if len(starts):
        place = np.arange(len(data)) - np.repeat(starts, np.diff([*starts, len(data)])) if starts[0] == 0 else np.arange(len(data)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
        value = (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        word = np.add.reduceat(np.where(solid, value, np.uint64(0)), starts)
        whose = owner[starts]
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (whose[1:] == whose[:-1])])
        words, again = np.bincount(whose, minlength=n), np.bincount(whose[same], minlength=n)
        many = np.flatnonzero(words > 1)
        share = again[many] / (words[many] - 1)
        repeats[many, np.minimum(REPEATS - 1, (share * REPEATS).astype(int))] = 1
    return unit(np.concatenate([w * g for w, g in zip(WEIGHTS, [*groups, repeats], strict=True)], 1)).astype(np.float32)


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, dimensions: int = 32, neighbours: int = 10, sharpness: float = 4.0) -> Model:
    """Fit on at most `sample` labelled texts; `labels` holds the rows to learn from. Rows with a null id or label teach
    nothing; an id with several labels counts with each, one with several texts with each, and repeats count once. Without
    labels every score is 0.5.

    Labels are chosen by the smallest hashes of id and label (before that, they are drawn by it at a rate that gives twice as
    many), and of the texts that have these labels again at most `sample` by a hash of the text. So `sample` rows are
    sent to the tasks, and as many feature vectors to the driver, however often an id repeats in either table."""
    small_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).distinct()
    rate = 2 * sample / max(1, known.count())
    drawn = known.withColumn("draw", F.xxhash64("id", "label", F.lit("quality"))).where(F.pmod("draw", F.lit(1_000_003)) < rate * 1_000_003)
    chosen = drawn.orderBy("draw", "id", "label").limit(sample).select("id", "label")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id", "text").alias("place"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in by_bytes(texts, 1 << 19, 512):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f2").tobytes() for x in describe(texts[a:b])], pa.binary()), batch.column(1)[a:b], batch.column(2)[a:b]], ["x", "label", "place"])

    described = rows.mapInArrow(features, "x binary, label double, place long").dropDuplicates(["place", "label"])
    got = described.orderBy("place", "label").limit(sample).toArrow()
    y = got.column("label").to_numpy()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f2").reshape(len(y), FEATURES).astype(np.float32)
    order = np.lexsort((*x[:, :: FEATURES // 8].T, y)) if len(y) else np.zeros(0, int)  # the same model however rows arrive
    x, y = x[order], y[order]
    mean = x.mean(0) if len(y) else np.zeros(FEATURES, np.float32)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean)) if len(y) else (0, np.eye(FEATURES, dtype=np.float32))
    axes = axes[:, -dimensions:].astype(np.float32)
    return Model(mean, axes, unit((x - mean) @ axes).astype(np.float32), y, neighbours, sharpness)


def predict(text: Column, model: Model) -> Column:
    """double from 0 to 1: the labels of a whole text's nearest labelled neighbours, weighted by a power of the cosine. All
    that are as near as the last of them vote too, so ties need no order. A
    null text counts as empty; the empty text is scored like any other."""

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = texts_of(column)
            out = [model.score(describe(texts[a:b])) for a, b in by_bytes(texts, 1 << 19, 512)]
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return run(text)

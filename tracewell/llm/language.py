"""Language identification by unigram models whose likelihood sums over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary, in lower case. The probability of a word is
the sum, over every way to cut it into pieces, of the product of their probabilities; a forward pass computes it. As
words are cut one by one, the likelihood of a text is a product over its words, and each distinct word is scored once
for a batch, all words and languages together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_bytes, texts_of

MARK = "▁"  # begins a word
SCALE = 32.0  # factor for each letter, so that long words don't underflow
BLOCK = 32  # letters after which probabilities are scaled anew, or as many as the longest piece has
PRIME = np.uint64(0x100000001B3)


@dataclass
class Pieces:
    """The letter pieces of a vocabulary: hashes in ascending order, their lengths (with the mark), how many there are."""

    hashes: np.ndarray
    lengths: list[int]
    size: int


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    weights: np.ndarray  # probability by piece and language
    unknown: float  # probability of a letter that is no piece


def code_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, 2, ... characters of each row; that of any substring follows from two of them."""
    h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        h[:, j + 1] = h[:, j] * PRIME + codes[:, j].astype(np.uint64) + np.uint64(1)
    return h


def as_codes(words: list[str], n: int) -> np.ndarray:
    """Characters by word; a word of fewer than n is followed by zeros, which are part of no piece."""
    return np.frombuffer("".join(w.ljust(n, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(len(words), n)


def vocabulary(path: str) -> Pieces:
    """The letter pieces of a sentencepiece file, of any length, in lower case."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(k).lower() for k in range(sp.get_piece_size())}
    pieces = {p for p in pieces if p.removeprefix(MARK).isalpha()}
    by_length: dict[int, list[str]] = {}
    for p in sorted(pieces):
        by_length.setdefault(len(p), []).append(p)
    return Pieces(np.unique(np.concatenate([code_hash(as_codes(g, n))[:, -1] for n, g in by_length.items()])), sorted(by_length), len(pieces))


def edges(words: list[str], n: int, pieces: Pieces) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For words of n letters at most: for each end, (start, rows of the words with a piece there, the pieces). The mark before
    a word is never cut off alone."""
    h, out = code_hash(as_codes([MARK + w for w in words], n + 1)), []
    power = {k: np.uint64(pow(int(PRIME), k, 1 << 64)) for k in pieces.lengths}
    for end in range(2, n + 2):
        here = []
        for k in pieces.lengths:
            start = end - k
            if start == 0 or start > 1:
                want = h[:, end] - h[:, start] * power[k]
                at = np.minimum(np.searchsorted(pieces.hashes, want), len(pieces.hashes) - 1)
                rows = np.flatnonzero(pieces.hashes[at] == want)
                here.append((start, rows, at[rows]))
        out.append(here)
    return out


class Forward:
    """Probability of each word's first 0, 1, ... characters by language: alpha * exp(level), times SCALE for each letter.

    Columns are scaled to 1 at the beginning of each block, and `level` is the logarithm of all that by block. As a piece is
    no longer than a block, an edge crosses one beginning at most: so words of any length are summed over exactly."""

    def __init__(self, found: list, rows_of: int, pieces: Pieces, weights: np.ndarray, unknown: float):
        n = len(found) + 1
        self.found, self.weights, self.step, self.block = found, weights, unknown * SCALE, max(BLOCK, *pieces.lengths)
        self.alpha = np.zeros((n + 1, rows_of, weights.shape[1]))
        self.level = np.zeros((n // self.block + 1, rows_of, weights.shape[1]))
        self.alpha[0] = 1
        for end, here in zip(range(2, n + 1), found, strict=True):
            fresh = end % self.block == 0  # computed at the level of the block before
            before = end - 1 if end > 2 else 0
            total = self.alpha[before] * (self.step * self.factor(before, end - fresh))
            for start, rows, which in here:
                if len(rows):
                    total[rows] += self.alpha[start, rows] * weights[which] * self.letters(start, end) * self.factor(start, end - fresh, rows)
            if fresh:
                b = end // self.block
                self.level[b] = self.level[b - 1] + np.log(total)
                total = np.ones_like(total)
            self.alpha[end] = total

    @staticmethod
    def letters(start: int, end: int) -> float:
        return SCALE ** (end - max(start, 1))

    def factor(self, start: int, end: int, rows=slice(None)):
        a, b = start // self.block, end // self.block
        return 1.0 if a == b else np.exp(self.level[a, rows] - self.level[b, rows])

    def logs(self, ends: np.ndarray) -> np.ndarray:
        """Logarithm of each word's probability; ends are the words' letters."""
        rows = np.arange(len(ends))
        return np.log(self.alpha[ends + 1, rows]) + self.level[(ends + 1) // self.block, rows] - (ends * np.log(SCALE))[:, None]

    def expected(self, times: np.ndarray, out: np.ndarray) -> None:
        """Add to out, by piece, how often it is expected to be used; for one language and words of one length."""
        n = len(self.found) + 1
        beta = np.zeros_like(self.alpha)
        beta[n] = 1 / self.alpha[n]
        for end, here in zip(range(n, 1, -1), reversed(self.found), strict=True):
            for start, rows, which in here:
                if len(rows):
                    share = self.weights[which] * self.letters(start, end) * self.factor(start, end, rows) * beta[end, rows]
                    beta[start, rows] += share
                    np.add.at(out, which, times[rows] * (self.alpha[start, rows] * share)[:, 0])
            before = end - 1 if end > 2 else 0
            beta[before] += beta[end] * self.step * self.factor(before, end)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word by language; 0 for the empty word. Longer words are put together with those of nearly
    their length."""
    out = np.zeros((len(words), model.weights.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if w:
            by_length.setdefault(len(w) if len(w) <= 24 else -(-len(w) // 16) * 16, []).append(k)
    for n, group in by_length.items():
        step = max(1, 200_000 // (n + 1))
        for at in range(0, len(group), step):
            some = [words[k] for k in group[at : at + step]]
            found = Forward(edges(some, n, model.pieces), len(some), model.pieces, model.weights, model.unknown)
            out[group[at : at + step]] = found.logs(np.array([len(w) for w in some]))
    return out


def fit(words: list[str], times: list[int], pieces: Pieces, steps: int = 3, unknown: float = 1e-5) -> np.ndarray:
    """Piece probabilities of a language from its words, by expectation-maximisation over all segmentations."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    lattices = [(edges([words[k] for k in g], n, pieces), np.array([times[k] for k in g], float)) for n, g in sorted(by_length.items()) if n]
    p = np.full(len(pieces.hashes), 1.0 / pieces.size)
    for _ in range(steps):
        expected = np.full(len(pieces.hashes), 0.01)
        for found, n in lattices:
            Forward(found, len(n), pieces, p[:, None], unknown).expected(n, expected)
        p = expected / expected.sum()
    return p


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(rows of the distinct words, first of each text and the end, distinct words, letters of each): runs of letters in
    lower case; other characters only divide them."""
    lists = pc.split_pattern(texts, " ")
    first = np.asarray(lists.offsets).astype(np.int64)
    units = lists.flatten().dictionary_encode()
    words = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(units.dictionary), r"\PL+", " "), " ")
    coded = words.flatten().dictionary_encode()
    sizes = np.diff(np.asarray(words.offsets)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    unit = units.indices.to_numpy(zero_copy_only=False)
    return (unit, starts, coded.indices.to_numpy(zero_copy_only=False), first - first[0]), coded.dictionary


def text_scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each text by language, its number of letters)."""
    (unit, starts, word, first), distinct = letters_of(texts)
    own = np.concatenate([word_scores(distinct.to_pylist(), model), pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[:, None]], 1)
    by_unit = np.add.reduceat(own[word], starts)
    total = np.add.reduceat(by_unit[unit], first[:-1])
    return total[:, :-1], total[:, -1]


def train(df: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", documents: int = 400, unknown: float = 1e-5) -> Model:
    """Fit on a bounded sample of df: at most `documents` different whole texts of each non-null language, those with the
    smallest hash (before that, texts are drawn by it at a rate that gives twice as many), with all their words.

    One job counts the languages' different texts, another the sample's words and fits each language in a task. The driver gets the
    probabilities: a number by language and piece of the vocabulary."""
    spark, pieces = df.sparkSession, vocabulary(path)
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: max(1, r["n"]) for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return Model([], pieces, np.zeros((0, 0)), unknown)
    rates = spark.createDataFrame([(k, min(1.0, 2 * documents / n)) for k, n in sizes.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1_000_003)) / 1_000_003
    drawn = known.withColumn("draw", draw).join(F.broadcast(rates), "lang").where("draw < rate").dropDuplicates(["lang", "text"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    chosen = drawn.withColumn("place", place).where(F.col("place") <= documents)
    split = chosen.select("lang", F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("word")).where("word <> ''")
    counted = split.groupBy("lang", "word").agg(F.count("*").alias("n")).repartition("lang").sortWithinPartitions("lang", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, times = [], [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([names[0]]), pa.array([fit(words, times, pieces, unknown=unknown).tolist()], pa.list_(pa.float64()))], ["lang", "p"])

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and lang != names[0]:
                    yield close()
                    names, words, times = [], [], []
                names = names or [lang]
                words.append(word)
                times.append(n)
        if names:
            yield close()

    fitted = {r["lang"]: np.array(r["p"]) for r in counted.mapInArrow(run, "lang string, p array<double>").collect()}
    flat = np.full(len(pieces.hashes), 1.0 / pieces.size)  # of a language whose texts have no letter
    languages = sorted(sizes)
    return Model(languages, pieces, np.stack([fitted.get(k, flat) for k in languages], 1), unknown)


def predict(text: Column, model: Model) -> Column:
    """struct<lang string, score double>: the likeliest language of a whole text and its posterior under equal priors; und
    and 0 if the text is null or has no letter, or the model knows no language. Ties go to the first language by name."""
    languages = np.array([*model.languages, "und"], object)

    @F.arrow_udf("struct<lang string, score double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = texts_of(column)
            names, scores = [], []
            for a, b in by_bytes(texts, 2 << 20):
                if not model.languages:
                    names.append(np.full(b - a, "und", object))
                    scores.append(np.zeros(b - a))
                    continue
                ll, letters = text_scores(texts[a:b], model)
                best = np.argmax(ll, 1)
                post = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
                none = letters == 0
                names.append(languages[np.where(none, len(model.languages), best)])
                scores.append(np.where(none, 0.0, post))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(names) if names else [], pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    return run(text)

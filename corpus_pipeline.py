"""Documents to packed training sequences: language, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents, of any name and in their order. run() gives the last stage's rows: one for each piece of a kept document, with its
sequence and place. Stages need the columns doc_id and text (the first also lang, of which it learns); an empty table goes
through all of them and comes out empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import language, near_copies, packing, quality
from tracewell.llm.shared import held_out, small_batches, stored, table, tokenizer_path

#: The least posterior of a language, and the least quality, of a document that stays.
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, 0.3
CAPACITY = 4096


def kept(docs: DataFrame, verdict: Column, condition: Callable[[Column], Column]) -> DataFrame:
    """Rows whose verdict, which is computed once for each, meets a condition; docs may have columns of any name."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), verdict.alias("verdict"))
    return rows.where(condition(F.col("verdict"))).select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a known language is likelier than all others together.

    Null, empty and blank texts, and those without letters, go (their language is und); long texts are scored whole. Ties between
    languages fall to the first by name. Repeated rows have one verdict and stay or go together; a null doc_id counts as the empty
    text where learning leaves out a fifth of the ids. If no row has a lang to learn from, all go."""
    small_batches(spark)
    model = language.train(docs.where(~held_out()), tokenizer_path("piece_bpe_32k.model"))
    return kept(docs, language.predict(F.col("text"), model), lambda p: (p["lang"] != "und") & (p["score"] >= LEAST_LANGUAGE))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for them; labels of held-out ids aren't learned from.

    Null texts are scored as empty ones; long texts whole. All neighbours as near as the tenth vote, so ties need no order. Repeated rows
    have one verdict. Labels without a document, or null ones, are not learned from."""
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return kept(docs, quality.predict(F.col("text"), model), lambda q: q >= LEAST_QUALITY)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the document with the smallest id: linked are fingerprints at most two bits apart, by operator 6's
    blocks, and sets of five-word shingles of a similarity of 0.8 or more. Groups are the components of both kinds of links.

    A null id comes before all others. Of rows that repeat an id one stays where they are of one group. Texts of fewer than five words are
    compared as wholes; null and blank texts are one group. Long texts are compared by all their shingles."""
    return near_copies.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    A null text counts as empty: one piece with the end id. Long texts are cut into pieces of 4,096 tokens. Repeated rows are packed
    each; pieces of one length take their places in the order of doc_id and piece, so ties change no number of sequences."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"), CAPACITY), CAPACITY)


STAGES = [("language", keep_languages), ("quality", keep_quality), ("near_duplicates", keep_distinct), ("packing", pack_sequences)]

#: SQL can't express the models, fingerprints or tokens; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .shared import discard, small_batches, stored, texts_of, written

BITS = 64
#: Choices of blocks by which a fingerprint is put up, at most, when crowded buckets are cut further.
MOST_KEYS = 200


def fingerprint(text: str, words: int = 3) -> int:
    """Bit b is set if it is in over half of the XXH64 (seed 42) of the shingles; A-Z in lower case, words between ASCII
    white space, repeats included. Fewer words than `words` are one shingle; none give 0."""
    from xxhash import xxh64_intdigest

    data = b" ".join(text.encode().lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < words - 1:
        starts, ends = [0], [len(data)]
    else:
        starts = [0, *(gaps + 1).tolist()][: len(gaps) + 2 - words]
        ends = [*gaps.tolist(), len(data)][words - 1 :]
    n = len(starts)
    total, step = np.zeros(BITS, np.int64), 1 << 15
    for at in range(0, n, step):  # bounded memory for very long texts
        h = np.array([xxh64_intdigest(data[a:b], 42) for a, b in zip(starts[at : at + step], ends[at : at + step], strict=True)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id_col and __fp long (the bits as a signed integer), one row per row of df; a null text counts as empty: 0."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, words) for x in texts_of(batch.column(1)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "__fp"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, __fp long").withColumnRenamed("id", id_col)


def block_masks(distance: int, blocks: int) -> list[int]:
    """Bits to keep for each choice of blocks - distance blocks: of two fingerprints at most `distance` bits apart, at
    least so many blocks are equal."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keyed_by(distinct: DataFrame, distance: int, blocks: int) -> DataFrame:
    """__fp, choice, bucket and n, the bucket's fingerprints, where these are several."""
    masks = F.array(*[F.col("__fp").bitwiseAND(F.lit(m)) for m in block_masks(distance, blocks)])
    keyed = distinct.select("__fp", F.posexplode(masks).alias("choice", "bucket"))
    crowd = keyed.groupBy("choice", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    return stored(keyed.join(crowd, ["choice", "bucket"]))


def links(distinct: DataFrame, distance: int = 2, blocks: int = 5, most: int = 64) -> DataFrame:
    """a, b long: links that join the same fingerprints as all pairs at most `distance` bits apart do.

    Fingerprints that share a choice of blocks meet in a bucket; pairs of a bucket are verified by their Hamming
    distance. In a bucket of over `most` fingerprints pairs would grow with its square. There, at a distance of 2, each
    fingerprint is put at its own place and at all one bit away, and those that meet at a place are linked to the smallest of
    them: all that meet at a place are near, so these are the same links but for pairs joined by them anyway. At other
    distances they are cut into more blocks, with longer keys, as long as these give no more than MOST_KEYS choices; what
    is crowded then is compared pair by pair, so the work may grow with the square of such a bucket, but no link is lost."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    found = None
    while True:
        met = keyed_by(distinct, distance, blocks)
        finer = min(BITS, 2 * blocks)
        last = distance != 2 and (finer == blocks or comb(finer, distance) > MOST_KEYS)
        few = met if last else met.where(F.col("n") <= most)
        one, two = (few.select("choice", "bucket", F.col("__fp").alias(c)) for c in "ab")
        pairs = one.join(two, ["choice", "bucket"]).where(F.col("a") < F.col("b")).where(near).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        if last:
            return found.distinct()
        distinct = stored(met.where(F.col("n") > most).select("__fp").distinct())
        if distinct.isEmpty():
            return found.distinct()
        if distance == 2:
            break
        blocks = finer
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    places = distinct.select("__fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("__fp")))).alias("place"))
    stars = places.groupBy("place").agg(F.min("__fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return found.union(places.join(stars, "place").select("a", F.col("__fp").alias("b")).where(F.col("a") < F.col("b")).where(near)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root long: the smallest node of each node's component, by alternating large and small stars until a round
    changes nothing (each halves the longest path at least, so about the logarithm of that is enough). A round is two
    jobs, each of which ends in a written table, and tells by the way whether anything has changed. Nodes without edges
    don't occur."""
    (edges, place), seen = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()), None
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large, between = written(both.join(lowest, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        told = Observation()
        after = small.select("e.u", "e.v").where("u > v").distinct()
        edges, next_place = written(after.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")))
        discard(edges.sparkSession, place, between)  # the round before can't be asked for again: its successor is written
        if told.get == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen, place = told.get, next_place


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """id_col, fingerprint string (16 hexadecimal digits), component_id: the smallest id that can be reached over links
    between fingerprints at most `distance` bits apart, the row's own included.

    One row per row of df. Texts that are null, empty or white space have the fingerprint 0 and are linked like others.
    Equal fingerprints are one node, so copies make no pairs. A null id is no smallest id unless its component has no
    other. An empty table gives an empty one. Only the two named columns are read, so others can't clash."""
    own = stored(fingerprints(df, id_col, text_col, words))
    nodes = stored(own.groupBy("__fp").agg(F.min(id_col).alias("__low")))
    found = stored(components(links(nodes.select("__fp"), distance, blocks)))
    lows = found.join(nodes, found["node"] == nodes["__fp"])
    lowest = lows.groupBy("root").agg(F.min("__low").alias("__least"))
    linked = lows.select("root", "__fp").join(lowest, "root").select("__fp", "__least")
    named = stored(nodes.join(linked, "__fp", "left").select("__fp", F.coalesce("__least", "__low").alias("component_id")))
    text = F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint")
    return own.join(named, "__fp").select(id_col, text, "component_id")


def row_key(id_col: Column, text: Column) -> Column:
    """Digest of an id and a text, null told apart from the empty id but not from the empty text."""
    name = id_col.cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.length(name), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(name, F.lit("")), F.coalesce(text, F.lit("")))))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest id, null last, and of rows with the same id
    that whose id and text have the smallest digest. Of rows that repeat both one stays, any if other columns differ.

    The choice is made among fingerprints, each with its best row, so copies are one candidate. Chosen rows are found
    again by their digest: ids need not be unique or known, and no id is a hot key. An empty table gives an empty one."""
    key = row_key(df[id_col], df[text_col])
    name = F.struct(df[id_col].isNull().alias("no_id"), df[id_col].alias("id"), key.alias("key"))
    own = fingerprints(df.select(name.alias("__name"), df[text_col].alias("__text")), "__name", "__text")
    nodes = stored(own.groupBy("__fp").agg(F.min("__name").alias("__name")))
    found = components(links(nodes.select("__fp"))).withColumnRenamed("node", "__fp")
    first = nodes.join(found, "__fp", "left").groupBy(F.coalesce("root", "__fp").alias("root")).agg(F.min("__name").alias("__name"))
    chosen = stored(first.select(F.col("__name.key").alias("__key"))).hint("merge")  # grows with the rows: never broadcast
    return df.withColumn("__key", key).join(chosen, "__key").dropDuplicates(["__key"]).select(df.columns)

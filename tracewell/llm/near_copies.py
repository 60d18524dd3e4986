"""Near copies by two kinds of links, with common components: SimHash fingerprints of few differing bits (operator 6), and the
Jaccard similarity of word shingles, with candidates by MinHash bands and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stored, texts_of
from .simhash import components, fingerprint, links, row_key

#: A similarity of at least 4/5 over shingles of five words links two texts.
WORDS, SIMILAR = 5, (4, 5)
#: Two texts of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8.
BANDS, ROWS = 30, 6


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the shingles; A-Z in lower case, words between ASCII white space. Fewer words
    than `words` are one shingle, none are the empty one."""
    from xxhash import xxh64_intdigest

    data = b" ".join(text.encode().lower().split())
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < words - 1:
        return np.array([xxh64_intdigest(data, 42)], np.uint64)
    starts, ends = np.concatenate([[0], gaps + 1])[: len(gaps) + 2 - words], np.concatenate([gaps, [len(data)]])[words - 1 :]
    step = 1 << 15  # bounded memory for very long texts
    parts = [np.array([xxh64_intdigest(data[a:b], 42) for a, b in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist(), strict=True)], np.uint64) for at in range(0, len(starts), step)]
    return np.unique(np.concatenate(parts))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of ROWS minima of the hashes under seeded multiplications."""
    from xxhash import xxh64_intdigest

    rnd = np.random.default_rng(42)
    times, plus = rnd.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * times + plus).min(0), out=least)
    return [xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def sketches(rows: DataFrame) -> DataFrame:
    """name, node, fp, bands from name, text: a node is a set of shingles, fp the fingerprint of operator 6."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, prints, keys = [], [], []
                for text in texts_of(part.column(1)).to_pylist():
                    found = shingles(text)
                    nodes.append(xxh64_intdigest(found.tobytes(), 42))
                    prints.append(fingerprint(text))
                    keys += bands(found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), signed(keys))
                yield pa.RecordBatch.from_arrays([part.column(0), signed(nodes), signed(prints), lists], ["name", "node", "fp", "bands"])

    return rows.mapInArrow(run, f"name {rows.schema['name'].dataType.simpleString()}, node long, fp long, bands array<long>")


def alike(printed: DataFrame) -> DataFrame:
    """a, b: nodes to join so that all whose fingerprints are linked by operator 6 are in one component; printed has node, fp."""
    first = stored(printed.groupBy("fp").agg(F.min("node").alias("first")))
    same = printed.join(first.hint("merge"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = links(first.select(F.col("fp").alias("__fp")))
    for c in "ab":
        ends = ends.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}")).hint("merge"), c)
    return same.union(ends.where("node_a <> node_b").select("node_a", "node_b"))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """node, found array<long> from node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(x) for x in texts_of(part.column(1)).to_pylist()]
                off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(off, signed(np.concatenate(found)))], ["node", "found"])

    return rows.mapInArrow(run, "node long, found array<long>")


def with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs and the sets of shingles of their two columns, as in_a and in_b."""
    for c in (a, b):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("found").alias(f"in_{c}")).hint("merge"), c)
    return pairs


def near(apart: Column, sizes: Column) -> Column:
    """Are sets of m + n = sizes shingles similar, of which `apart` are in one only? With p / q the least similarity,
    (m + n - apart) / (m + n + apart) >= p / q."""
    p, q = SIMILAR
    return (q + p) * apart.cast("long") <= (q - p) * sizes.cast("long")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar."""
    sizes = F.size("in_a") + F.size("in_b")
    possible = near(F.abs(F.size("in_a") - F.size("in_b")), sizes)
    return with_sets(pairs, sets, "a", "b").where(possible & near(sizes - 2 * F.size(F.array_intersect("in_a", "in_b")), sizes)).select("a", "b")


def by_rarity(rows: DataFrame) -> DataFrame:
    """rows of c, node, apart with, in place of apart, its size; shared, what other rows of the same c have too, the rarest first; and
    alone, the number of the others, which come before these. Rows that share nothing go."""
    each = rows.select("c", F.explode("apart").alias("x"))
    rare = each.groupBy("c", "x").agg(F.count("*").alias("among")).where("among > 1")
    keep = [c for c in rows.columns if c != "apart"]
    found = rows.select(*keep, F.size("apart").cast("long").alias("size"), F.explode("apart").alias("x")).join(rare.hint("merge"), ["c", "x"])
    shared = found.groupBy(*keep, "size").agg(F.sort_array(F.collect_list(F.struct("among", "x"))).alias("s"))
    return stored(shared.select(*keep, "size", (F.col("size") - F.size("s")).alias("alone"), F.col("s.x").alias("shared")))


def joined(met: DataFrame, sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, root of the components of all similar pairs that share a bucket, and of the pairs a, b that are known to be linked; met has
    bucket, node and the bucket's n.

    Pairs of a bucket would grow with its square. So all of a bucket are compared with its centre only, the node that
    meets the most others (of near copies, the text that they were made from). Let D(x) be the shingles that are in
    x or in the centre c, but not in both. A node v that is still apart from c isn't similar to it:
    |D(v)| > (|v| + |c|) / 9. A node w of the bucket is similar to v only if they differ in (|v| + |w|) / 9 shingles at
    most, that is, if D(v) and D(w) share more than (9 |D(w)| + |c| - |w|) / 18. So one of these is among the first
    |D(w)| - floor((9 |D(w)| + |c| - |w|) / 18) of D(w) in any fixed order. Those are put up first which fewest nodes around
    c have: so a passage of many texts, or a change that many have in common, is put up only by texts that have little else.
    What a single node has can't be shared: it takes its place in that order, but no row. Where two meet at the first that
    they share, they can share no more than what each has from there on, which must be enough. Pairs that meet so are all
    that can be similar, and are compared.

    (The figures are those of a similarity of 4/5; the code has them for any.)"""
    p, q = SIMILAR
    score = met.groupBy("node").agg(F.sum("n").alias("score"))
    center = met.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", F.col("node").alias("c"))).alias("s")).select("bucket", "s.c")
    pairs = met.join(center, "bucket").where("node <> c").select("c", "node").distinct()
    both = with_sets(pairs, sets, "c", "node")
    apart = F.concat(F.array_except("in_c", "in_node"), F.array_except("in_node", "in_c"))
    star = stored(both.select("c", "node", F.size("in_c").alias("n_c"), F.size("in_node").alias("n"), apart.alias("apart")))
    edges = star.where(near(F.size("apart"), F.col("n_c") + F.col("n"))).select(F.col("c").alias("a"), F.col("node").alias("b"))
    found = stored(components(edges.union(known) if known is not None else edges))
    root = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rooted = stored(star.join(root("node"), "node", "left").join(root("c"), "c", "left").select("*", F.coalesce("node_root", "node").alias("r"), F.coalesce("c_root", "c").alias("r_c")))
    around = by_rarity(rooted.drop("node_root", "c_root").join(rooted.where("r <> r_c").select("c").distinct(), "c"))
    shown = lambda side, part: ["c", *(F.col(a).alias(f"{b}_{side}") for a, b in (("node", "id"), ("r", "root"), ("n", "n"), ("size", "size"))), "alone", F.posexplode(part).alias("at", "x")]
    placed = lambda side, rows, part: rows.select(*shown(side, part)).withColumn(f"at_{side}", F.col("alone") + F.col("at")).drop("alone", "at")
    first = F.col("size") - F.floor(((q + p) * F.col("size") + (q - p) * (F.col("n_c") - F.col("n"))) / (2 * (q + p)))
    ask = placed("v", around.where("r <> r_c"), F.col("shared"))
    put_up = placed("w", around, F.slice("shared", F.lit(1), F.greatest(first - F.col("alone"), F.lit(0)).cast("int")))
    most = F.least(F.col("size_v") - F.col("at_v"), F.col("size_w") - F.col("at_w"))
    enough = 2 * (q + p) * most >= (q + p) * (F.col("size_v") + F.col("size_w")) - (q - p) * (F.col("n_v") + F.col("n_w"))
    meet = ask.join(put_up.hint("merge"), ["c", "x"]).where((F.col("root_v") != F.col("root_w")) & enough).select(F.least("id_v", "id_w").alias("a"), F.greatest("id_v", "id_w").alias("b")).distinct()
    more_edges = similar(meet, sets)
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more_edges))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of texts linked by fingerprints or similarity: that with the smallest id, null last, and of rows
    with the same id that whose id and text have the smallest digest. Of rows that repeat both one stays, any if other columns differ.

    Equal sets of shingles are one node, so copies make no pairs. Only nodes that share a band have their texts read
    again. Rows are found by their digest: ids need not be unique or known. An empty table gives an empty one."""
    small_batches(df.sparkSession)
    key = row_key(df[id_col], df[text_col])
    name = F.struct(df[id_col].isNull().alias("no_id"), df[id_col].alias("id"), key.alias("key"))
    own = sketches(df.select(name.alias("name"), df[text_col].alias("text")))
    own = stored(own.groupBy("node", "fp").agg(F.min("name").alias("name"), F.first("bands").alias("bands")))
    nodes = stored(own.groupBy("node").agg(F.min("name").alias("name"), F.first("bands").alias("bands")))
    keyed = nodes.select("node", F.explode("bands").alias("bucket"))
    met = stored(keyed.join(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"))
    asked = stored(nodes.join(met.select("node").distinct(), "node").select("node", F.col("name.key").alias("__key"))).hint("merge")
    texts = df.select(key.alias("__key"), df[text_col].alias("text")).join(asked, "__key").dropDuplicates(["__key"])
    sets = stored(shingle_sets(texts.select("node", "text")))
    first = nodes.join(joined(met, sets, alike(own.select("node", "fp"))), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("name").alias("name"))
    chosen = stored(first.select(F.col("name.key").alias("__key"))).hint("merge")  # grows with the rows: never broadcast
    return df.withColumn("__key", key).join(chosen, "__key").dropDuplicates(["__key"]).select(df.columns)

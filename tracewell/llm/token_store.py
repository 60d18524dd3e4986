"""Token ids in shards compressed by a pair grammar, with random access.

A shard is one row of a Parquet table: its place (part, shard), the number of ids before it in its part, and `grammar`,
the bytes of the format below. All numbers are little-endian; a symbol24 array is the low 16 bits of all its symbols, then
the high 8 bits of all.

    magic "RPG2", uint32: vocabulary, rules, symbols, documents
    symbol24 left[rules], right[rules]  rule r stands for the symbols left[r] right[r], and has the symbol vocabulary + r
    uint32 length[rules]                ids that a rule expands to
    symbol24 symbol[symbols]            the shard's ids after all replacements
    int64 doc_id[documents], uint8 has_id[documents]
    uint32 end[documents]               ids of the shard up to each document's end
    uint32 at[documents], skip[documents]   the symbol in which a document begins, and ids of it that come before
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_bytes, shared_dir, small_batches, texts_of
from .units import encoder

SYMBOLS = 1 << 24
HEAD = "part int, shard int, before long, n_ids long, grammar binary"


def first_of_runs(at: np.ndarray, same: np.ndarray) -> np.ndarray:
    """True for the places in `at` (ascending) whose pairs don't overlap an equal pair before: in a run of one symbol,
    every second place. `same` tells which pairs are two of one symbol; those of a run stand in `at` without a gap."""
    keep, twice = np.ones(len(at), bool), np.flatnonzero(same)
    if len(twice) > 1:
        begins = np.concatenate([[True], np.diff(at[twice]) > 1])
        run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        keep[twice] = (np.arange(len(twice)) - run) % 2 == 0
    return keep


def sorted_pairs(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the pairs in ascending order, the pairs in that order as left * 2**32 + right)."""
    wide, places = int(symbols).bit_length(), int(len(left)).bit_length()
    left = left.astype(np.int64)
    if 2 * wide + places > 63:
        pair = (left << 32) | right
        order = np.argsort(pair)
        return order, pair[order]
    packed = np.sort((left << (wide + places)) | (right.astype(np.int64) << places) | np.arange(len(left)))  # sorting alone is faster than ordering
    pair = packed >> places
    return packed & ((1 << places) - 1), ((pair >> wide) << 32) | (pair & ((1 << wide) - 1))


SLOTS = 18  # bits of a pair's slot, of which several times as many are had as there are rules


def slots_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A slot for each pair; different pairs may share one."""
    return (left.astype(np.uint32) * np.uint32(0x9E3779B1) ^ right.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOTS)


def compress(ids: np.ndarray, vocabulary: int, rounds: int | None = None, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of the rules, symbols): pairs are replaced by new symbols until none occurs `least` times without overlaps
    (by default: twice), or for so many rounds.

    The most frequent pair is always replaced wherever it stands. In the same round, so is each pair at the places where it is
    more frequent than both pairs that overlap it (of equally frequent ones, the greater pair comes first), if there are
    `least` such places: these replacements don't touch each other. What is left of a pair that has a symbol gets the same
    symbol in later rounds. Another pair without `least` occurrences gains some only from such a symbol, so only places with
    pairs that may be replaced, and those beside a replacement, are looked at again, and at the end all of them."""
    if vocabulary > SYMBOLS:
        raise ValueError("the format holds up to 16,777,216 symbols")
    a, rules, n_rules = ids.astype(np.int32), [], 0
    ruled, ruled_symbol = np.zeros(0, np.int64), np.zeros(0, np.int64)  # pairs that have a symbol, in ascending order
    ruled_slot = np.zeros(1 << SLOTS, bool)  # slots of those pairs
    live = np.arange(max(0, len(a) - 1))
    again = False  # has a symbol been used again since all places were looked at?
    while rounds is None or rounds > 0:
        if not len(live):
            if not again:
                break
            live, again = np.arange(len(a) - 1), False
            continue
        rounds = None if rounds is None else rounds - 1
        left, right = a[live], a[live + 1]
        once = first_of_runs(live, left == right)
        at, odd = live[once], live[~once]
        order, sorted_pair = sorted_pairs(left[once], right[once], vocabulary + n_rules)
        starts = np.flatnonzero(np.concatenate([[True], sorted_pair[1:] != sorted_pair[:-1]])) if len(at) else np.zeros(0, np.int64)
        n = np.diff(np.append(starts, len(at)))
        pairs = sorted_pair[starts]
        symbol = np.zeros(len(n), np.int64)
        known = np.flatnonzero(ruled_slot[slots_of(pairs >> 32, pairs & 0xFFFFFFFF)]) if n_rules else starts[:0]
        if len(known):
            place = np.minimum(np.searchsorted(ruled, pairs[known]), len(ruled) - 1)
            symbol[known] = np.where(ruled[place] == pairs[known], ruled_symbol[place], 0)
        # Groups that may be replaced, numbered by their weight; an occurrence's group stands at its place.
        often = np.flatnonzero((n >= least) | (symbol > 0))
        if not len(often):
            live = odd
            continue
        weight = np.zeros(len(n), np.int32)
        weight[often[np.argsort(n[often], kind="stable")]] = np.arange(1, len(often) + 1)
        at_place = np.zeros(len(a) + 1, np.int32)  # the last stands before the first
        at_place[at[order]] = np.repeat(weight, n)
        at = np.flatnonzero(at_place)
        own = at_place[at]
        best = (own > at_place[at - 1]) & (own > at_place[at + 1])
        here, own = at[best], own[best]
        times, by_weight = np.bincount(own, minlength=len(often) + 1), np.zeros(len(often) + 1, np.int64)
        by_weight[weight[often]] = symbol[often]
        again |= bool((times * (by_weight > 0)).any())
        new = np.flatnonzero((times >= least) & (by_weight == 0))
        by_weight[new] = vocabulary + n_rules + np.arange(len(new))
        group = np.zeros(len(often) + 1, np.int64)
        group[weight[often]] = often
        found = pairs[group[new]]
        rules.append(np.stack([found >> 32, found & 0xFFFFFFFF], 1))
        n_rules += len(new)
        ruled, ruled_symbol = np.concatenate([ruled, np.sort(found)]), np.concatenate([ruled_symbol, by_weight[new][np.argsort(found)]])
        by = np.argsort(ruled, kind="stable")
        ruled, ruled_symbol = ruled[by], ruled_symbol[by]
        ruled_slot[slots_of(found >> 32, found & 0xFFFFFFFF)] = True
        sure = by_weight[own] > 0
        here, own = here[sure], own[sure]
        alive = at_place[:-1] > 0
        alive[odd] = True
        alive[np.maximum(here - 1, 0)] = True
        keep = np.ones(len(a), bool)
        keep[here + 1] = False
        a[here] = by_weight[own]
        a, alive = a[keep], alive[keep]
        live = np.flatnonzero(alive[:-1])
    if vocabulary + n_rules > SYMBOLS:
        raise ValueError("the format holds up to 16,777,216 symbols: write smaller shards")
    return np.concatenate([np.zeros((0, 2), np.int64), *rules]), a.astype(np.int64)


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each symbol expands to. A rule is made of ids and earlier rules; it waits for those of its own kind only."""
    length = np.ones(vocabulary + len(rules), np.int64)
    length[vocabulary:] = 0
    open_rules = np.arange(len(rules))
    while len(open_rules):
        left, right = length[rules[open_rules, 0]], length[rules[open_rules, 1]]
        known = (left > 0) & (right > 0)
        length[vocabulary + open_rules[known]] = left[known] + right[known]
        open_rules = open_rules[~known]
    return length


def symbol24(a: np.ndarray) -> bytes:
    return (a & 0xFFFF).astype("<u2").tobytes() + (a >> 16).astype("u1").tobytes()


def write_shard(docs: list, ends: np.ndarray, ids: np.ndarray, vocabulary: int, **how) -> bytes:
    rules, symbols = compress(ids, vocabulary, **how)
    length = rule_lengths(rules, vocabulary)
    stops = np.cumsum(length[symbols])
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(stops, begins, side="right"), max(0, len(symbols) - 1))
    skip = begins - (stops - length[symbols])[at] if len(symbols) else np.zeros(len(begins), np.int64)
    return b"".join([
        b"RPG2", struct.pack("<4I", vocabulary, len(rules), len(symbols), len(docs)),
        symbol24(rules[:, 0]), symbol24(rules[:, 1]), length[vocabulary:].astype("<u4").tobytes(), symbol24(symbols),
        np.array([x or 0 for x in docs], "<i8").tobytes(), np.array([x is not None for x in docs], np.uint8).tobytes(),
        ends.astype("<u4").tobytes(), at.astype("<u4").tobytes(), skip.astype("<u4").tobytes(),
    ])


class Shard:
    def __init__(self, data: bytes):
        if data[:4] != b"RPG2":
            raise ValueError("no shard of token ids")
        self.vocabulary, rules, symbols, docs = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def take24(n: int) -> tuple[np.ndarray, np.ndarray]:
            return take("<u2", n), take("u1", n)

        self._left, self._right, self.length = take24(rules), take24(rules), take("<u4", rules)
        self._symbols, doc, has = take24(symbols), take("<i8", docs), take("u1", docs)
        self.docs = [int(d) if h else None for d, h in zip(doc, has, strict=True)]
        self.ends, self.at, self.skip = (take("<u4", docs) for _ in range(3))

    @staticmethod
    def whole(parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return parts[0].astype(np.int64) | (parts[1].astype(np.int64) << 16)

    def ids(self) -> np.ndarray:
        """All ids: symbols are put at their places, and those that are rules replaced there by their two, level by level."""
        left, right = self.whole(self._left), self.whole(self._right)
        length = np.concatenate([np.ones(self.vocabulary, np.int64), self.length])
        symbol = self.whole(self._symbols)
        stops = np.cumsum(length[symbol])
        place, out = stops - length[symbol], np.empty(int(stops[-1]) if len(stops) else 0, np.uint32)
        while len(symbol):
            rule = symbol >= self.vocabulary
            out[place[~rule]] = symbol[~rule]
            r, place = symbol[rule] - self.vocabulary, place[rule]
            symbol, place = np.concatenate([left[r], right[r]]), np.concatenate([place, place + length[left[r]]])
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document. Only its own symbols are read, and rules that lie wholly before or after it are passed
        over by their length: the work follows the document's ids and the depth of the rules, not the shard."""
        need = int(self.ends[k]) - (int(self.ends[k - 1]) if k else 0)
        at, skip, out, stack = int(self.at[k]), int(self.skip[k]), [], []
        one = lambda parts, j: int(parts[0][j]) | (int(parts[1][j]) << 16)
        while len(out) < need:
            if not stack:
                stack.append(one(self._symbols, at))
                at += 1
            symbol = stack.pop()
            r = symbol - self.vocabulary
            size = 1 if r < 0 else int(self.length[r])
            if skip >= size:
                skip -= size
            elif r < 0:
                out.append(symbol)
            else:
                stack += (one(self._right, r), one(self._left, r))
        return np.array(out, np.uint32)


def write_tokens(df: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_ids: int = 1 << 19) -> None:
    """Encode every whole text by the tokenizer file at `path`, append end_id, and write shards to the Parquet table `out`
    in ascending order of id_col (null first; equal ids by a digest of their text). A null text counts as empty and has
    only its end id; an empty table gives an empty `out`. Repeated rows are kept. Only the two named columns are read.

    One range shuffle by id, digest and place orders the texts, so that rows of one id, or of none, are dealt over as many
    tasks as they need; each task then encodes its range as a stream and holds one shard, which closes after the first
    document that fills it. A lost task is done again from the shuffle with the same result."""
    small_batches(df.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encoder(path), TaskContext.get().partitionId()
        vocabulary, number, before = len(coder.vocabulary), 0, 0
        docs, sizes, held = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal number, before, docs, sizes, held
            ids, ends = np.concatenate(held), np.cumsum(sizes)
            row = [part, number, before, len(ids), write_shard(docs, ends, ids, vocabulary)]
            number, before, docs, sizes, held = number + 1, before + len(ids), [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "before", "n_ids", "grammar"])

        for batch in batches:
            texts, names = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in by_bytes(texts):
                off, ids = coder.encode(texts[a:b])
                ids = np.insert(ids, off[1:], end_id)
                off = off + np.arange(len(off))
                at = 0
                while at < b - a:
                    room = shard_ids - sum(sizes)
                    to = min(b - a, max(at + 1, int(np.searchsorted(off, off[at] + room, side="left"))))
                    docs += names[a + at : a + to]
                    sizes += np.diff(off[at : to + 1]).tolist()
                    held.append(ids[off[at] : off[to]])
                    at = to
                    if sum(sizes) >= shard_ids:
                        yield close()
        if docs:
            yield close()

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("digest"), F.monotonically_increasing_id().alias("place"))
    order = ["id", "digest", "place"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(shards, HEAD).write.option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of `out`, read back: id_col, start long (ids of all documents before it), n_tokens long, ids_crc32
    long (of its ids as little-endian 32-bit integers).

    Only the totals of the parts, one row for each task that wrote, are summed up in one place."""
    table = spark.read.schema(HEAD).parquet(out)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(data.as_py())
                raw = shard.ids().astype("<u4").tobytes()
                ends = shard.ends.tolist()
                starts = [0, *ends][: len(ends)]
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ends), pa.int32()), pa.array(shard.docs, pa.int64()), pa.array(np.array(starts, np.int64) + before), pa.array(np.array(ends, np.int64) - np.array(starts, np.int64)), pa.array(crc, pa.int64())],
                    ["part", "id", "at", "n_tokens", "ids_crc32"],
                )

    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = table.select("part", "before", "grammar").mapInArrow(documents, "part int, id long, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(base), "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_store(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"

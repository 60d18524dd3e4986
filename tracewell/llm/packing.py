"""Packing of token pieces into sequences by bin completion.

Packing depends on lengths alone, and there are at most `capacity` of those however many pieces there are. So the branch and
bound over fillings runs on the histogram of lengths, and yields fillings with the number of sequences that use each;
the pieces of each length are then numbered and dealt to the slots of their length, all in parallel."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_bytes, small_batches, stored, texts_of
from .units import encoder


def cut_pieces(df: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """id_col, piece int, start long, length long, ids_crc32 long: the ids of each whole text (null: empty) by the
    tokenizer file at `path` and end_id, cut into pieces of `capacity` ids; the last may be shorter. One row at least for
    each input row; repeated rows give repeated pieces. Only the two named columns are read."""
    small_batches(df.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in by_bytes(texts):
                off, ids = coder.encode(texts[a:b])
                raw = np.insert(ids, off[1:], end_id).astype("<u4").tobytes()
                off = off + np.arange(len(off))
                n = np.diff(off)
                many = -(-n // capacity)
                owner = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[owner] - start, capacity)
                at = off[owner] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(pieces, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


@dataclass
class Plan:
    fillings: list[tuple[tuple[int, ...], int]]  # lengths from the longest, and the number of sequences filled so
    sequences: int
    bound: int  # no packing has fewer sequences
    cut: int  # searches ended by their number of nodes before they had seen all
    proved: bool  # no packing has fewer sequences than this one


def lower_bound(left: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs. For each k up to half the capacity: lengths over capacity - k stand without any of k
    or more, those over half of it apart from each other, and the others of k or more fill what these leave."""
    if not left:
        return 0
    sizes = np.array(sorted(left), np.int64)
    n = np.array([left[int(s)] for s in sizes], np.int64)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    k = np.unique(np.concatenate([[0, 1], sizes[sizes <= capacity // 2]]))
    low, half, alone = np.searchsorted(sizes, k), np.searchsorted(sizes, capacity // 2, side="right"), np.searchsorted(sizes, capacity - k, side="right")
    low, alone = np.minimum(low, half), np.maximum(alone, half)
    space = (count[alone] - count[half]) * capacity - (total[alone] - total[half])
    rest = np.maximum(0, -(-(total[half] - total[low] - space) // capacity))
    return int((count[-1] - count[half] + rest).max())


def best_fit_decreasing(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths from the longest, each put where it leaves least room. Sequences with the same filling are one entry, so the
    work follows the number of distinct fillings."""
    rooms: list[int] = []  # of the open fillings, in ascending order
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(filling: tuple[int, ...], times: int) -> None:
        room = capacity - sum(filling)
        if room not in groups:
            insort(rooms, room)
        groups.setdefault(room, []).append((filling, times))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):  # new sequences, with as many of s as they hold
                each = capacity // s
                for times, uses in ((n // each, each), (1, n % each)):
                    if times and uses:
                        add((s,) * uses, times)
                break
            room = rooms[k]
            filling, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[k]
            used = min(n, times)
            if used < times:
                add(filling, times - used)
            add((*filling, s), used)
            n -= used
    return [x for group in groups.values() for x in group]


def dominated(filling: tuple[int, ...], room: int, left: dict[int, int]) -> bool:
    """Could one longer piece that is left stand for some of `filling` (or for free room alone)? Then a packing with that
    piece here is as good, and this one need not be looked at. Sums are sets of bits."""
    waste = room - sum(filling)
    one, many = 0, 0  # sums of one piece, of several
    used: dict[int, int] = {}
    for s in filling:
        many |= (one | many) << s
        one |= 1 << s
        used[s] = used.get(s, 0) + 1
    for x, n in left.items():
        if n <= used.get(x, 0) or x > room:
            continue
        if x <= waste or many >> x & 1:
            return True
        low = max(1, x - waste)
        if (one | many) >> low & ((1 << (x - low)) - 1):
            return True
    return False


def fillings(room: int, left: dict[int, int], least: int, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...] | None]:
    """Fillings of `room` by pieces of `left` that sum to `least` or more, the longest pieces first: in descending order,
    below `after`. None is given for each step that yields no filling, so that the caller can count the work. A branch is
    left when all shorter pieces together can't bring it to `least`."""
    sizes = sorted((s for s, n in left.items() if n and s <= room), reverse=True)
    tail = [0]
    for s in reversed(sizes):
        tail.append(tail[-1] + s * left[s])
    tail.reverse()
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, ())]
    while stack:
        k, total, chosen = stack.pop()
        while k < len(sizes) and sizes[k] > room - total:
            k += 1
        if total + min(tail[k], room - total) < least:
            yield None
            continue
        if k == len(sizes):
            yield chosen if after is None or chosen < after else None
            continue
        s = sizes[k]
        for m in range(min(left[s], (room - total) // s) + 1):  # the largest number of pieces is tried first
            stack.append((k + 1, total + m * s, chosen + (s,) * m))
        yield None


def completion(room: int, left: dict[int, int], nodes: int | None) -> tuple[tuple[int, ...], bool]:
    """(the filling of `room` that wastes least, of equals the first in descending order: fewer and longer pieces; whether
    all were seen). The best-fit filling is the first incumbent; the search ends at no waste, or after so many nodes."""
    best, free = [], room
    for s in sorted(left, reverse=True):
        take = min(left[s], free // s)
        best += [s] * take
        free -= take * s
    best = tuple(best)
    while free:
        found = None
        for f in fillings(room, left, room - free + 1):
            if nodes is not None:
                if not nodes:
                    return best, False
                nodes -= 1
            if f is not None:
                found = f
                break
        if found is None:
            break
        best, free = found, room - sum(found)
    return best, True


def take(left: dict[int, int], filling: tuple[int, ...], times: int) -> dict[int, int]:
    out = dict(left)
    for s in filling:
        out[s] -= times
    return {s: n for s, n in out.items() if n}


def most_times(left: dict[int, int], filling: tuple[int, ...]) -> int:
    uses: dict[int, int] = {}
    for s in filling:
        uses[s] = uses.get(s, 0) + 1
    return min(left.get(s, 0) // n for s, n in uses.items())


def greedy(left: dict[int, int], capacity: int, nodes: int | None) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(fillings, searches cut): each sequence is completed around the longest piece that remains, with least waste, and
    the filling repeated as often as its pieces last; so the work follows the number of distinct lengths, not of pieces."""
    out, cut = [], 0
    while left:
        longest = max(left)
        rest, whole = completion(capacity - longest, take(left, (longest,), 1), nodes)
        cut += not whole
        filling = (longest, *rest)
        times = most_times(left, filling)
        left = take(left, filling, times)
        out.append((filling, times))
    return out, cut


def bin_completion(histogram: dict[int, int], capacity: int, nodes: int | None = 2000, branch_nodes: int | None = 20_000) -> Plan:
    """Branch and bound over the fillings around the longest piece that remains.

    The incumbents are the best-fit packing and that which completes each sequence with least waste (searches of up to
    `nodes` nodes). If the better one has as few sequences as the lower bound, it is returned. Else all packings with fewer
    sequences are looked for: for the longest piece, every filling that wastes no more than such a packing has to spare and
    isn't dominated is tried, as often as its pieces last first, then fewer times with later fillings beside it. A branch
    ends where its sequences and the lower bound of the rest reach the incumbent. `branch_nodes` ends that search;
    None for both is the exact way, whose work can grow exponentially with the number of lengths. `cut` tells how many
    searches were ended early."""
    left = {s: n for s, n in histogram.items() if n}
    bound = lower_bound(left, capacity)
    count = lambda plan: sum(n for _, n in plan)
    best, cut = greedy(left, capacity, nodes)
    best = min(best_fit_decreasing(left, capacity), best, key=count)
    sequences, total, proved = count(best), sum(s * n for s, n in left.items()), True
    # A step: (pieces left, sequences used, their waste, fillings still to try, the filling and its number of times).
    stack = [Step(left, 0, 0)] if sequences > bound else []
    while stack and sequences > bound:
        step = stack[-1]
        spare = (sequences - 1) * capacity - total - step.waste
        if step.times > 1:  # the same filling fewer times
            step.times -= 1
        else:
            longest = max(step.left)
            room = capacity - longest
            rest = take(step.left, (longest,), 1)
            if step.tries is None:
                step.tries = fillings(room, rest, room - spare, step.after)
            step.times = 0
            for f in step.tries:
                if branch_nodes is not None:
                    branch_nodes -= 1
                    if branch_nodes < 0:
                        break
                if f is not None and room - sum(f) <= spare and not dominated(f, room, rest):
                    step.filling, step.times = (longest, *f), most_times(step.left, (longest, *f))
                    break
            if branch_nodes is not None and branch_nodes < 0:
                cut, proved = cut + 1, False
                break
            if not step.times:
                stack.pop()
                continue
        while step.times and (capacity - sum(step.filling)) * step.times > spare:
            step.times -= 1
        if not step.times:
            continue
        after = take(step.left, step.filling, step.times)
        used = step.used + step.times
        if not after:
            if used < sequences:
                sequences, best = used, [(x.filling, x.times) for x in stack]
            continue
        if used + lower_bound(after, capacity) < sequences:
            same = max(after) == step.filling[0]  # the order of sequences around pieces of one length doesn't matter
            stack.append(Step(after, used, step.waste + (capacity - sum(step.filling)) * step.times, step.filling[1:] if same else None))
    return Plan(best, sequences, bound, cut, proved or sequences == bound)


@dataclass
class Step:
    left: dict[int, int]
    used: int
    waste: int
    after: tuple[int, ...] | None = None
    tries: Iterator | None = None
    filling: tuple[int, ...] = ()
    times: int = 0


#: Groups in which pieces are numbered: this many, and one more for each length.
GROUPS = 8192


def pack(pieces: DataFrame, capacity: int = 4096, order_by: tuple[str, ...] = ("doc_id", "piece"), nodes: int | None = 2000, branch_nodes: int | None = 20_000) -> DataFrame:
    """pieces with sequence_id long and offset long: each piece's sequence and its place there, gapless from 0.

    `pieces` has a column length, from 1 to capacity, and those of order_by, in whose order pieces of one length are dealt; other
    columns of any name pass through (sequence_id and offset lose to the new ones). A null length is an error. Repeated rows are packed one by one. An empty table gives an empty one. `nodes` and
    `branch_nodes` are those of bin_completion().

    What reaches the driver is the histogram, at most `capacity` rows; what is sent to tasks is the table of slots, which
    follows the number of fillings, and a number for each length and each group. Pieces of one length are numbered in
    groups, of which a length has its share of GROUPS and one more: at most GROUPS + capacity rows at any size of the
    input. Rows are dealt to groups by their place in the table, so neither a length nor a row that a third of all pieces
    repeat is a hot group."""
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    if not {"length", *order_by} <= set(keep):
        raise ValueError(f"pieces need the columns length, {', '.join(order_by)}")
    # Under names of our own, so that no column of pieces can clash with those added here.
    own = {c: f"c{k}" for k, c in enumerate(keep)}
    size_of, order = own["length"], [own[c] for c in order_by]
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(GROUPS)).cast("int")
    placed = stored(pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], place.alias("place")))
    histogram = {r[0]: r["n"] for r in placed.groupBy(size_of).agg(F.count("*").alias("n")).collect()}
    if any(not s or s > capacity for s in histogram):
        raise ValueError("lengths must be from 1 to the capacity")

    base, rank, slots = 0, dict.fromkeys(histogram, 0), []
    for filling, times in bin_completion(histogram, capacity, nodes, branch_nodes).fillings:
        offset = 0
        for s in filling:
            slots.append((s, rank[s], base, offset))
            rank[s] += times
            offset += s
        base += times
    slots.sort()
    length, lowest, first, at = (np.array(x, np.int64) for x in (zip(*slots, strict=True) if slots else ((), (), (), ())))
    bounds = (length << 46) + lowest

    spark, total = pieces.sparkSession, sum(histogram.values())
    shares = spark.createDataFrame([(s, 1 + n * GROUPS // max(1, total)) for s, n in histogram.items()], f"{size_of} long, groups int")
    grouped = placed.join(F.broadcast(shares), size_of).withColumn("group", F.pmod("place", "groups"))
    counts = stored(grouped.groupBy(size_of, "group").agg(F.count("*").alias("n")))
    before = Window.partitionBy(size_of).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(size_of, "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = grouped.withColumn("k", F.row_number().over(Window.partitionBy(size_of, "group").orderBy(*order)))
    numbered = numbered.join(F.broadcast(counts), [size_of, "group"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    schema = placed.drop("place").schema.add("sequence_id", "long").add("offset", "long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (size_of, "rank"))
            k = np.searchsorted(bounds, (size << 46) + number, side="right") - 1
            out = [batch.column(c) for c in own.values()]
            yield pa.RecordBatch.from_arrays([*out, pa.array(first[k] + number - lowest[k]), pa.array(at[k])], [*own.values(), "sequence_id", "offset"])

    return numbered.select(*own.values(), "rank").mapInArrow(deal, schema).toDF(*keep, "sequence_id", "offset")

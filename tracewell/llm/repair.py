"""Repair of conversation structure: the cheapest edits that leave an optional system turn and whole user-assistant pairs.

The edits of a conversation are paths through a lattice of (rows read, state of the pattern). Dijkstra's search runs from
both ends: a heap of nodes by their cost from the start and one by their cost to the end. Where the two meet is a path's
cost; the search goes on until the tops of the heaps together cost more than the best path, so that every crossing of equal
cost is known, and the crossing whose audits, put together, are least in ASCII order gives the edits.

A conversation is read in blocks. A block that isn't a whole conversation is solved from each state to each other one,
and the blocks are put together as a (least cost, least audit) product. That is exact: of two paths of one cost between the
same two nodes neither audit is a prefix of the other (both read the same rows, and an insertion costs), so the least of
the whole begins with the least of its parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: White space of this operator.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States: nothing yet, a system turn, a user's turn that waits for its answer, whole pairs.
START, SYSTEM, OPEN, PAIRS = range(4)
ENDS = (START, PAIRS)
#: The role that an inserted or changed turn must have in a state, and the state after it.
NEXT = {START: ("user", OPEN), SYSTEM: ("user", OPEN), PAIRS: ("user", OPEN), OPEN: ("assistant", PAIRS)}
#: Pairs of role initials that may follow each other.
LEGAL = ("su", "ua", "au")

Found = tuple[int, str] | None


@cache
def edges(initial: str, must_go: bool, extra: int) -> tuple[list, list]:
    """(forward, backward): for each state the (edit, other state, cost) by which a row of that kind is read."""
    forward, backward = [[] for _ in range(4)], [[] for _ in range(4)]
    for q in range(4):
        out = [("D", q, DELETE)]
        if not must_go:
            kept = SYSTEM if initial == "s" and q == START else NEXT[q][1] if initial == NEXT[q][0][0] else None
            out += [("K", kept, KEEP + extra)] * (kept is not None) + [("R", NEXT[q][1], REROLE + extra)]
        for edit, to, cost in out:
            forward[q].append((edit, to, cost))
            backward[to].append((edit, q, cost))
    return forward, backward


INSERTS = [(NEXT[q][1], q) for q in range(4)]


def search(rows: list[tuple[str, bool, int]], start: int, ends: Iterable[int]) -> Found:
    """(cost, audit) of the cheapest edits of rows that lead from a state to one of others, ties to the least audit; None
    if there are none. A row is (role's initial, whether it must go, what it costs beside if it stays)."""
    n = len(rows)
    tables = [edges(*r) for r in rows]
    ahead, behind = {start: (0, "")}, {4 * n + q: (0, "") for q in ends}
    # Nodes of one cost are settled in the order of the rows read, as the edits without cost read a row.
    heaps = ([(0, 0, start)], [(0, -n, 4 * n + q) for q in ends])
    heapify(heaps[1])
    settled: tuple[set, set] = (set(), set())
    best = min((0 for v in ahead if v in behind), default=None)
    while (heaps[0] and heaps[1]) and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        back = heaps[1][0][0] < heaps[0][0][0]
        cost, _, v = heappop(heaps[back])
        if v in settled[back]:
            continue
        settled[back].add(v)
        own, other = (behind, ahead) if back else (ahead, behind)
        audit, (i, q) = own[v][1], divmod(v, 4)
        if back:
            steps = [(4 * (i - 1) + p, c, e) for e, p, c in tables[i - 1][1][q]] if i else []
            steps += [(4 * i + p, INSERT, "I") for to, p in INSERTS if to == q]
        else:
            steps = [(4 * (i + 1) + p, c, e) for e, p, c in tables[i][0][q]] if i < n else []
            steps.append((4 * i + NEXT[q][1], INSERT, "I"))
        for u, c, e in steps:
            label, had = (cost + c, e + audit if back else audit + e), own.get(u)
            if had is None or label < had:
                own[u] = label
                if had is None or label[0] < had[0]:
                    heappush(heaps[back], (label[0], -(u // 4) if back else u // 4, u))
                if u in other and (best is None or label[0] + other[u][0] < best):
                    best = label[0] + other[u][0]
    if best is None:
        return None
    return best, min(a + behind[v][1] for v, (c, a) in ahead.items() if v in behind and c + behind[v][0] == best)


class Chain:
    """An audit of blocks, from its last to its first: pieces shared with other audits are kept once."""

    __slots__ = ("before", "piece", "size")

    def __init__(self, before: Chain | None, piece: str):
        self.before, self.piece, self.size = before, piece, 1 + (before.size if before else 0)


def less(a: Chain, b: Chain) -> bool:
    """Whether the audit a comes before b; what they share isn't looked at. Both have a piece for each block."""
    left, right = [], []
    while a is not b:
        left.append(a.piece)
        right.append(b.piece)
        a, b = a.before, b.before
    return "".join(reversed(left)) < "".join(reversed(right))


def text_of(chain: Chain | None) -> str:
    out = []
    while chain:
        out.append(chain.piece)
        chain = chain.before
    return "".join(reversed(out))


def advance(reached: dict[int, tuple[int, Chain | None]], costs: list[int], audits: list[str]) -> dict[int, tuple[int, Chain]]:
    """The best (cost, audit) by state after one more block, whose solution from p to q is at place 4p + q (cost -1: none)."""
    out: dict[int, tuple[int, Chain]] = {}
    for p, (cost, chain) in reached.items():
        for q in range(4):
            if costs[4 * p + q] >= 0:
                total, longer = cost + costs[4 * p + q], Chain(chain, audits[4 * p + q])
                if q not in out or total < out[q][0] or total == out[q][0] and less(longer, out[q][1]):
                    out[q] = (total, longer)
    return out


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def packed(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


COUNTS = ("blank", "duplicate", "truncated", "illegal")
BLOCK = {"first_turn": pa.int64(), "last_turn": pa.int64(), "turns": pa.int64(), "first_role": pa.string(), "last_role": pa.string()}
BLOCK |= dict.fromkeys(COUNTS, pa.int64()) | {"costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
BLOCK_DDL = "part int, place long, first_turn long, last_turn long, turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"


def block_of(rows: list[tuple], whole: bool) -> tuple:
    """What the values of BLOCK are for rows of (turn, role's initial, fault): costs and audits have one place if the rows
    are a whole conversation, else one for each pair of states."""
    turns = [t for t, _, _ in rows if t is not None]
    faults = [f for _, _, f in rows]
    illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    kinds = [(r if r in ("s", "u", "a") else "", f in ("blank", "duplicate"), int(f == "truncated")) for _, r, f in rows]
    found = [search(kinds, START, ENDS)] if whole else [search(kinds, p, (q,)) for p in range(4) for q in range(4)]
    costs, audits = [-1 if f is None else f[0] for f in found], ["" if f is None else f[1] for f in found]
    counts = [faults.count(c) for c in COUNTS[:3]]
    return (turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), rows[0][1], rows[-1][1], *counts, illegal, costs, audits)


class Joined:
    """A conversation put together from its blocks in order."""

    def __init__(self):
        self.counts, self.gaps, self.turns, self.span, self.last_role = dict.fromkeys(COUNTS, 0), 0, 0, None, None
        self.reached: dict[int, tuple[int, Chain | None]] = {START: (0, None)}

    def add(self, block: dict) -> None:
        for c in COUNTS:
            self.counts[c] += block[c]
        self.counts["illegal"] += self.last_role is not None and self.last_role + block["first_role"] not in LEGAL
        self.last_role = block["last_role"]
        if block["turns"]:
            first, last = self.span or (block["first_turn"], None)
            self.turns += block["turns"] - (last == block["first_turn"])
            self.span = first, block["last_turn"]
        if len(block["costs"]) == 1:
            self.reached = {START: (block["costs"][0], Chain(None, block["audits"][0]))}
        else:
            self.reached = advance(self.reached, block["costs"], block["audits"])

    def result(self) -> tuple:
        gaps = min((1 << 63) - 1, self.span[1] - self.span[0] + 1 - self.turns) if self.span else 0
        ends = [self.reached[q] for q in ENDS if q in self.reached]
        cost = min(c for c, _ in ends)
        return gaps, *self.counts.values(), cost, min(text_of(chain) for c, chain in ends if c == cost)


def faults(df: DataFrame) -> DataFrame:
    """id, turn, initial, digest, n, fault, first: n equal rows of a turn, the fault of their text, and whether they hold
    the first row with their role and text. Counted before each shuffle, and texts only as digests."""
    slim = df.select("id", "turn", "role", F.sha2("text", 256).alias("digest"), "fault")
    groups = slim.groupBy("id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max("fault").alias("fault"))
    # The earliest turn, null before all others.
    earliest = groups.groupBy(F.col("id").alias("__id"), F.col("role").alias("__role"), F.col("digest").alias("__digest")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    joined = groups.join(earliest, F.col("id").eqNullSafe(F.col("__id")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest")))
    return joined.select("id", "turn", "role", "digest", "n", "fault", F.col("turn").eqNullSafe(F.col("first.turn")).alias("first"))


def prepared(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).cast("string").try_cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    body = F.rtrim("text", F.lit(BLANKS))
    return rows.withColumn("fault", F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))


def audits(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 1024) -> DataFrame:
    """id_col, gaps, blank, duplicate, truncated, illegal, cost (long) and audit (string), a row for each id of df.

    Rows of an id are taken by turn (null first; one that is no whole number is null), role and digest of the text. A null
    role or text is one space, a null id one conversation; repeated rows are duplicates, each. Each row has its first fault:
    blank, duplicate (role and text of an earlier row), truncated (no `.!?` at its end). gaps: whole numbers missing between the
    least and the largest turn (at most 2**63 - 1). illegal: neighbours whose role initials aren't su, ua or au; an
    empty role has no initial and can't be kept, as any initial but s, u and a.
    audit: the initials of Keep (0), Rerole (2), Delete (3; the only one for blank and duplicate rows) and Insert (2), 1 more for
    a truncated row that stays, that are cheapest and least in ASCII order and leave `(s?(ua)+)?`. An empty table gives an
    empty one; other columns aren't read.

    Equal rows of a turn are counted before the shuffle, and rows are dealt by ranges of their whole order, so that
    a long conversation is cut into blocks of at most `block` rows in many tasks; only solved blocks come together by id."""
    rows = faults(prepared(df, id_col, turn_col, role_col, text_col))
    order = ["id", "turn", "role", "digest"]
    rows = rows.select(*order, F.left("role", F.lit(1)).alias("initial"), "n", "fault", "first").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("id", "turn", "initial", "n", "fault", "first")
    names, id_ddl = ["id", "part", "place", *BLOCK], df.schema[id_col].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, done, kind = TaskContext.get().partitionId(), 0, [], None

        def close(conv, held, whole):
            nonlocal place
            done.append((conv, part, place, *block_of(held, whole)))
            place += 1

        def kinded(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        held, current, begun, inner = [], None, False, False
        for conv, turn, initial, n, fault, first in columns(kinded(batches)):
            if begun and conv != current:
                # Whole: neither cut already nor the first of this task, which may have begun in the one before.
                if held:
                    close(current, held, inner)
                held, inner = [], True
            current, begun = conv, True
            for k in range(n):
                if len(held) >= block:
                    close(conv, held, False)
                    held, inner = [], False
                held.append((turn, initial, fault if fault == "blank" or first and k == 0 else "duplicate"))
                if len(done) >= 500:
                    yield packed(done, names, [kind, pa.int32(), pa.int64(), *BLOCK.values()])
                    done = []
        if held:
            close(current, held, False)
        if done:
            yield packed(done, names, [kind, pa.int32(), pa.int64(), *BLOCK.values()])

    blocks = rows.mapInArrow(solve, f"id {id_ddl}, {BLOCK_DDL}").repartition("id").sortWithinPartitions("id", "part", "place")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, current, joined = pa.null(), [], None, None
        out = lambda: packed(done, ["id", "gaps", *COUNTS, "cost", "audit"], [kind, *[pa.int64()] * 6, pa.string()])
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in batch.to_pylist():
                if joined and row["id"] != current:
                    done.append((current, *joined.result()))
                    joined = None
                    if len(done) >= 500:
                        yield out()
                        done = []
                current, joined = row["id"], joined or Joined()
                joined.add(row)
        if joined:
            done.append((current, *joined.result()))
            yield out()

    counts = ", ".join(f"{c} long" for c in ("gaps", *COUNTS, "cost"))
    return blocks.mapInArrow(compose, f"id {id_ddl}, {counts}, audit string").withColumnRenamed("id", id_col)


def repaired_turns(df: DataFrame, found: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id_col, position long (from 0), edit (K, R or I), role, text: the turns that the audits of `found` leave of df.

    The rows of an id stand together and in order within a task, so that what reads them by mapInArrow needs no shuffle. A
    conversation streams through one task and isn't held in memory (a digest of it can only be taken in order)."""
    rows = prepared(df, id_col, turn_col, role_col, text_col).select("id", F.lit(1).alias("what"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")
    none = F.lit(None).cast("string")
    heads = found.select(F.col(id_col).alias("id"), F.lit(0).alias("what"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("digest"), F.col("audit").alias("text"))
    order = ["id", "what", "turn", "role", "digest"]
    both = heads.unionByName(rows).repartition("id").sortWithinPartitions(*order).select("id", "what", "role", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position = "", 0, START, 0
        for batch in batches:
            done = []

            def insert(conv):
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    role, state = NEXT[state]
                    done.append((conv, position, "I", role, ""))
                    at, position = at + 1, position + 1

            for conv, what, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == 0:
                    audit, at, state, position = text, 0, START, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        kept = edit == "K" and role.startswith("s")
                        wanted, state = (role, SYSTEM) if kept else NEXT[state]
                        done.append((conv, position, edit, role if edit == "K" else wanted, text))
                        position += 1
                insert(conv)
            if done:
                yield packed(done, ["id", "position", "edit", "role", "text"], [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()])

    return both.mapInArrow(apply, f"id {df.schema[id_col].dataType.simpleString()}, position long, edit string, role string, text string").withColumnRenamed("id", id_col)


def digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id_col, repaired_sha256: of the lines `role:text` of each id in turns, which are as repaired_turns gives them."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, current, kind, done = None, None, pa.null(), []
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if digest:
                        done.append((current, digest.hexdigest()))
                    digest, current = hashlib.sha256(), conv
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield packed(done, [id_col, "repaired_sha256"], [kind, pa.string()])
                done = []
        if digest:
            yield packed([(current, digest.hexdigest())], [id_col, "repaired_sha256"], [kind, pa.string()])

    return turns.select(id_col, "position", "role", "text").mapInArrow(take, f"`{id_col}` {turns.schema[id_col].dataType.simpleString()}, repaired_sha256 string")


def repair_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(what audits() gives, what repaired_turns() gives); the audits are written to the shared folder, as both read them."""
    names = {"id_col": id_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    found = stored(audits(df, **names, block=block))
    return found, repaired_turns(df, found, **names)


def damaged(df: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text) with the faults that a checksum of their place plants: a row
    is dropped, emptied, robbed of its `.!?`, repeated or given to the user; null roles and texts are one space."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", show("role").alias("role"), show("text").alias("text"), (F.crc32(F.concat(show("conv_id"), F.lit(":"), show("turn")).cast("binary")) % 20).alias("lot"))
    lot = F.col("lot")
    text = F.when(lot == 1, "").when(lot == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where(lot != 0).select("conv_id", "turn", F.when(lot == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(lot == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")

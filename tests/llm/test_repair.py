"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

from tracewell.llm import queries, repair
from tracewell.llm.shared import table

WHOLE = re.compile("(s?(ua)+)?")
TEXTS = ["Yes.", "No?", "cut off", "", " \n\t", "Yes.", "wait!  \n", "x", None]
ROLES = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]


def brute(rows):
    """Least (cost, audit, repaired lines) of (role, text, fault), by all edits and up to three insertions at each place."""
    seen, best = set(), None
    insertable = [c for n in range(4) for c in product(("user", "assistant"), repeat=n)]

    def walk(i, cost, audit, out):
        nonlocal best
        state = "".join(r[:1] or "-" for r, _ in out)
        # Whatever can still become whole begins like a whole sequence.
        if not any(WHOLE.fullmatch(state + tail) for tail in ("", "a", "ua")) or best and cost > best[0]:
            return
        if i == len(rows):
            if WHOLE.fullmatch(state) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [f"{r}:{t}" for r, t in out]
            return
        role, text, fault = rows[i]
        steps = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            steps += [(extra, "K", [(role, text)])] + [(2 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
        for c, e, kept in steps:
            for more in insertable:
                walk(i + 1, cost + c + 2 * len(more), audit + e + "I" * len(more), out + kept + [(r, "") for r in more])

    for more in insertable:
        walk(0, 2 * len(more), "I" * len(more), [(r, "") for r in more])
    return best


def expected(rows):
    """{conv: what the query gives} of damaged (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in own:
            body = text.strip(repair.BLANKS)
            marked.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = brute(marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(df, **options):
    found, turns = repair.repair_conversations(df, **options)
    hashes = {r[0]: r[1] for r in repair.digests(turns, options.get("id_col", "conv_id")).collect()}
    return {r[0]: (*r[1:], hashes.get(r[0], hashlib.sha256(b"").hexdigest())) for r in found.collect()}


def some_rows(seed, conversations=25, most=5):
    rnd = random.Random(seed)
    return [(c if c else None, rnd.choice([None, *range(4)]) if rnd.random() < 0.5 else t, rnd.choice(ROLES), rnd.choice(TEXTS)) for c in range(conversations) for t in range(rnd.randint(1, most))]


DDL = "conv_id long, turn long, role string, text string"


def test_equals_all_edits(spark):
    for seed in (1, 2):
        rows = some_rows(seed)
        assert run(spark.createDataFrame(rows, DDL)) == expected(rows)


def test_blocks_of_a_long_conversation(spark):
    """One conversation with most rows, dealt over tasks and blocks, is what one block gives; so is one of equal rows."""
    rnd = random.Random(3)
    rows = [(7, t // 2, rnd.choice(ROLES[:4]), f"{rnd.choice(TEXTS[:4])} {rnd.randrange(40)}{rnd.choice('.!, ')}") for t in range(600)]
    rows += [(8, 1, "user", "Same.")] * 90 + some_rows(5)
    df = spark.createDataFrame(rows, DDL)
    whole = run(df, block=10_000)
    assert {k: v for k, v in whole.items() if k not in (7, 8)} == expected([r for r in rows if r[0] not in (7, 8)])
    assert whole[8][:3] == (0, 0, 89) and len(whole[8][6]) == 91 and whole[8][6].count("D") == 89
    for block in (1, 7, 64):
        assert run(df, block=block) == whole


def test_search_meets_in_the_middle():
    """Both searches together give what the forward one alone finds, from and to each state."""
    rnd = random.Random(6)

    def forward(rows, start, ends):
        labels = {start: (0, "")}
        for i in range(len(rows) + 1):
            for q in (repair.START, repair.SYSTEM, repair.PAIRS, repair.OPEN, repair.PAIRS, repair.OPEN):
                if q in labels:
                    to = repair.NEXT[q][1]
                    labels[to] = min(labels.get(to, (999, "")), (labels[q][0] + 2, labels[q][1] + "I"))
            if i < len(rows):
                after = {}
                for q, (c, a) in labels.items():
                    for e, to, more in repair.edges(*rows[i])[0][q]:
                        after[to] = min(after.get(to, (999, "")), (c + more, a + e))
                labels = after
        return min((labels[q] for q in ends if q in labels), default=None)

    for _ in range(300):
        rows = [(rnd.choice("suax"), rnd.random() < 0.3, rnd.random() < 0.3) for _ in range(rnd.randint(0, 9))]
        for p in range(4):
            for ends in ((0,), (1,), (2,), (3,), (0, 3)):
                assert repair.search(rows, p, ends) == forward(rows, p, ends), (rows, p, ends)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert run(empty) == {}
    odd = spark.createDataFrame([("a", "2", "user", "Hi.", "x"), ("a", "one", "assistant", "Hello.", "y"), ("b", None, None, None, "z")], "name string, no string, what string, said string, id string")
    got = run(odd, id_col="name", turn_col="no", role_col="what", text_col="said")
    assert got["a"][:7] == (0, 0, 0, 0, 0, 4, "IKKI")
    assert got["b"][:7] == (0, 1, 0, 0, 0, 3, "D")
    long = "word " * 200_000
    assert run(spark.createDataFrame([(1, 0, "user", long + "."), (1, 1, "assistant", long)], DDL))[1][5:7] == (1, "KK")
    clash = spark.createDataFrame([(1, 0, "user", "a.", 1, "q", 2), (1, 1, "assistant", "b.", 1, "q", 2)], DDL + ", id long, digest string, fault long")
    assert run(clash)[1][5:7] == (0, "KK")


def test_query_equals_all_edits(spark, sf_dir):
    whole = [tuple(r) for r in table(spark, sf_dir, "conversations").collect()]
    rows = []
    for conv, turn, role, text in whole:
        lot = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        kept = (conv, turn, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
        rows += [kept] * (0 if lot == 0 else 2 if lot == 3 else 1)
    want = expected(rows)
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, sf_dir).collect()} == {c: want.get(c, gone) for c in {r[0] for r in whole}}

"""Packing: valid and tight sequences; the pipeline stage by stage against brute force."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_near_copies import brute_roots
from tracewell.llm import packing, queries
from tracewell.llm.shared import table, tokenizer_path

WORD = "word_bpe_49k.json"


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def check_pieces(rows, texts, capacity):
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(tokenizer_path(WORD)), []
    for doc, text in texts:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(doc, k, at, len(p := ids[at : at + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=str) == sorted(want, key=str)


def test_completion_finds_the_least_waste():
    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.randint(3, 30) for _ in range(rnd.randint(0, 9))]
        room = rnd.randint(0, 70)
        left = {s: sizes.count(s) for s in set(sizes)}
        best = max(sum(c) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= room)
        got, whole = packing.completion(room, left, None)
        assert whole and sum(got) == best
        assert all(got.count(s) <= left[s] for s in got)
    assert packing.completion(23, {10: 3, 7: 3, 4: 3}, 1)[1] is False


def fewest(sizes, capacity):
    """By trying all packings."""
    sizes, best, rooms = sorted(sizes, reverse=True), len(sizes), []

    def put(k):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[k]}.values():
            rooms[j] -= sizes[k]
            put(k + 1)
            rooms[j] += sizes[k]
        rooms.append(capacity - sizes[k])
        put(k + 1)
        rooms.pop()

    put(0)
    return best


def histogram(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


def test_no_packing_has_fewer_sequences():
    rnd, above = random.Random(3), 0
    for _ in range(1500):
        capacity = rnd.choice((20, 30, 60, 100))
        sizes = [rnd.randint(max(1, capacity // rnd.choice((3, 5, 10))), capacity * rnd.choice((5, 7, 10)) // 10) for _ in range(rnd.randint(0, 11))]
        plan = packing.bin_completion(histogram(sizes), capacity, None, None)
        assert sorted(s for f, n in plan.fillings for s in f * n) == sorted(sizes)
        assert all(sum(f) <= capacity for f, _ in plan.fillings) and plan.sequences == sum(n for _, n in plan.fillings)
        assert plan.proved and not plan.cut
        assert plan.sequences == (least := fewest(sizes, capacity)) and plan.bound <= least
        above += plan.bound < least
    assert above > 20  # not all are settled by the bound


def test_branching_mends_a_greedy_packing():
    sizes = [50, 45, 40, 40, 30, 26, 25, 24, 20]
    assert packing.bin_completion(histogram(sizes), 100, branch_nodes=0).sequences == 4
    assert packing.bin_completion(histogram(sizes), 100, branch_nodes=0).cut == 1
    assert packing.bin_completion(histogram(sizes), 100).sequences == 3


def test_few_sequences():
    rnd = random.Random(2)
    sizes = [rnd.randint(1, 100) for _ in range(5000)]
    plan = packing.bin_completion(histogram(sizes), 100)
    assert sorted(s for filling, n in plan.fillings for s in filling * n) == sorted(sizes)
    assert plan.bound <= plan.sequences <= 1.01 * plan.bound
    assert sum(n for _, n in packing.best_fit_decreasing(histogram(sizes), 100)) <= 1.02 * plan.bound
    big = packing.bin_completion({700: 10**9, 300: 10**9 + 7, 1: 5}, 1000)
    assert big.sequences == big.bound == 10**9 + 3 and len(big.fillings) < 20
    rare = [rnd.randint(1000, 1400) for _ in range(300)]
    plan = packing.bin_completion(histogram(rare), 4096, 50, 50)
    assert plan.cut and not plan.proved and plan.sequences >= plan.bound


def test_groups_of_a_hot_length(spark):
    """One length, and one row, that most pieces share."""
    df = spark.createDataFrame([(5, 0, 100)] * 3000 + [(None, 0, 100)] * 2000 + [(k, 0, 1 + k % 90) for k in range(500)], "doc_id long, piece int, length long")
    rows = packing.pack(df, 256).collect()
    n = check_sequences(rows, 256)
    assert len(rows) == 5500 and n == packing.bin_completion(histogram([r["length"] for r in rows]), 256).sequences
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5500


def test_edges(spark):
    texts = [(1, "one two three " * 40), (2, None), (2, ""), (None, "null id"), (3, "w " * 5000), (1, "one two three " * 40)]
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in texts], "doc_id long, text string, offset int, length string")
    rows = packing.pack(packing.cut_pieces(df, tokenizer_path(WORD), 64), 64).collect()
    check_pieces(rows, texts, 64)
    check_sequences(rows, 64)
    assert packing.pack(packing.cut_pieces(df.limit(0), tokenizer_path(WORD), 64), 64).collect() == []


def test_columns_of_any_name(spark):
    names = ["doc_id", "piece", "length", "__place", "__groups", "__rank", "place", "group", "k", "c0", "sequence_id", "a.b"]
    df = spark.createDataFrame([(d, 0, 1000 + d, *range(9)) for d in range(20)], ", ".join(f"`{n}` {'long' if n in ('doc_id', 'length') else 'int'}" for n in names))
    got = packing.pack(df, 4096)
    assert got.columns == [*[n for n in names if n != "sequence_id"], "sequence_id", "offset"]
    rows = got.collect()
    assert len(rows) == 20 and all(r["__rank"] == 2 and r["a.b"] == 8 for r in rows) and len({r["sequence_id"] for r in rows}) == 5
    with pytest.raises(ValueError):
        packing.pack(df.drop("piece"), 4096)


def test_stages_on_odd_tables(spark, sf_dir):
    """Null ids and texts, blanks, a long text, repeated rows, columns with clashing names; and an empty table."""
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    rows = docs.limit(40).select("*", F.lit(1).alias("__p"), F.lit(2).alias("__q"), F.lit(3).alias("row"), F.lit(4).alias("verdict"))
    row = rows.where("text is not null").first().asDict()
    odd = [row | {"doc_id": None}, row | {"text": None, "doc_id": 900_001}, row | {"text": "", "doc_id": 900_002}, row | {"text": " 12 \n", "doc_id": 900_003}, row | {"text": row["text"] + " word" * 50_000, "doc_id": 900_004}, row, row]
    whole = rows.unionByName(spark.createDataFrame([tuple(r[c] for c in rows.columns) for r in odd], rows.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, whole, sf_dir)
        assert got.columns == whole.columns, name
        kept = got.collect()
        assert all((r["__p"], r["__q"], r["row"], r["verdict"]) == (1, 2, 3, 4) for r in kept) and set(kept) <= set(whole.collect()), name
        if name == "language":
            assert not {r["doc_id"] for r in kept} & {900_001, 900_002, 900_003}
        if name == "near_duplicates":
            assert len({r["doc_id"] for r in kept}) == len(kept)
        assert stage(spark, whole.limit(0), sf_dir).collect() == [], name
    pieces = corpus_pipeline.STAGES[-1][1](spark, whole, sf_dir).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces) >= whole.count()
    assert corpus_pipeline.STAGES[-1][1](spark, whole.limit(0), sf_dir).collect() == []


def test_query(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    rows = queries.op8_packing(spark, sf_dir).collect()
    check_pieces(rows, texts, 4096)
    n = check_sequences(rows, 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    steps = []
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        steps.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    whole = {tuple(r) for r in table(spark, sf_dir, "documents").collect()}
    assert all(tuple(r) in whole for r in steps[0])
    lang = {r["doc_id"] for r in queries.op2_language_id(spark, sf_dir).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r["doc_id"] for r in steps[0]} == lang
    label = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    before, after = ({r["doc_id"] for r in s if label.get(r["doc_id"]) == 1} for s in steps[:2])
    assert len(after) >= 0.97 * len(before)
    rows = sorted(steps[1], key=lambda r: r["doc_id"])
    roots = brute_roots([r["text"] for r in rows])  # shingles of five words, a similarity of 0.8
    assert sorted(r["doc_id"] for r in steps[2]) == [rows[k]["doc_id"] for k in sorted(set(roots))]
    packed = p.run(spark, sf_dir).collect()
    check_pieces(packed, [(r["doc_id"], r["text"]) for r in steps[2]], p.CAPACITY)
    check_sequences(packed, p.CAPACITY)

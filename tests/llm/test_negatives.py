"""Hard negatives against all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import negatives, queries, shared
from tracewell.llm.shared import table


def brute(rows, least=80, scale=256, k=5):
    """Rows of mine() for (id, vector, label) with even ids as anchors."""
    good = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in good:
        if i % 2:
            continue
        scored = sorted((-max(-negatives.LONG, min(negatives.LONG, sum(a * b for a, b in zip(v, w, strict=True)))), j, d == c) for j, w, d in good if j != i and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2]][:k]:
            near = [(n, nid) for n, nid, same in scored if not same and least * -p <= 100 * -n <= 100 * -p][:k]
            out += [(i, pid, r + 1, nid, -p, -n) for r, (n, nid) in enumerate(near)]
    return sorted(out)


def vectors(seed, n=120, dim=20, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(int(i), (centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.1, 0.8])).tolist(), int(rng.integers(labels))) for i in rng.permutation(n)]
    return rows


DDL = "vec_id long, embedding array<double>, label int"


def run(spark, rows, **options):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, DDL), F.col("vec_id") % 2 == 0, **options).collect()))


@pytest.mark.parametrize("block", [16])
def test_equals_all_pairs(spark, block):
    rows = vectors(1)
    assert run(spark, rows, block=block) == brute(rows) != []


def test_ties_repeats_and_rows_without_part(spark):
    rows = [(i, [1.0, float(i % 3), 0.5], i % 2) for i in range(14)]
    rows += [(3, [1.0, 0.0, 0.5], 1), (4, [1.0, 1.0, 0.5], 0), (20, [1.0, 2.0], 0), (21, [1.0, 2.0], 1), (22, [1.0, 2.0], 0), (23, [], 0), (24, [], 0), (25, [], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (30, None, 1), (31, [1.0, None, 1.0], 1), (32, [1.0, float("nan"), 1.0], 1), (33, [1.0, float("inf"), 1.0], 0), (34, [1.0, 1.0, 1.0], None), (36, [-1.0, -1.0, -1.0], 9)]
    assert run(spark, rows, block=4) == brute(rows) != []


def test_products_beyond_floats(spark):
    rows = [(i, [3.0e9 + i, 1.0e9 * (i % 3)], i % 2) for i in range(10)]
    assert run(spark, rows) == brute(rows) != []


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(2, [1.0], 1)]) == []


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, -0.5])
def test_pairs(share):
    rng = np.random.default_rng(5)
    a, b = np.floor(rng.normal(size=(30, 37)) * 50), np.floor(rng.normal(size=(200, 37)) * np.exp(-np.arange(37) / 6) * 50)
    b[:20] = a[:20] // 2
    score = a @ b.T
    bars = share * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max() / 4
    i, j, s = negatives.pairs(a, b, bars)
    assert sorted(zip(i, j, s, strict=True)) == sorted((x, y, score[x, y]) for x, y in zip(*np.nonzero(score >= bars[:, None]), strict=True))


def test_lists_leave_out_dimensions(monkeypatch):
    """With a high bar most of a row's small dimensions aren't in the lists."""
    b = np.floor(np.random.default_rng(1).normal(size=(64, 64)) * np.exp(-np.arange(64) / 4) * 1000)
    left = negatives.tails(b)
    indexed = (left[:, :-1] * np.linalg.norm(b, axis=1).max() >= 0.5 * np.linalg.norm(b, axis=1).max() ** 2).sum(1)
    assert indexed.max() < 8 and (indexed == 0).any()


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(queries.SQL_OP11)
    names = [c[0] for c in want.description]
    got = queries.op11_hard_negatives(spark, sf_dir).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) != []
    assert table(spark, sf_dir, "embeddings").count() > 0


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Joins of anchors, windows and row blocks stay off the driver, however small Spark takes them to be."""
    written = []

    def keep(df, codec="lz4"):
        written.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return shared.stored(df, codec)

    monkeypatch.setattr(negatives, "stored", keep)
    out = negatives.mine(spark.createDataFrame(vectors(2), DDL), F.col("vec_id") % 2 == 0, block=16)
    plans = [*written, out._jdf.queryExecution().executedPlan().toString()]
    joins = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert any("SortMergeJoin" in p for p in plans)
    assert all("[dim#" in line and "[key#" not in line and "group#" not in line for line in joins), joins

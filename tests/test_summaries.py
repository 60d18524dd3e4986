"""Joins of runs, answers and truths: repeats, absences, ties, gates."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import datasets as ds
from tracewell.operators import runs
from tracewell.operators import summaries as sm


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_golden(spark):
    golden = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "id string, q int")
    asked = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "id string")
    assert rows(sm.join_golden(asked, golden, "id")) == rows(spark.createDataFrame([("a", 1, False), ("a", 1, False), ("c", None, True), (None, None, True)], "id string, q int, unmatched boolean"))
    assert rows(sm.golden_errors(asked, golden, "id")) == [("a", "repeated"), ("c", "unmatched"), (None, "unmatched")]
    with pytest.raises(ValueError):
        sm.join_golden(asked, golden, "id", strict=True)
    assert sm.join_golden(asked.where("id = 'b'"), golden.where("id = 'b'"), "id", strict=True).count() == 0


def test_grids_and_gates(spark):
    e = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, None)], "k int, n string")
    names = sm.catalogue(e, "n")
    assert names == ["x", "y"] and sm.expected_grid(e, "k", names, "n").count() == 4
    assert rows(sm.missing_members(e, e, "k", names, "n")) == [(1, "y"), (2, "x")] and sm.expected_grid(e, "k", [], "n").count() == 0
    with pytest.raises(ValueError):
        sm.catalogue(spark.range(sm.CATALOGUE + 1).select(F.col("id").cast("string").alias("n")), "n")
    assert rows(sm.coverage_gate(e, ["n"], "k", 0.5)) == [("x", 0.5), ("y", 0.5), (None, 0.5)] and rows(sm.coverage_gate(e.limit(0), ["n"], "k")) == []
    cells = spark.createDataFrame([("s", "b", 2.0, 1.0), ("s", "a", 2.0, 1.0), ("s", "c", 9.0, 0.1), ("t", "a", None, 1.0)], "s string, r string, v double, c double")
    assert rows(sm.best_by_metric(cells, ["s"], "r", "v", "c")) == [("s", "a", 2.0)] and rows(sm.best_by_metric(cells, ["s"], "r", "v", "c", 0.0)) == [("s", "c", 9.0)]
    assert rows(sm.pivot_resources(cells, "s", "r", ["a", "b", "z"], "v")) == [("s", 2.0, "1/1", 2.0, "1/1", None, "0/0"), ("t", None, "0/1", None, "0/0", None, "0/0")]


def test_small_joins(spark):
    m = spark.createDataFrame([("r1", 1), ("r2", 2), (None, 3)], "id string, v int")
    q = spark.createDataFrame([("r1", "s2"), ("r1", "s1"), (None, "s9")], "id string, s string")
    assert rows(sm.with_scenario(m, q, "id", "s").select("v", "scenario")) == [(1, "s1"), (2, "unassigned"), (3, "unassigned")]
    a, b = (spark.createDataFrame(x, "k string, y double") for x in ([("p", 0.0), ("q", 2.0)], [("p", 1.0), ("q", 3.0), ("z", 1.0)]))
    assert rows(sm.compare_curves(a, b, ["k"], "y")) == [("p", 0.0, 1.0, None, 1.0), ("q", 2.0, 3.0, 1.5, 1.0)]
    echo = sm.echo_mismatch(m, spark.createDataFrame([("r1", 1), ("r2", None)], "id string, e int"), "id", [F.lit("all").alias("g")], "v", "e")
    assert rows(echo) == [("all", 2, 0.5)]
    assert rows(sm.golden_vs_model(m, q, "id")) == [("r1", 1)] and sm.three_voter_join(m, q, q.withColumnRenamed("s", "t"), "id").count() == 4
    assert rows(sm.mean_curve(m, ["id"], "v")) == [("r1", 1, 1.0), ("r2", 1, 2.0)]
    assert rows(sm.kv_occupancy(m, [], F.col("v") / 4)) == [(50.0, 75.0, 3)]
    assert sm.perplexity(m, [], F.lit(0.0), F.col("v")).first()[0] == 1.0


def test_terciles(spark):
    lengths = spark.createDataFrame([(x,) for x in (1, 2, 3, 20, 21, 22, 100, 101, 102, None)], "n int")
    assert tuple(ds.tercile_thresholds(lengths, "n").first()) == (3, 22)
    assert tuple(ds.tercile_thresholds(lengths.limit(0), "n").first()) == (None, None)
    same = spark.createDataFrame([(5,)] * 7 + [(9,)], "n int")
    assert tuple(ds.tercile_thresholds(same, "n").first()) == (5, 5)


def test_labelled_rows(spark):
    raw = [("HTTPS://www.A.com/x", "One\r\n  two", "['b2b']", "2024-01-02T00:00:00Z"), (None, "t", "['b2b']", "2024-01-02"), ("b", " \n", "['b2b']", "2024-01-02"), ("b", "t", "['b2b', 'zz']", "2024-01-02"), ("b", "t", "[None]", "2024-01-02"), ("b", "t", "['b2b']", "bad"), ("b", None, None, None)]
    clean = ds.cleaned(spark.createDataFrame(raw, "domain string, business_model string, tags string, enriched_at string"), ["b2b"])
    assert rows(ds.eligible(clean).select("domain", "business_model", "n_tags")) == [("a.com", "One\ntwo", 1)]
    assert tuple(ds.quality_counts(clean).first()) == (7, 3, 2, 2, 2, 3) and tuple(ds.quality_counts(clean.limit(0)).first()) == (0, 0, 0, 0, 0, 0)
    df = spark.createDataFrame([(1, "x", "['A ', 'a']"), (2, "x", "['c']"), (3, None, "['c']"), (4, "y", "[]"), (5, "z", "{'c'}")], "k int, business_model string, tags string")
    assert rows(ds.load_labelled(df, ["k"]).select("k", "expected_tags")) == [(1, ["a"])]
    own = df.withColumn("example_id", F.when(F.col("k") > 1, F.lit(7)))
    assert rows(ds.load_labelled(own, ["k"]).select("k", "example_id")) == [(2, "7")]
    with pytest.raises(ValueError):
        ds.load_labelled(df.drop("tags"), ["k"])


def test_planned_blocks(spark):
    plan = runs.expected_blocks(F.col("p"), F.col("s"), F.col("r"), F.col("b"))
    cases = [(None, ["x", "y"], 3, None, 12), ("generic", None, None, None, 0), ("replay", ["x"], 2, {"short": 4, "heavy": 0}, 4), ("replay", ["x"], 2, {"short": 0}, None), ("replay", ["x"], 0, {"a": 1, "b": 2}, 3)]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, p string, s array<string>, r int, b map<string,int>")
    assert {r["k"]: r["n"] for r in df.select("k", plan.alias("n")).collect()} == {k: c[4] for k, c in enumerate(cases)}

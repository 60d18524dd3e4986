"""Scans in blocks against plain windows; prompts and consolidated runs against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import conversations as cv
from tracewell.operators import intervals as iv
from tracewell.operators import runs
from tracewell.operators.scans import blocked_scan


@pytest.mark.parametrize("blocks", [2, 40])
def test_scan_equals_windows(spark, blocks):
    """One key holds most rows; null keys, null values, and columns with the scan's own names."""
    rnd = random.Random(2)
    rows = [("hot", k, rnd.choice([None, *range(-5, 6)]), k) for k in range(3000)] + [(rnd.choice(["a", "b", None]), k, k % 7, -k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, v int, block long").repartition(5)
    w = Window.partitionBy("k").orderBy("t")
    running = F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    want = df.select("*", running.alias("s"), F.lag("v").over(w).alias("p"), F.lead("t").over(w).alias("n"))
    got = blocked_scan(df, ["k"], ["t"], {"s": F.coalesce("v", F.lit(0))}, {"p": "v"}, {"n": "t"}, blocks=blocks)
    key = lambda r: (str(r[0]), r[1])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_hot_runtime_lies_in_many_blocks(spark):
    """All requests of one runtime: as many tasks have rows as there are blocks."""
    rnd = random.Random(4)
    rows = [("r", s := rnd.random() * 1000, s + rnd.random() * 30) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, start_s double, end_s double")
    moves = sorted([(s, 1) for _, s, _ in rows] + [(e, -1) for *_, e in rows])
    most = now = 0
    for _, d in moves:
        now += d
        most = max(most, now)
    assert iv.concurrency(df, "k").collect()[0]["max_in_flight"] == most
    scanned = blocked_scan(df.dropDuplicates(["start_s"]), ["k"], ["start_s"], {"n": F.lit(1)}, blocks=16)
    sizes = [r["count"] for r in scanned.groupBy(F.floor("start_s") > -1, F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and (len(sizes) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true")
    assert iv.concurrency(df.limit(0), "k").collect() == []


def test_prompts(spark, tmp_path):
    rows = [(1, 0, "system", "rule"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", None), (2, 5, "user", "x"), (2, 6, "assistant", "y"), (None, 1, "user", "z"), (3, None, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    read = lambda t: {(r["conv_id"], r["turn"]): (r["n"], r["sha256"]) for r in cv.prompt_digests(t).collect()}
    assert read(turns) == {(1, 1): (2, digest("system:rule", "user:a")), (1, 3): (4, digest("system:rule", "user:a", "assistant:b", "user:")), (2, 5): (1, digest("user:x"))}
    own = spark.createDataFrame([(1, 2, "B")], "conv_id long, turn long, output string")
    assert read(cv.closed_loop(turns, own))[1, 3][1] == digest("system:rule", "user:a", "assistant:B", "user:")
    review = read(cv.review_turns(turns, spark.createDataFrame([(1, "[1]")], "conv_id long, answer string"), "again"))
    assert review[1, 5][1] == digest("system:rule", "user:a", "assistant:b", "user:", "assistant:[1]", "user:again") and review[2, 7][1] == digest("user:x", "assistant:[]", "user:again")
    cv.write_prompts(turns, str(tmp_path / "p"))
    got = {(r["conv_id"], r["turn"]): [tuple(m) for m in r["messages"]] for r in cv.read_prompts(spark, str(tmp_path / "p"), F.col("turn") >= 3).collect()}
    assert got == {(1, 3): [("system", "rule"), ("user", "a"), ("assistant", "b"), ("user", None)], (2, 5): [("user", "x")]}


def test_pairing(spark):
    rows = [(r, s, h) for r in ("a", "b") for s in ("x", "y") for h in ("1", "1", "2", None)]
    df = spark.createDataFrame(rows, "runtime string, scenario string, request_hash string")
    same = {r["signature"] for r in runs.pairing_signature(df).collect()}
    assert len(same) == 1 and tuple(runs.pairing(df).collect()[0]) == (2, 4, 0, True)
    more = df.union(spark.createDataFrame([("a", "x", "1")], df.schema))
    assert len({r["signature"] for r in runs.pairing_signature(more).collect()}) == 2 and runs.pairing(more).collect()[0]["differing"] == 1
    lacking = df.where("runtime = 'a' or scenario = 'x'")
    assert runs.pairing(lacking).collect()[0]["differing"] == 2
    assert runs.pairing(df.where("request_hash is null")).collect()[0]["paired"] is False and runs.pairing(df.limit(0)).collect()[0]["paired"] is False


def test_consolidate(spark):
    meta = "run_id string, created_at string, model string, dataset string, dataset_rows int, seed int, prompt_sha256 string, options string, digest string, size_bytes long, parameter_size string, quantization_level string"
    metadata = spark.createDataFrame([(r, f"2024-01-0{9 - k}", "m-7b-q4_0", "/x/set.csv", 2, 1, "p", "{}", "0123456789", 2 * 10**9, None, None) for k, r in enumerate("abc")], meta)
    performance = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("d", 3.0)], "run_id string, wall double")
    predictions = spark.createDataFrame([(r, f"e{k}", "['t']", "h", 0.5) for r in "abcd" for k in (1, 0)], "run_id string, example_id string, expected_tags string, input_sha256 string, f1 double")
    found, rows = runs.consolidate_evals(metadata, performance, predictions)
    got = runs.require_runs(found).collect()
    sample = hashlib.sha256(b"e0|['t']|h\ne1|['t']|h").hexdigest()
    assert [r["run_id"] for r in got] == ["b", "a"] and {r["sample_sha256"] for r in got} == {sample} and len({r["comparison_id"] for r in got}) == 1
    assert (got[0]["model_label"], got[0]["parameter_size_b"], got[0]["quantization"], got[0]["model_size_gb"], got[0]["dataset_name"]) == ("m-7b-q4_0 [01234567]", 7.0, "q4_0", 2.0, "set")
    assert rows.count() == 4 and set(rows.select("model_label", "f1").distinct().collect()[0]) == {"m-7b-q4_0 [01234567]", 0.5}
    with pytest.raises(ValueError):
        runs.require_runs(runs.consolidate_evals(metadata, performance.limit(0), predictions)[0])


def test_numbers_of_a_repeated_task(spark):
    held = [(k % 7, k, float(k % 3), None if k % 5 else "x", {"k": k}) for k in range(300)] + [(1, 1, 1.0, None, {"k": 1})] * 3
    kinds = "a int, b int, c double, d string, m map<string,int>"
    number = lambda rows: sorted((tuple(r["s"])[:4], r["n"]) for r in iv.numbered(spark.createDataFrame(rows, kinds).coalesce(1), "n").collect())
    show = lambda got: [(repr(s), n) for s, n in got]
    once, again = (number([(a, b, c, d or "", m) for a, b, c, d, m in rows]) for rows in (held, held[::-1]))
    assert show(once) == show(again) and len({n for _, n in once}) == len(held)

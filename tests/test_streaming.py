"""Streaming jobs over files, driven to their end."""

import datetime

from pyspark.sql import functions as F

from tracewell.streaming import jobs


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def at(minute, second=0):
    return datetime.datetime(2026, 1, 1, 10, minute, second)


def test_correlate(spark, tmp_path):
    s = stream(spark, [("e", 1, at(1), "m", 1.0), ("e", 2, at(9), "m", 1.0)], "experiment_id string, sample_id int, ts timestamp, metric string, value double", str(tmp_path / "s"))
    r = stream(spark, [("e", "r1", at(0), at(2), at(0, 30), None)], "experiment_id string, request_uid string, start_ts timestamp, end_ts timestamp, first_ts timestamp, last_ts timestamp", str(tmp_path / "r"))
    assert [(x["sample_id"], x["observed_phase"]) for x in run(jobs.correlate(s, r), "correlated")] == [(1, "decode_observed")]


def test_correlate_outside_and_long(spark, tmp_path):
    kinds = "experiment_id string, sample_id int, ts timestamp, metric string, value double"
    late = datetime.datetime(2026, 1, 4)
    s = stream(spark, [("e", 1, at(9), "m", 1.0), ("f", 2, at(1), "m", 1.0), ("e", 3, datetime.datetime(2026, 1, 3, 9), "m", 1.0), ("e", 4, None, "m", 1.0), ("z", 5, late, "m", 1.0)], kinds, str(tmp_path / "s"))
    r = stream(spark, [("e", "long", at(5), datetime.datetime(2026, 1, 3, 10), at(8), None), ("e", "two", at(9), at(9), None, None), ("e", "odd", at(9), None, None, None), ("z", "last", late, late, None, None)], "experiment_id string, request_uid string, start_ts timestamp, end_ts timestamp, first_ts timestamp, last_ts timestamp", str(tmp_path / "r"))
    got = sorted((x["sample_id"], x["request_uid"], x["observed_phase"]) for x in run(jobs.correlate(s, r), "outer_join"))
    none = "request_without_first_content"
    # A request of two days, one that starts and ends at the sample's moment, and a sample outside all, told by the watermark.
    assert [x for x in got if x[0] != 2] == [(1, "long", "decode_observed"), (1, "two", none), (3, "long", "decode_observed"), (5, "last", none)]
    assert [x for x in got if x[0] == 2] == [(2, None, "outside_request")]


def test_closed_windows_once(spark, tmp_path):
    schema, log, out, mark = "ts timestamp, metric string, value double", *(str(tmp_path / n) for n in ("log", "out", "mark"))
    found, dropped = [], 0
    for rows in ([(at(0, 1), "m", 1.0), (at(0, 9), "m", 3.0), (at(20), "m", 5.0)], [(at(0, 30), "m", 9.0), (at(20, 30), "m", 7.0), (at(50), "m", 0.0)]):
        query = jobs.replay(jobs.keep_closed(jobs.rolling(stream(spark, rows, schema, log)), out, mark))
        dropped += jobs.late_rows(query)
        found.append(sorted((r["start"].minute, r["n"], r["mean"]) for r in spark.read.parquet(out).collect()))
    assert found == [[(0, 2, 2.0)], [(0, 2, 2.0), (20, 2, 6.0)]]  # the late row of minute 0 changes nothing
    assert dropped == 1


def test_gauges_over_batches(spark, tmp_path):
    schema, log, out, mark = "agent_id string, arrival_ts timestamp, start_ts timestamp, end_ts timestamp", *(str(tmp_path / n) for n in ("log", "out", "mark"))
    first = [("a", at(0), at(1), at(4)), ("a", at(1), None, at(2)), ("a", at(2), at(2), at(30)), ("b", at(0), at(0), at(1)), (None, at(0), at(0), at(1)), ("b", at(0), at(0), None), ("b", None, at(0), at(1))]
    seen = []
    for rows in (first, [("b", at(31), at(32), at(33)), ("c", at(59), at(59), at(59))]):
        s = stream(spark, rows, schema, log)
        with jobs.keyed_state(spark):
            jobs.replay(jobs.keep_closed(jobs.gateway_gauges(s), out, mark))
        read = spark.read.parquet(out)
        seen.append(sorted((r["agent_id"], r["start"] // 60 % 60, r["in_flight"], r["waiting"]) for r in read.collect()))
    a, b = [("a", 0, 0, 1), ("a", 1, 1, 1), ("a", 2, 2, 0), ("a", 4, 1, 0)], [("b", 0, 1, 0), ("b", 1, 0, 0)]
    assert seen[0] == a + b
    assert seen[1] == [*a, ("a", 30, 0, 0), *b, ("b", 31, 0, 1), ("b", 32, 1, 0), ("b", 33, 0, 0)]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_windows(spark, tmp_path):
    rows = [(at(0, 1), "m", 1.0), (at(0, 50), "m", 3.0), (at(1, 5), "m", 5.0)]
    s = stream(spark, rows, "ts timestamp, metric string, value double", str(tmp_path / "w"))
    assert {(r["start"], r["n"], r["mean"]) for r in run(jobs.rolling(s), "tumbling", "complete")} == {(at(0), 2, 2.0), (at(1), 1, 5.0)}
    assert len(run(jobs.rolling(s, "1 minute", "30 seconds"), "sliding", "complete")) == 4
    g = s.select("ts", F.col("metric").alias("agent_id"), F.lit(429).alias("status"))
    assert {r["n"] for r in run(jobs.gateway_counters(g), "gateway", "complete")} == {1, 2}
    u = s.select("ts", F.col("metric").alias("user_id"))
    assert [r["n"] for r in run(jobs.sessions(u), "sess", "complete")] == [3]


def test_latest_and_history(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "id string, pos int, ok boolean"
    df = stream(spark, [("a", 1, False), ("b", 2, True)], schema, log)
    out, mark = str(tmp_path / "latest"), str(tmp_path / "mark")
    for more in ([], [("a", 3, True)]):
        if more:
            stream(spark, more, schema, log)
        jobs.upsert_latest(df, out, "id", "pos", mark).trigger(availableNow=True).start().awaitTermination(120)
        got = {r["id"]: r["pos"] for r in jobs.newest_rows(spark, out).collect()}
    assert got == {"a": 3, "b": 2}
    versions = jobs.bucket_versions(spark, out)
    assert sorted(v for vs in versions.values() for v in vs) == [0, 0, 1]  # only the bucket of "a" was written again
    turns = stream(spark, [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(14)] + [(2, 0, "system", "s"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string", str(tmp_path / "turns"))
    rows = run(jobs.last_n_history(turns, 10), "history", "update")
    assert [(r["conv_id"], [m["turn"] for m in r["messages"]]) for r in rows] == [(1, list(range(4, 14)))]


def test_monitor(spark, tmp_path):
    rows = [("smoke", "llama", 1, "old", 1, 2), ("smoke", "llama", 2, "new", 2, 2)]
    s = stream(spark, rows, "stage string, runtime string, started int, run_id string, ok int, expected int", str(tmp_path / "m"))
    assert [(r["run_id"], r["ok"]) for r in run(jobs.campaign_monitor(s), "monitor", "complete")] == [("new", 2)]

"""Queries that write files and read them back, replay a table as a stream to its end, read nested documents, or fit a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import runs
from ..operators.latency_model import fit_latency_regressor
from ..sources import tables as io
from ..streaming import jobs
from . import base
from .base import query


@query("""
, runs AS (SELECT run_id, scenario, count(*) AS n, sum(output_tokens) AS tokens FROM requests GROUP BY ALL)
SELECT 'run=' || run_id AS experiment_id, CAST(n AS VARCHAR) AS n, scenario, CASE WHEN run_id % 2 = 1 THEN CAST(tokens AS VARCHAR) ELSE '' END AS tokens FROM runs
""")
def s1_read_summaries(spark, sf):
    """Summaries of runs as CSV files of two shapes, one folder a run, read as one table."""
    folder = io.shared_folder(spark)
    n = base.requests(spark, sf).groupBy("run_id", "scenario").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"))
    n = n.withColumn("run", F.col("run_id"))
    for odd, columns in ((0, ["n", "scenario"]), (1, ["scenario", "n", "tokens"])):
        n.where(F.col("run_id") % 2 == odd).select("run", *columns).write.option("header", True).partitionBy("run").csv(f"{folder}/{odd}")
    return io.read_summaries(spark, folder, name="*.csv").select("experiment_id", "n", "scenario", "tokens")


@query("SELECT k.kind, CAST(c_custkey AS VARCHAR) AS custkey, c_mktsegment AS segment FROM customer CROSS JOIN (VALUES ('csv'), ('jsonl'), ('parquet')) k(kind)")
def s3_read_company_export(spark, sf):
    """Companies in three kinds of files, read as JSON records."""
    folder = io.shared_folder(spark)
    c = io.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    c.write.option("header", True).option("escape", '"').csv(f"{folder}/x.csv")
    c.write.parquet(f"{folder}/x.parquet")
    io.write_lines(io.message_lines(c, c.columns), f"{folder}/x.jsonl")
    parts = [io.read_company_export(spark, f"{folder}/x.{kind}").withColumn("kind", F.lit(kind)) for kind in ("csv", "jsonl", "parquet")]
    return parts[0].union(parts[1]).union(parts[2]).select("kind", F.get_json_object("record", "$.c_custkey").alias("custkey"), F.get_json_object("record", "$.c_mktsegment").alias("segment"))


@query("""
, r AS (SELECT run_id, count(*) AS n, CASE WHEN run_id = 3 THEN 'partial' ELSE 'complete' END AS status FROM requests GROUP BY run_id)
SELECT 'run=' || run_id AS run, kind, CASE WHEN kind = 'manifest' AND run_id = 4 THEN 'invalid JSON' END AS error, CASE WHEN kind = 'dataset-manifest' THEN status WHEN run_id <> 4 THEN 'n' || n END AS said
FROM r CROSS JOIN (VALUES ('dataset-manifest'), ('manifest')) k(kind) WHERE kind = 'manifest' OR run_id <> 5
""")
def s4_read_manifests(spark, sf):
    """Manifests of runs as JSON files below each run's folder json, one of them broken, one missing, beside other files."""
    folder = io.shared_folder(spark)
    r = base.requests(spark, sf).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("run", F.col("run_id"))
    declared = F.to_json(F.struct(F.when(F.col("run_id") == 3, "partial").otherwise("complete").alias("status")))
    final = F.when(F.col("run_id") == 4, "{oops").otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("n"), F.col("n")).alias("status")).alias("run"))))
    documents = r.select("run", "run_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("dataset-manifest", "manifest", "other"))), F.array(declared, final, F.lit("{}")))).alias("kind", "document"))
    documents = documents.where((F.col("run_id") != 5) | (F.col("kind") != "dataset-manifest")).select("run", F.lit(1).alias("json"), "kind", "document")
    documents.write.partitionBy("run", "json", "kind").text(folder)
    said = tx.first_scalar(F.col("document"), "$.status", "$.run.status")
    return io.read_manifests(spark, folder, "*.txt", deep=1).select("run", "kind", "error", said.alias("said"))


def event_stream(spark, sf):
    return io.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def closed(spark, result):
    """What a stream's watermark has closed when its source is read to the end, each row written once."""
    folder = io.shared_folder(spark)
    jobs.replay(jobs.keep_closed(result, f"{folder}/out", f"{folder}/mark"))
    return spark.read.schema(result.schema).parquet(f"{folder}/out").drop("v")  # v: the batch's folder


def whole(spark, result):
    """A stream's whole result over all that its source holds."""
    folder = io.shared_folder(spark)
    jobs.replay(jobs.keep_whole(result, f"{folder}/out", f"{folder}/mark"))
    return jobs.newest_version(spark, f"{folder}/out")


@query("""
, r AS (SELECT user_id, event_id AS request_uid, epoch_us(ts) AS a, epoch_us(ts) + 1000 * CAST(floor(value * 600000) AS BIGINT) AS b,
    CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) + 1000 * CAST(floor(value * 60000) AS BIGINT) END AS f, CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) + 1000 * CAST(floor(value * 540000) AS BIGINT) END AS l
    FROM events WHERE event_type = 'signup'),
s AS (SELECT user_id, event_id AS sample_id, event_type AS metric, epoch_us(ts) AS t FROM events WHERE event_type <> 'signup' AND ts IS NOT NULL),
passed AS (SELECT least((SELECT max(t) FROM s), (SELECT max(greatest(a, b // 3600000000 * 3600000000)) FROM r)) // 1000 * 1000 - 600000000 AS w)
SELECT sample_id, metric, request_uid, CASE WHEN request_uid IS NULL THEN 'outside_request' WHEN f IS NULL THEN 'request_without_first_content' WHEN t < f THEN 'prefill_observed' WHEN l IS NULL OR t <= l THEN 'decode_observed' ELSE 'response_close' END AS observed_phase
FROM s LEFT JOIN r ON s.user_id = r.user_id AND t BETWEEN a AND b WHERE request_uid IS NOT NULL OR t <= (SELECT w FROM passed)
""")
def st1_live_correlation(spark, sf):
    """Two streams of the event table, samples and request intervals, joined with watermarks; samples outside all requests come
    when their time has passed."""
    e = event_stream(spark, sf)
    later = lambda ms: f"timestamp_micros(unix_micros(ts) + 1000 * floor(value * {ms}))"
    requests = e.where("event_type = 'signup'").select(
        F.col("user_id").alias("experiment_id"), F.col("event_id").alias("request_uid"), F.col("ts").alias("start_ts"), F.expr(later(600000)).alias("end_ts"),
        F.expr(f"CASE WHEN event_id % 10 <> 0 THEN {later(60000)} END").alias("first_ts"), F.expr(f"CASE WHEN event_id % 13 <> 0 THEN {later(540000)} END").alias("last_ts"),
    )
    samples = event_stream(spark, sf).where("event_type <> 'signup'").select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("sample_id"), "ts", F.col("event_type").alias("metric"), "value")
    found = jobs.correlate(samples, requests).select("sample_id", "metric", "request_uid", "observed_phase")
    folder = io.shared_folder(spark)
    jobs.replay(found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark"))
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query("""
, w AS (SELECT *, unnest([epoch_us(ts) // 1800000000 * 1800, epoch_us(ts) // 1800000000 * 1800 - 1800]) AS start FROM events WHERE ts IS NOT NULL)
SELECT start, event_type AS metric, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM w GROUP BY ALL
""")
def st2_rolling(spark, sf):
    """Windows of an hour that start every half hour."""
    s = event_stream(spark, sf).select("ts", F.col("event_type").alias("metric"), "value")
    out = jobs.rolling(s, "1 hour", "30 minutes").select(F.unix_seconds("start").alias("start"), "metric", "n", F.round("mean", 6).alias("mean"), "max")
    return whole(spark, out)


@query("""
, w AS (SELECT *, unnest([epoch_us(ts) // 1800000000 * 1800, epoch_us(ts) // 1800000000 * 1800 - 1800]) AS start FROM events WHERE ts IS NOT NULL)
SELECT start, event_type AS metric, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM w
WHERE (start + 3600) * 1000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events) GROUP BY ALL
""")
def st2_rolling_closed(spark, sf):
    """The same windows in append mode: each once, when it is closed, and none kept in state for ever."""
    s = event_stream(spark, sf).select("ts", F.col("event_type").alias("metric"), "value")
    return closed(spark, jobs.rolling(s, "1 hour", "30 minutes").select(F.unix_seconds("start").alias("start"), "metric", "n", F.round("mean", 6).alias("mean"), "max"))


@query("""
, m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND turn IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM m)
SELECT conv_id, max(turn) AS turn, count(*) AS n, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS history FROM k WHERE k <= 4 GROUP BY conv_id
""")
def st4_last_n_history(spark, sf):
    """The last four messages of every contact, kept in state and merged into a table of the newest histories."""
    folder = io.shared_folder(spark)
    history = jobs.last_n_history(io.table_stream(spark, sf, "conversations"), 4)
    jobs.replay(jobs.upsert_latest(history, f"{folder}/out", "conv_id", "turn", f"{folder}/mark").outputMode("update"))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return jobs.newest_rows(spark, f"{folder}/out").select("conv_id", "turn", F.size("messages").cast("long").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("history"))


@query("SELECT user_id AS example_id, max(event_id) AS attempt, arg_max(event_type, event_id) AS label, arg_max(value, event_id) > 20 AS parse_ok FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def st3_prediction_log(spark, sf):
    """An append log of predictions, replayed as a stream into a table of each example's last attempt."""
    folder = io.shared_folder(spark)
    log = event_stream(spark, sf).where("user_id is not null").select(F.col("user_id").alias("example_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("label"), (F.col("value") > 20).alias("parse_ok"))
    jobs.replay(jobs.upsert_latest(log, f"{folder}/out", "example_id", "attempt", f"{folder}/mark"))
    return jobs.newest_rows(spark, f"{folder}/out").select("example_id", "attempt", "label", "parse_ok")


@query("SELECT event_type AS stage, user_id % 3 AS runtime, max(event_id) AS run_id, arg_max(CAST(floor(value) AS BIGINT), event_id) AS ok, 100 AS expected FROM events GROUP BY ALL")
def st6_campaign_monitor(spark, sf):
    """Runs of a campaign as a stream: the newest of each stage and runtime with its progress."""
    log = event_stream(spark, sf).select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("runtime"), F.col("event_id").alias("run_id"), F.floor("value").alias("ok"), F.lit(100).alias("expected"), F.col("event_id").alias("started"))
    return whole(spark, jobs.campaign_monitor(log))


@query("SELECT epoch_us(ts) // 3600000000 * 3600 AS start, user_id % 10 AS agent_id, CASE event_type WHEN 'purchase' THEN 429 WHEN 'signup' THEN 503 ELSE 200 END AS status, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def st5_gateway_counters(spark, sf):
    status = F.when(F.col("event_type") == "purchase", 429).when(F.col("event_type") == "signup", 503).otherwise(200)
    responses = event_stream(spark, sf).select("ts", (F.col("user_id") % 10).alias("agent_id"), status.alias("status"))
    return whole(spark, jobs.gateway_counters(responses, "1 hour").withColumn("start", F.unix_seconds("start")))


@query("""
, r AS (SELECT user_id % 10 AS agent_id, epoch_us(ts) AS a, CASE WHEN event_type <> 'purchase' THEN epoch_us(ts) + 1000 * CAST(floor(value * 1000) AS BIGINT) END AS s, epoch_us(ts) + 1000 * CAST(floor(value * 60000) AS BIGINT) AS e FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL),
m AS (SELECT agent_id, unnest([a, s, e]) AS t, unnest([0, 1, CASE WHEN s IS NULL THEN 0 ELSE -1 END]) AS f, unnest([1, -1, CASE WHEN s IS NULL THEN -1 ELSE 0 END]) AS w FROM r),
n AS (SELECT agent_id, t // 3600000000 * 3600 AS start, sum(f) AS f, sum(w) AS w FROM m WHERE t IS NOT NULL GROUP BY ALL),
g AS (SELECT agent_id, start, CAST(sum(f) OVER o AS BIGINT) AS in_flight, CAST(sum(w) OVER o AS BIGINT) AS waiting FROM n WINDOW o AS (PARTITION BY agent_id ORDER BY start))
SELECT * FROM g WHERE (start + 3600) * 1000000 <= (SELECT max(t) // 1000 * 1000 - 600000000 FROM m)
""")
def st5_gateway_gauges(spark, sf):
    """Requests in flight and waiting at the end of every hour by agent; purchases are rejected and never start."""
    later = lambda ms: F.expr(f"timestamp_micros(unix_micros(ts) + 1000 * floor(value * {ms}))")
    e = event_stream(spark, sf).where("ts is not null and value is not null")
    requests = e.select((F.col("user_id") % 10).alias("agent_id"), F.col("ts").alias("arrival_ts"), F.when(F.col("event_type") != "purchase", later(1000)).alias("start_ts"), later(60000).alias("end_ts"))
    with jobs.keyed_state(spark):
        return closed(spark, jobs.gateway_gauges(requests, "1 hour"))


@query("""
, g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(CAST(gap IS NULL OR gap > 21600000000 AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k
""")
def st7_sessions(spark, sf):
    """Sessions that six hours of silence end."""
    out = jobs.sessions(event_stream(spark, sf), "6 hours")
    return whole(spark, out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"))


@query("""
, g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(CAST(gap IS NULL OR gap > 21600000000 AS INT)) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k
HAVING max(t) + 21600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)
""")
def st7_sessions_closed(spark, sf):
    """Sessions in append mode: each once, when no further row can lengthen it."""
    out = jobs.sessions(event_stream(spark, sf), "6 hours")
    return closed(spark, out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"))


@query("""
, r AS (SELECT 'run-' || run_id AS run, run_id, count(*) AS n, 'm' || (run_id % 2) AS model FROM requests GROUP BY run_id),
c AS (SELECT *, '{"context_window":"' || (4096 * (1 + run_id % 2)) || '","generation":"{\\"temperature\\":0}","hardware":' || CASE WHEN run_id = 4 THEN 'null' ELSE '"{\\"gpu\\":\\"x\\"}"' END
    || ',"isolation_key":' || CASE WHEN run_id IN (4, 6) THEN '"' || run || '"' ELSE 'null' END || ',"model":' || CASE WHEN run_id = 6 THEN 'null' ELSE '"' || model || '"' END || ',"tokenizer":"t","workload":"w"}' AS doc FROM r)
SELECT run, CASE WHEN run_id = 3 THEN 'partial' ELSE 'complete' END AS status, run_id NOT IN (3, 4, 5) AS included, run_id NOT IN (4, 5) AS integrity_ok,
    CASE run_id WHEN 4 THEN 'final manifest is missing' WHEN 5 THEN 'hash differs' ELSE '' END AS reasons, substr(sha256(doc), 1, 16) AS comparison_id, CASE run_id WHEN 4 THEN 'hardware' WHEN 6 THEN 'model' ELSE '' END AS missing,
    CAST(4096 * (1 + run_id % 2) AS VARCHAR) AS context_window, 'rt' || (run_id % 3) AS runtime, CASE WHEN run_id <> 4 THEN '[{"flag":"--cache-size","value":"' || n || '"}]' END AS cache_flags_json,
    CASE run_id WHEN 3 THEN '["status=partial"]' WHEN 4 THEN '["final manifest is missing"]' WHEN 5 THEN '["hash differs"]' END AS exclusion_reasons FROM c
""")
def f15_manifest_inventory(spark, sf):
    """The inventory of runs from their nested manifests: one of partial status, one without a final manifest (hardware and
    arguments stand there alone), one that fails an integrity rule, and one of an unknown model."""
    r = base.requests(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"))
    model = F.when(F.col("run_id") != 6, F.struct(F.concat(F.lit("m"), F.col("run_id") % 2).alias("sha256")))
    config = F.struct((4096 * (1 + F.col("run_id") % 2)).alias("context_window"), F.struct(F.lit(0).alias("temperature")).alias("generation_parameters"))
    argv = F.array(F.lit("serve"), F.lit("--cache-size"), F.col("n").cast("string"))
    declared = F.struct(F.lit("complete").alias("status"), F.concat(F.lit("rt"), F.col("run_id") % 3).alias("runtime"), model.alias("model_identity"), F.lit("t").alias("tokenizer_sha256"), config.alias("config"), F.struct(F.lit("w").alias("sha256")).alias("workload"))
    status = F.when(F.col("run_id") == 3, "Partial").otherwise("complete")
    final = F.struct(F.struct(status.alias("status")).alias("run"), F.struct(F.lit("x").alias("gpu")).alias("hardware"), F.struct(argv.alias("argv")).alias("runtime_process"))
    name = F.concat(F.lit("run-"), F.col("run_id")).alias("run")
    documents = r.select(name, "run_id", F.explode(F.map_from_arrays(F.array(F.lit("dataset-manifest"), F.lit("manifest")), F.array(F.to_json(declared), F.to_json(F.struct(*[final[k].alias(k) for k in ("run", "hardware", "runtime_process")]))))).alias("kind", "document"))
    documents = documents.where((F.col("run_id") != 4) | (F.col("kind") != "manifest")).withColumn("error", F.lit(None).cast("string"))
    found = r.where("run_id = 5").select(name, F.array(F.lit("hash differs")).alias("reasons"))
    got = runs.run_inventory(documents, found)
    return got.select("run", "status", "included", "integrity_ok", F.array_join("reasons", ";").alias("reasons"), "comparison_id", F.array_join("identity_missing", ";").alias("missing"), "context_window", "runtime", "cache_flags_json", "exclusion_reasons")


@query("""SELECT c_custkey, '{"token":"[REDACTED]","argv":["--hf-token","[REDACTED]","api-key=[REDACTED]","' || c_mktsegment || '"],"deep":[{"Password":"[REDACTED]","note":"by [REDACTED]!"}],"n":' || c_custkey || '}' AS document FROM customer""")
def x28_redact_json(spark, sf):
    """Nested documents without secrets: a customer's name is one."""
    deep = F.array(F.struct(F.lit("p").alias("Password"), F.concat(F.lit("by "), F.col("c_name"), F.lit("!")).alias("note")))
    argv = F.array(F.lit("--hf-token"), F.lit("abc"), F.lit("api-key=1"), F.col("c_mktsegment"))
    doc = F.to_json(F.struct(F.struct(F.lit(1).alias("x")).alias("token"), argv.alias("argv"), deep.alias("deep"), F.col("c_custkey").alias("n")))
    return io.table(spark, sf, "customer").select("c_custkey", tx.redact_json(doc, F.col("c_name")).alias("document"))


@query()
def m1_latency_regressor(spark, sf):
    """Held-out errors of the two ensembles; SQL can't express them."""
    log = base.requests(spark, sf).where("benchmark_phase = 'measure'")
    return fit_latency_regressor(log, "request_latency", ["runtime", "scenario"], ["prompt_tokens", "output_tokens", "ttft_ms"], "request_uid")[1]

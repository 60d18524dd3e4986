"""Queries over inventories, gates, consolidated evaluations, prompts and response checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import company as co
from ..functions import json as js
from ..functions import labels as lb
from ..functions import text as tx
from ..operators import gates, runs, scoring
from ..operators import summaries as sm
from ..sources.tables import table
from . import base
from .base import query
from .datasets import RUNS, normalised, run_table


@query(RUNS + " SELECT run_id, status, n, run_id <> 5 AND status = 'complete' AS included, comparison_id, CASE WHEN status <> 'complete' THEN 'status' WHEN run_id = 5 THEN 'integrity' END AS exclusion FROM runs")
def f15_run_inventory(spark, sf):
    why = F.when(F.col("status") != "complete", "status").when(~F.col("included"), "integrity")
    return run_table(spark, sf).select("run_id", "status", "n", "included", "comparison_id", why.alias("exclusion"))


@query("""
, b(k, reason) AS (VALUES (1, 'declared manifest is missing'), (2, 'final manifest is missing'), (3, 'manifest is no JSON'), (3, 'final manifest names no run'), (4, 'declared manifest names run other'), (5, 'final manifest names no run'),
    (6, 'declared manifest has no list of files'), (7, '../x lies outside the run'), (7, '../x is not in the checksum list'), (8, 'csv/all-requests.csv is named more than once'), (9, 'csv/all-requests.csv is missing'),
    (10, 'csv/all-requests.csv has no valid hash'), (11, 'csv/all-requests.csv has another hash'), (12, 'csv/all-requests.csv has no size'), (13, 'csv/all-requests.csv has another size'), (14, 'csv/all-requests.csv is not in the checksum list'),
    (15, 'csv/all-requests.csv has another hash in the checksum list'), (16, 'table all-requests is missing'), (16, 'no measured request succeeded'), (17, 'table all-requests is not inventoried'), (18, 'table all-requests lacks columns status'),
    (19, 'table all-requests is empty'), (20, 'table all-requests has rows of another run'), (21, 'no measured request succeeded')),
n(name) AS (VALUES ('all-requests'), ('request-events'), ('prometheus-samples'), ('telemetry-by-request'), ('request-phase-metrics')),
r AS (SELECT * FROM b UNION ALL SELECT k, 'table ' || name || ' is not inventoried' FROM (VALUES (1), (6)) v(k) CROSS JOIN n)
SELECT 'run-' || c_custkey AS run, string_agg(reason, ';' ORDER BY reason) AS reasons FROM customer JOIN r ON k = c_custkey % 24 GROUP BY c_custkey
""")
def f7_validate_run(spark, sf):
    """A run for each customer, whose number tells which rule it breaks."""
    k, name = F.col("k"), F.col("name")
    c = table(spark, sf, "customer").select(F.concat(F.lit("run-"), F.col("c_custkey")).alias("run"), (F.col("c_custkey") % 24).alias("k"))
    t = c.select("run", "k", F.explode(F.array(*map(F.lit, gates.REQUIRED))).alias("name")).withColumn("path", F.concat(F.lit("csv/"), name, F.lit(".csv")))
    first, size = name == "all-requests", F.length("run") + F.length("path")
    t = t.select("*", first.alias("first"), F.sha2(F.concat("run", "path"), 256).alias("sha256"), size.cast("long").alias("bytes"))
    said = F.struct("path", F.when(F.col("first") & (k == 10), "zz").otherwise(F.col("sha256")).alias("sha256"), F.when(~F.col("first") | ~k.isin(12, 13), F.col("bytes")).when(k == 13, F.col("bytes") + 1).alias("bytes"))
    more = F.when(k == 7, F.array(F.struct(F.lit("../x").alias("path"), F.sha2(F.lit("x"), 256).alias("sha256"), F.lit(1).cast("long").alias("bytes")))).when((k == 8) & F.col("first"), F.array(said))
    item = t.select("run", "k", F.explode(F.concat(F.array(said), F.when(F.col("first"), F.coalesce(more, F.array())).otherwise(F.array()))).alias("i"))
    inventory = item.groupBy("run", "k").agg(F.collect_list("i").alias("files"))
    declared = inventory.where(k != 1).select("run", F.lit("dataset-manifest").alias("kind"), F.to_json(F.struct(F.when(k == 4, "other").otherwise(F.col("run")).alias("experiment_id"), F.when(k != 6, F.col("files")).alias("files"))).alias("document"), F.lit(None).cast("string").alias("error"))
    final = c.where(k != 2).select("run", F.lit("manifest"), F.when(k == 3, "{bad").when(k == 5, "{}").otherwise(F.to_json(F.struct(F.col("run").alias("run_id")))), F.when(k == 3, "invalid JSON"))
    files = t.where(~F.col("first") | (k != 9)).select("run", "path", F.when(F.col("first") & (k == 11), F.sha2("run", 256)).otherwise(F.col("sha256")).alias("sha256"), "bytes")
    listed = t.where(~F.col("first") | (k != 14)).select("run", "path", F.when(F.col("first") & (k == 15), F.sha2("run", 256)).otherwise(F.col("sha256")).alias("sha256"))
    columns = F.create_map(*[F.lit(x) for n, cs in gates.REQUIRED.items() for x in (n, "|".join(cs))])
    had = F.split(F.when(F.col("first") & (k == 18), F.replace(columns[name], F.lit("|status"), F.lit(""))).otherwise(columns[name]), r"\|")
    tables = t.where(~F.col("first") | (k != 16)).select(
        "run", "name", F.when(F.col("first") & (k == 17), "other.csv").otherwise(F.col("path")).alias("path"), had.alias("columns"), F.when(F.col("first") & (k == 19), 0).otherwise(9).alias("rows"),
        F.when(F.col("first") & (k == 20), 2).otherwise(0).alias("foreign"), F.when(F.col("first"), F.when(k == 21, 0).otherwise(4)).alias("measured"),
    )
    return gates.run_integrity(declared.union(final), files, tables, listed).select("run", F.array_join("reasons", ";").alias("reasons"))


@query("""
, b(k, reason) AS (VALUES (1, 'no included run of c'), (1, 'the group holds 2 runtimes'), (1, 'pairing is not proven'), (2, '2 included runs of a'), (3, 'run ids repeat'), (4, 'runs have 2 comparison ids'), (5, '1 runs have an incomplete identity'),
    (6, 'pairing is not proven'), (7, 'pairing is not proven'), (8, 'no included run of a'), (8, 'no included run of b'), (8, 'no included run of c'))
SELECT c_custkey AS campaign, CASE k WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 8 THEN 0 ELSE 3 END AS ready, reasons = '' AS comparable, k NOT IN (1, 6, 7, 8) AS paired, reasons
FROM (SELECT c_custkey, c_custkey % 9 AS k, coalesce((SELECT string_agg(reason, ';' ORDER BY reason) FROM b WHERE b.k = c_custkey % 9), '') AS reasons FROM customer)
""")
def f16_comparability_gate(spark, sf):
    """A campaign for each customer, whose number tells what stands against it."""
    k, rt, run = F.col("k"), F.col("runtime"), F.col("run_id")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("campaign"), (F.col("c_custkey") % 9).alias("k"))
    r = c.select("*", F.explode(F.when(k == 2, F.array(*map(F.lit, "abca"))).otherwise(F.array(*map(F.lit, "abc")))).alias("runtime"), F.monotonically_increasing_id().alias("n"))
    number = F.row_number().over(Window.partitionBy("campaign").orderBy("runtime"))
    r = r.withColumn("n", F.when((k == 3) & (rt == "b"), 1).otherwise(number)).withColumn("run_id", F.concat_ws("-", "campaign", "n"))
    comparison = F.concat_ws("-", F.lit("g"), "campaign", F.when((k == 4) & (rt == "c"), "other"))
    r = r.select("campaign", "k", "run_id", "runtime", ((k != 8) & ~((k == 1) & (rt == "c"))).alias("included"), comparison.alias("comparison_id"), F.when((k == 5) & (rt == "b"), F.array(F.lit("model"))).otherwise(lb.array_of([])).alias("identity_missing"))
    groups = runs.comparison_groups(r.where("included").withColumn("model", F.lit("m")))
    pairs = r.groupBy("run_id").agg(F.max(F.when((k == 6) & (rt == "c"), 2).when((k != 7) | (rt != "c"), 1)).alias("signature"))
    got = gates.comparability(r, groups, pairs, ["a", "b", "c"])
    return got.select("campaign", "ready", "comparable", F.col("pairing_verified").alias("paired"), F.array_join("reasons", ";").alias("reasons"))


@query("""
, s AS (SELECT c_custkey AS source, c_custkey % 7 AS k, c_name FROM customer),
b(k, reason) AS (VALUES (1, 'manifest is missing'), (2, 'hash differs from the manifest'), (3, 'source runtime is not the canonical one'), (4, '1 requests have two answers'), (5, 'no answer'), (6, 'hash differs from the manifest'), (6, 'source runtime is not the canonical one'))
SELECT source, 'q' || q AS item, c_name || q AS value FROM s CROSS JOIN (VALUES (1), (2)) v(q) WHERE k = 0 UNION ALL SELECT source, 'reason', reason FROM s JOIN b USING (k)
""")
def f17_replay_map(spark, sf):
    """Responses of a source for each customer, whose number tells what is wrong with them: two requests, with a second turn and
    a blank answer beside the first one's."""
    k, q, turn = F.col("k"), F.col("q"), F.col("turn_index")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") % 7).alias("k"), "c_name")
    turns = F.array(*[F.struct(F.lit(a).alias("q"), F.lit(b).alias("turn_index"), F.lit(blank).alias("blank")) for a, b, blank in ((1, 1, False), (1, 1, True), (1, 2, False), (2, 1, False))])
    r = c.select("source", "k", "c_name", F.explode(turns).alias("t")).select("source", "k", "c_name", "t.*")
    answer = F.when((k == 5) | F.col("blank"), F.when(k == 4, F.concat("c_name", q)).otherwise(" ")).otherwise(F.concat("c_name", q))
    responses = r.select("source", F.concat(F.lit("q"), q).alias("request_id"), "turn_index", answer.alias("answer"))
    told = c.where(k != 1).select("source", F.when(k.isin(3, 6), "other").otherwise("llama").alias("source_runtime"), F.when(k != 6, F.lit("h")).alias("responses_sha256"), F.when(k == 2, "x").otherwise("h").alias("sha256"))
    answers, reasons = gates.replay_map(responses, told, "llama")
    return answers.select("source", F.col("request_id").alias("item"), F.col("answer").alias("value")).union(reasons.select("source", F.lit("reason"), F.explode("reasons")))


@query("""
, p AS (SELECT *, model AS run_id, array_to_string(expected, ',') AS expected_tags, sha256(day) AS input_sha256 FROM tagged WHERE model <> 'm3'),
s AS (SELECT run_id, count(*) AS n, sha256(string_agg(example_id || '|' || expected_tags || '|' || input_sha256, chr(10) ORDER BY example_id)) AS sample_sha FROM p GROUP BY run_id),
m(run_id, created_at, model, digest, bytes, size, quantization, wall) AS (VALUES ('m0', '2024-01-03', 'fam:14b-q8_0', 'abcdef0123456789', 4700000000, 14.0, 'q8_0', 1.5), ('m1', '2024-01-01', 'fam', NULL, NULL, 7.5, 'Q4', 2.5)),
r AS (SELECT m.*, s.n, s.sample_sha FROM m JOIN s USING (run_id))
SELECT r.run_id, r.created_at, CASE WHEN digest IS NULL THEN model ELSE model || ' [' || substr(digest, 1, 8) || ']' END AS model_label, 'data.v1' AS dataset_name, bytes / 1e9 AS model_size_gb, CAST(size AS DOUBLE) AS parameter_size_b, quantization,
    sample_sha AS sample_sha256, CAST(wall AS DOUBLE) AS wall_s, q.example_id, q.expected_tags, n AS predictions
FROM r JOIN (SELECT run_id, example_id, expected_tags FROM p) q USING (run_id)
""")
def u5_consolidate_evals(spark, sf):
    """Every prediction with its run's attributes. Of five runs one has no metadata, one no performance and one no predictions."""
    t = base.tagged(spark, sf).where("model <> 'm3'").select(F.col("model").alias("run_id"), "example_id", F.array_join("expected", ",").alias("expected_tags"), F.sha2("day", 256).alias("input_sha256"))
    known = [("m0", "2024-01-03", "fam:14b-q8_0", "abcdef0123456789", 4_700_000_000, None, None), ("m1", "2024-01-01", "fam", None, None, "7.5 B", "Q4"), ("m3", "2024-01-02", "fam", None, None, None, None), ("m4", "2024-01-02", "fam", None, None, None, None)]
    metadata = spark.createDataFrame(known, "run_id string, created_at string, model string, digest string, size_bytes long, parameter_size string, quantization_level string")
    metadata = metadata.select("*", F.lit("/data/in/data.v1.csv").alias("dataset"), F.lit(5).alias("dataset_rows"), F.lit(7).alias("seed"), F.lit("p").alias("prompt_sha256"), F.lit('{"temperature":0}').alias("options"))
    performance = spark.createDataFrame([("m0", 1.5), ("m1", 2.5), ("m2", 3.5), ("m3", 1.0)], "run_id string, wall_s double")
    found, predictions = runs.consolidate_evals(metadata, performance, t)
    out = predictions.join(runs.require_runs(found).select("run_id", "wall_s", "predictions"), "run_id")
    return out.select("run_id", "created_at", "model_label", "dataset_name", "model_size_gb", "parameter_size_b", "quantization", "sample_sha256", "wall_s", "example_id", "expected_tags", "predictions")


@query("SELECT c_custkey, c_mktsegment AS segment, true AS has_all, false AS has_contacts FROM customer")
def x34_evidence_prompt(spark, sf):
    doc = co.evidence_prompt(F.col("company"))
    return normalised(spark, sf).select("c_custkey", F.get_json_object(doc, "$.segment").alias("segment"), (F.size(F.json_object_keys(doc)) == len(co.PROMPT_FIELDS)).alias("has_all"), doc.contains('"cnpj"').alias("has_contacts"))


@query("SELECT doc_id, sha256('system:Classify.' || chr(10) || 'user:' || text || chr(10) || 'assistant:[\"' || lang || '\"]') AS prompt FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def x35_render_messages(spark, sf):
    said = tx.render_messages(F.lit("Classify."), F.col("text"), F.to_json(F.array("lang")))
    line = F.array_join(F.transform(said, lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")
    return table(spark, sf, "documents").where("text is not null and lang is not null").select("doc_id", F.sha2(line, 256).alias("prompt"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'missing text' WHEN 1 THEN 'invalid JSON' WHEN 2 THEN '$.tags: not array' END AS reason FROM events")
def x24_schema_check(spark, sf):
    """Answers that came as streams of two deltas each, but for those without any."""
    text = F.when(F.col("event_id") % 4 == 1, "{oops").when(F.col("event_id") % 4 == 2, '{"tags": "x"}').when(F.col("event_id") % 4 == 3, F.to_json(F.struct(F.array("event_type").alias("tags"))))
    delta = lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))))
    body = F.when(text.isNotNull(), F.concat_ws("\n\n", delta(F.substring(text, 1, 4)), delta(F.substring(text, 5, 1000)), F.lit("data: [DONE]\n")))
    reason = js.schema_failure(gates.stream_text(body), {"type": "object", "required": ["tags"], "properties": {"tags": {"type": "array", "items": {"type": "string"}}}})
    return table(spark, sf, "events").select("event_id", reason.alias("reason"))


@query("""
, m AS (SELECT DISTINCT event_type AS metric FROM events), r AS (SELECT DISTINCT user_id FROM events)
SELECT r.user_id, m.metric, count(e.event_id) AS n FROM r CROSS JOIN m LEFT JOIN events e ON e.user_id = r.user_id AND e.event_type = m.metric GROUP BY ALL
""")
def j13_expected_grid(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "metric")
    grid = sm.expected_grid(e, "user_id", sm.catalogue(e, "metric"), "metric")
    return grid.join(e.groupBy("user_id", "metric").agg(F.count("*").alias("n")), ["user_id", "metric"], "left").na.fill(0, ["n"])


@query("SELECT model, count(*) FILTER (exact_match) AS exact, round(avg(f1) FILTER (parse_ok), 9) AS parsed_f1 FROM scored GROUP BY model")
def st3_latest_predictions(spark, sf):
    """The batch form of the resumable log (st3_prediction_log is the stream): the last record of each id counts."""
    t = base.tagged(spark, sf).withColumn("s", lb.compare_tags(F.col("expected"), F.col("generated"))).select("example_id", "model", "pos", "s.f1", "s.exact_match", (F.col("user_id") % 9 != 0).alias("parse_ok"))
    log = t.withColumn("f1", F.lit(0.0)).withColumn("pos", F.col("pos") - 1).unionByName(t)
    last = scoring.dedup(log, ["example_id"], [F.col("pos")], last=True)
    return last.groupBy("model").agg(F.count_if("exact_match").alias("exact"), F.round(F.avg(F.when(F.col("parse_ok"), F.col("f1"))), 9).alias("parsed_f1"))


@query(RUNS + " SELECT status, max(n) AS most FROM runs GROUP BY status")
def st6_campaign_state(spark, sf):
    return runs.latest_run(run_table(spark, sf).select("status", "n", "run_id"), ["status"], "n").select("status", F.col("n").alias("most"))

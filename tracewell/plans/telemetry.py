"""Queries over samples in time and request logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import intervals as iv
from ..operators import runs
from ..operators import summaries as sm
from ..operators.percentiles import with_percentiles
from ..operators.scoring import dedup
from . import base
from .base import query


def correlated(spark, sf):
    return iv.interval_join(base.samples(spark, sf), base.intervals(spark, sf))


@query("SELECT sample_id, experiment_id, metric, request_uid, observed_phase FROM matched")
def j1_interval_join(spark, sf):
    return correlated(spark, sf).select("sample_id", "experiment_id", "metric", "request_uid", "observed_phase")


@query("SELECT observed_phase, metric, count(*) AS n, count(DISTINCT request_uid) AS requests FROM matched GROUP BY ALL")
def j2_phase_of(spark, sf):
    return correlated(spark, sf).groupBy("observed_phase", "metric").agg(F.count("*").alias("n"), F.count_distinct("request_uid").alias("requests"))


@query("""
SELECT experiment_id, metric, observed_phase, kind, count(value) AS sample_count, round(CASE WHEN kind <> 'counter' THEN avg(value) END, 6) AS mean,
    round(CASE WHEN kind <> 'counter' THEN quantile_cont(value, 0.5) END, 6) AS p50, round(CASE WHEN kind <> 'counter' THEN quantile_cont(value, 0.95) END, 6) AS p95,
    CASE WHEN kind <> 'counter' THEN min(value) END AS min, CASE WHEN kind <> 'counter' THEN max(value) END AS max,
    first(value ORDER BY timestamp_s, sample_id) AS first, last(value ORDER BY timestamp_s, sample_id) AS last,
    round(CASE WHEN count(value) > 1 THEN last(value ORDER BY timestamp_s, sample_id) - first(value ORDER BY timestamp_s, sample_id) END, 6) AS delta,
    round(CASE WHEN kind = 'counter' AND count(value) > 1 AND max(timestamp_s) > min(timestamp_s) THEN (last(value ORDER BY timestamp_s, sample_id) - first(value ORDER BY timestamp_s, sample_id)) / (max(timestamp_s) - min(timestamp_s)) END, 6) AS rate_mean
FROM matched WHERE request_uid IS NOT NULL GROUP BY experiment_id, metric, observed_phase, kind
""")
def a1_phase_metrics(spark, sf):
    out = iv.phase_metrics(correlated(spark, sf), ["experiment_id", "metric", "observed_phase"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "delta", "rate_mean")})


@query("""
SELECT experiment_id, request_uid, event, round(ts, 3) AS timestamp_s, round(ts - start_s, 3) AS request_elapsed_s
FROM (SELECT *, unnest(['request_start', 'first_content', 'last_content', 'request_end']) AS event, unnest([start_s, first_s, last_s, end_s]) AS ts FROM intervals) WHERE ts IS NOT NULL
""")
def f14_request_events(spark, sf):
    out = iv.request_events(base.intervals(spark, sf), {"request_start": "start_s", "first_content": "first_s", "last_content": "last_s", "request_end": "end_s"})
    return out.withColumns({c: F.round(c, 3) for c in ("timestamp_s", "request_elapsed_s")})


@query("""
SELECT experiment_id, metric, timestamp_s, round(CASE WHEN dt > 0 AND dv >= 0 THEN dv / dt END, 9) AS rate FROM (
    SELECT *, v - lag(v) OVER w AS dv, timestamp_s - lag(timestamp_s) OVER w AS dt FROM (SELECT experiment_id, metric, timestamp_s, avg(value) AS v FROM samples GROUP BY ALL)
    WINDOW w AS (PARTITION BY experiment_id, metric ORDER BY timestamp_s))
""")
def w4_counter_rate(spark, sf):
    return iv.counter_rate(base.samples(spark, sf), ["experiment_id", "metric"]).select("experiment_id", "metric", "timestamp_s", F.round("rate", 9).alias("rate"))


@query("""
SELECT experiment_id, metric, n AS samples, round(CASE WHEN n > 1 AND b >= a THEN b - a END, 6) AS delta FROM (
    SELECT experiment_id, metric, count(value) AS n, first(value ORDER BY timestamp_s, sample_id) AS a, last(value ORDER BY timestamp_s, sample_id) AS b FROM samples GROUP BY ALL)
""")
def w5_first_last_delta(spark, sf):
    return iv.first_last_delta(base.samples(spark, sf), ["experiment_id", "metric"]).withColumn("delta", F.round("delta", 6))


@query("""
SELECT experiment_id, count(*) AS points, round(sum(area), 2) AS integral FROM (
    SELECT experiment_id, (v + lag(v) OVER w) / 2 * (timestamp_s - lag(timestamp_s) OVER w) AS area FROM (SELECT experiment_id, timestamp_s, avg(value) AS v FROM samples GROUP BY ALL)
    WINDOW w AS (PARTITION BY experiment_id ORDER BY timestamp_s)) GROUP BY experiment_id
""")
def w6_trapezoid(spark, sf):
    return iv.trapezoid(base.samples(spark, sf), ["experiment_id"]).withColumn("integral", F.round("integral", 2))


@query("""
SELECT request_uid, points, round(e, 2) AS energy_j, round(CASE WHEN request_uid % 50 > 0 THEN e / (request_uid % 50) END, 4) AS j_per_token FROM (
    SELECT request_uid, count(*) AS points, sum(area) AS e FROM (
        SELECT request_uid, (v + lag(v) OVER w) / 2 * (timestamp_s - lag(timestamp_s) OVER w) AS area FROM (SELECT request_uid, timestamp_s, avg(value) AS v FROM matched WHERE request_uid IS NOT NULL GROUP BY ALL)
        WINDOW w AS (PARTITION BY request_uid ORDER BY timestamp_s)) GROUP BY request_uid) WHERE points > 1
""")
def a28_energy_summary(spark, sf):
    rows = correlated(spark, sf).where("request_uid is not null")
    out = iv.energy_summary(rows, ["request_uid"], F.col("request_uid") % 50)
    return out.select("request_uid", "points", F.round("energy_j", 2).alias("energy_j"), F.round("j_per_token", 4).alias("j_per_token"))


@query("""
, most AS (SELECT experiment_id, max(n) AS max_in_flight FROM (
    SELECT experiment_id, sum(d) OVER (PARTITION BY experiment_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT experiment_id, start_s AS t, 1 AS d FROM intervals UNION ALL SELECT experiment_id, end_s, -1 FROM intervals)) GROUP BY experiment_id),
m AS (SELECT experiment_id, start_s - 60 * (request_uid % 5) AS t, 0 AS f, 1 AS w FROM intervals UNION ALL SELECT experiment_id, start_s, 1, -1 FROM intervals UNION ALL SELECT experiment_id, end_s, -1, 0 FROM intervals),
e AS (SELECT experiment_id, t, sum(f) AS f, sum(w) AS w FROM m GROUP BY ALL),
l AS (SELECT experiment_id, t, lead(t) OVER o - t AS span, sum(f) OVER o AS in_flight, sum(w) OVER o AS waiting FROM e WINDOW o AS (PARTITION BY experiment_id ORDER BY t))
SELECT experiment_id, any_value(max_in_flight) AS max_in_flight, max(waiting) AS max_waiting, round(sum(waiting * span) / nullif(sum(span), 0), 4) AS mean_waiting, round(sum(in_flight * span) / nullif(sum(span), 0), 4) AS mean_in_flight
FROM l JOIN most USING (experiment_id) GROUP BY experiment_id
""")
def w12_concurrency_profile(spark, sf):
    """Requests arrive up to four minutes before they start."""
    r = base.intervals(spark, sf)
    queue = iv.queue_profile(r.withColumn("arrival_s", F.col("start_s") - 60 * (F.col("request_uid") % 5)), "experiment_id")
    both = iv.concurrency(r, "experiment_id").join(queue, "experiment_id")
    return both.select("experiment_id", "max_in_flight", "max_waiting", F.round("mean_waiting", 4).alias("mean_waiting"), F.round("mean_in_flight", 4).alias("mean_in_flight"))


@query("""
, ready AS (SELECT experiment_id, metric, kind, count(value) AS n, avg(value) AS mean, last(value ORDER BY timestamp_s, sample_id) - first(value ORDER BY timestamp_s, sample_id) AS d FROM matched WHERE request_uid IS NOT NULL GROUP BY ALL),
valid AS (SELECT * FROM ready WHERE experiment_id % 2 = 0 AND CASE WHEN kind = 'counter' THEN n >= 2 ELSE mean IS NOT NULL END)
SELECT experiment_id, metric, kind, n AS sample_count, round(CASE WHEN kind <> 'counter' THEN mean END, 6) AS mean, round(CASE WHEN n > 1 THEN d END, 6) AS delta,
    CASE WHEN (experiment_id, metric) IN (SELECT (experiment_id, metric) FROM valid) THEN 'precomputed' ELSE 'telemetry' END AS origin FROM ready
""")
def j16_prefer_precomputed(spark, sf):
    raw, keys = correlated(spark, sf), ["experiment_id", "metric"]
    out = iv.prefer_precomputed(iv.phase_metrics(raw, keys).where("experiment_id % 2 = 0"), raw, keys)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "delta")})


@query("""
SELECT metric, CASE WHEN metric LIKE '%_bytes' THEN 'bytes' WHEN metric LIKE '%_total' THEN 'count' WHEN metric LIKE '%_ratio' THEN 'fraction' ELSE 'unknown' END AS unit,
    CASE WHEN metric LIKE '%_total' THEN 'counter' ELSE 'gauge' END AS kind, count(*) AS n
FROM (SELECT event_type || ['_bytes', '_bytes_total', '_total', '_ratio', ''][user_id % 5 + 1] AS metric FROM events WHERE user_id % 5 <> 1 UNION ALL SELECT 'x_total' FROM events WHERE user_id % 5 = 1) GROUP BY ALL
""")
def x20_metric_metadata(spark, sf):
    ends = F.element_at(F.array(*map(F.lit, ("_bytes", "_bytes_total", "_total", "_ratio", ""))), (F.col("user_id") % 5 + 1).cast("int"))
    m = base.events(spark, sf).select(F.when(F.col("user_id") % 5 == 1, "x_total").otherwise(F.concat("event_type", ends)).alias("metric"))
    return m.select("metric", numbers.metric_metadata(F.col("metric")).alias("m")).groupBy("metric", "m.unit", "m.kind").agg(F.count("*").alias("n"))


@query("""
SELECT sample_id, kind, coalesce(runtime, 'unassigned') AS scenario FROM samples LEFT JOIN (SELECT request_uid AS u, runtime FROM requests) ON sample_id = u
""")
def j11_with_scenario(spark, sf):
    samples = base.samples(spark, sf).withColumn("request_uid", F.col("sample_id"))
    return sm.with_scenario(samples, base.requests(spark, sf), "request_uid", "runtime").select("sample_id", "kind", "scenario")


OK = "lower(status) IN ('successful', 'success', 'ok')"


@query(f"SELECT run_id, count(*) AS n FROM requests WHERE benchmark_phase = 'measure' AND {OK} GROUP BY run_id")
def f1_measured(spark, sf):
    return runs.measured(base.requests(spark, sf)).groupBy("run_id").agg(F.count("*").alias("n"))


@query(f"""
SELECT scenario, benchmark_phase, count(*) AS requests, count(*) FILTER ({OK}) AS ok, count(*) FILTER (lower(status) = 'error') AS failed, 0 AS unknown,
    'ttft_ms' AS ttft_ms_source, count(ttft_ms) FILTER ({OK}) AS ttft_ms_n, round(avg(ttft_ms) FILTER ({OK}), 4) AS ttft_ms_mean, round(quantile_cont(ttft_ms, 0.5) FILTER ({OK}), 4) AS ttft_ms_p50, round(quantile_cont(ttft_ms, 0.95) FILTER ({OK}), 4) AS ttft_ms_p95,
    'request_latency' AS e2e_seconds_source, count(request_latency) FILTER ({OK}) AS e2e_seconds_n, round(max(request_latency) FILTER ({OK}), 4) AS e2e_seconds_max
FROM requests GROUP BY scenario, benchmark_phase
""")
def a2_experiment_summary(spark, sf):
    out = runs.experiment_summary(base.requests(spark, sf), ["scenario", "benchmark_phase"])
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("scenario", "benchmark_phase", "requests", "ok", "failed", "unknown", "ttft_ms_source", "ttft_ms_n", r("ttft_ms_mean"), r("ttft_ms_p50"), r("ttft_ms_p95"), "e2e_seconds_source", "e2e_seconds_n", r("e2e_seconds_max"))


@query(f"""
SELECT scenario, count(*) AS total, count(*) FILTER ({OK}) AS ok, round(100 * count(*) FILTER ({OK}) / count(*), 6) AS success_pct, count(t) FILTER ({OK}) AS ttft_n, round(quantile_cont(t, 0.5) FILTER ({OK}), 8) AS ttft_p50, round(quantile_cont(t, 0.95) FILTER ({OK}), 8) AS ttft_p95
FROM (SELECT *, coalesce(ttft_ms, request_latency * 1000) AS t FROM requests) GROUP BY scenario
""")
def a3_performance_summary(spark, sf):
    ok = runs.status_is(runs.OK_WIDE)
    t = F.when(ok, F.coalesce("ttft_ms", F.col("request_latency") * 1000))
    r = base.requests(spark, sf)
    facts = r.groupBy("scenario").agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.round(100 * F.count_if(ok) / F.count("*"), 6).alias("success_pct"))
    out = with_percentiles(facts, r, ["scenario"], {"ttft": t})
    return out.withColumns({c: F.round(c, 8) for c in ("ttft_p50", "ttft_p95")})


@query(f"""
SELECT benchmark_phase, scenario, repetition, count(*) FILTER ({OK}) AS n, count(*) FILTER ({OK}) < 100 AS exploratory, round(quantile_cont(request_latency, 0.5) FILTER ({OK}), 6) AS latency_p50, round(quantile_cont(request_latency, 0.95) FILTER ({OK}), 6) AS latency_p95, round(quantile_cont(request_latency, 0.99) FILTER ({OK}), 6) AS latency_p99
FROM requests GROUP BY ALL
""")
def a4_summarize_requests(spark, sf):
    ok = runs.status_is(runs.OK_STRICT)
    r, keys = base.requests(spark, sf), ["benchmark_phase", "scenario", "repetition"]
    out = with_percentiles(r.select(*keys).distinct(), r, keys, {"latency": F.when(ok, F.col("request_latency"))}, (0.5, 0.95, 0.99))
    return out.select("benchmark_phase", "scenario", "repetition", F.col("latency_n").alias("n"), (F.col("latency_n") < 100).alias("exploratory"), *[F.round(f"latency_{p}", 6).alias(f"latency_{p}") for p in ("p50", "p95", "p99")])


BAND = "CASE WHEN p < 512 THEN '[0, 512)' WHEN p < 1024 THEN '[512, 1024)' WHEN p < 2048 THEN '[1024, 2048)' WHEN p < 4096 THEN '[2048, 4096)' WHEN p < 8192 THEN '[4096, 8192)' WHEN p < 16384 THEN '[8192, 16384)' ELSE '[16384, +∞)' END"


@query(f"""
SELECT scenario, {BAND} AS band, count(*) AS n, round(quantile_cont(request_latency, 0.5), 6) AS latency_p50, round(quantile_cont(p, 0.5) * 196608 / 1048576, 6) AS kv_mib FROM (SELECT *, prompt_tokens AS p FROM requests) GROUP BY ALL
""")
def a5_context_summary(spark, sf):
    band = numbers.context_band(F.col("prompt_tokens"))
    r, keys = base.requests(spark, sf).withColumn("band", band), ["scenario", "band"]
    out = with_percentiles(r.groupBy(*keys).agg(F.count("*").alias("n")), r, keys, {"latency": F.col("request_latency"), "tokens": F.col("prompt_tokens")}, (0.5,))
    return out.select(*keys, "n", F.round("latency_p50", 6).alias("latency_p50"), F.round(F.col("tokens_p50") * 196608 / 1048576, 6).alias("kv_mib"))


@query("""
SELECT event_type, count(*) AS n, round(avg(v), 6) AS used_mean, min(v) AS used_min, max(v) AS used_max FROM (
    SELECT event_type, CASE WHEN user_id % 7 IN (0, 1, 2) THEN NULL ELSE value END AS v FROM events) GROUP BY event_type
""")
def a6_device_summary(spark, sf):
    text = F.when(F.col("user_id") % 7 == 0, "N/A").when(F.col("user_id") % 7 == 1, "nan").when(F.col("user_id") % 7 == 2, " ").otherwise(F.col("value").cast("string"))
    return runs.device_summary(base.events(spark, sf).select("event_type", text.alias("used")), ["event_type"], ["used"]).withColumn("used_mean", F.round("used_mean", 6))


@query("""
SELECT observed_phase, metric, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS peak, count(DISTINCT request_uid) AS n_requests, any_value(expected) AS expected, round(count(DISTINCT request_uid) / any_value(expected), 6) AS coverage
FROM matched JOIN (SELECT observed_phase AS o, count(DISTINCT request_uid) AS expected FROM matched WHERE request_uid IS NOT NULL GROUP BY 1) ON o = observed_phase WHERE request_uid IS NOT NULL GROUP BY ALL
""")
def a27_resource_summary(spark, sf):
    rows = correlated(spark, sf).where("request_uid is not null")
    expected = rows.groupBy("observed_phase").agg(F.count_distinct("request_uid").alias("expected"))
    return runs.resource_summary(rows, expected, ["observed_phase", "metric"]).withColumns({c: F.round(c, 6) for c in ("median", "p95", "coverage")})


@query("""
SELECT metric, observed_phase, count(DISTINCT request_uid) / (SELECT count(DISTINCT request_uid) FROM matched) AS coverage FROM matched WHERE request_uid IS NOT NULL GROUP BY ALL HAVING count(DISTINCT request_uid) / (SELECT count(DISTINCT request_uid) FROM matched) >= 0.1
""")
def f12_coverage_gate(spark, sf):
    return sm.coverage_gate(correlated(spark, sf).where("request_uid is not null"), ["metric", "observed_phase"], "request_uid", 0.1)


@query("""
SELECT scenario, round(median, 6) AS median, arg_min(request_uid, (abs(ttft_ms - median), request_uid)) AS request_uid, arg_min(ttft_ms, (abs(ttft_ms - median), request_uid)) AS ttft_ms
FROM (SELECT *, quantile_cont(ttft_ms, 0.5) OVER (PARTITION BY scenario) AS median FROM requests) WHERE ttft_ms IS NOT NULL GROUP BY scenario, median
""")
def w7_representative_request(spark, sf):
    return runs.representative(base.requests(spark, sf), "scenario", "ttft_ms", "request_uid").withColumn("median", F.round("median", 6))


@query(f"""
SELECT run_id, count(*) FILTER ({OK}) AS ok, count(*) FILTER (NOT {OK}) AS errors, sum(output_tokens) FILTER ({OK}) AS tokens, round(count(*) FILTER ({OK}) / (max(end_s) - min(start_s)), 9) AS requests_s, round(quantile_cont(ttft_ms, 0.95) FILTER ({OK}), 6) AS ttft_p95 FROM requests GROUP BY run_id
""")
def a22_cell_summary(spark, sf):
    out = runs.cell_summary(base.requests(spark, sf).withColumn("latency_s", F.col("request_latency")), ["run_id"])
    return out.select("run_id", "ok", "errors", "tokens", F.round("requests_s", 9).alias("requests_s"), F.round("ttft_p95", 6).alias("ttft_p95"))


@query(f"""
SELECT request_uid % 5000 AS cell, count(*) AS ok FROM requests GROUP BY 1 HAVING count(*) FILTER ({OK}) = count(*)
""")
def f10_cell_complete(spark, sf):
    cells = runs.cell_summary(base.requests(spark, sf).withColumn("latency_s", F.col("request_latency")).withColumn("cell", F.col("request_uid") % 5000), ["cell"])
    return cells.where(runs.cell_complete(F.col("ok") + F.col("errors"))).select("cell", "ok")


@query("""
SELECT run_id, scenario, round(avg(n), 6) AS mean_requests FROM (SELECT run_id, scenario, repetition, count(*) AS n FROM requests GROUP BY ALL) GROUP BY run_id, scenario
""")
def a23_mean_curve(spark, sf):
    cells = base.requests(spark, sf).groupBy("run_id", "scenario", "repetition").agg(F.count("*").alias("n"))
    return sm.mean_curve(cells, ["run_id", "scenario"], "n").select("run_id", "scenario", F.round("mean", 6).alias("mean_requests"))


@query("""
, curve AS (SELECT scenario, repetition, avg(request_latency) AS y FROM requests GROUP BY ALL)
SELECT a.scenario, round(a.y, 6) AS y_a, round(b.y, 6) AS y_b, round(b.y / a.y, 6) AS ratio, round(b.y - a.y, 6) AS delta FROM curve a JOIN curve b USING (scenario) WHERE a.repetition = 0 AND b.repetition = 1
""")
def j12_compare_curves(spark, sf):
    curve = base.requests(spark, sf).groupBy("scenario", "repetition").agg(F.avg("request_latency").alias("y"))
    found = sm.compare_curves(curve.where("repetition = 0"), curve.where("repetition = 1"), ["scenario"], "y")
    return found.withColumns({c: F.round(c, 6) for c in ("y_a", "y_b", "ratio", "delta")})


@query("""
SELECT request_uid, round(CASE WHEN output_tokens > 1 AND request_latency > 0 THEN 1000 / (request_latency * 3) END, 6) AS decode, round(CASE WHEN output_tokens > 0 AND request_latency > 0 THEN output_tokens / request_latency END, 6) AS effective, prompt_tokens + output_tokens AS context_end FROM requests
""")
def x16_derived_rates(spark, sf):
    r = numbers.request_rates(F.col("prompt_tokens"), F.col("output_tokens"), F.col("request_latency") * 3, F.col("request_latency"))
    return base.requests(spark, sf).select("request_uid", F.round(r["decode_tokens_s"], 6).alias("decode"), F.round(r["effective_tokens_s"], 6).alias("effective"), r["context_end_tokens"].alias("context_end"))


@query(f"SELECT {BAND} AS band, count(*) AS n FROM (SELECT prompt_tokens AS p FROM requests) GROUP BY 1")
def x17_context_band(spark, sf):
    return base.requests(spark, sf).groupBy(numbers.context_band(F.col("prompt_tokens")).alias("band")).agg(F.count("*").alias("n"))


@query("""
SELECT request_uid, round((first_s - start_s) * 1000, 3) AS ttft_ms, round(CASE WHEN request_uid % 40 > 1 THEN last_s - first_s END, 3) AS generation_s, round(CASE WHEN request_uid % 40 > 1 AND last_s > first_s THEN (request_uid % 40) / (last_s - first_s) END, 6) AS decode FROM intervals
""")
def x18_stream_metrics(spark, sf):
    m = numbers.stream_metrics(F.col("start_s"), F.col("first_s"), F.col("last_s"), F.col("end_s"), F.col("request_uid") % 40)
    return base.intervals(spark, sf).select("request_uid", F.round(m["ttft_ms"], 3).alias("ttft_ms"), F.round(m["generation_s"], 3).alias("generation_s"), F.round(m["decode_tokens_s"], 6).alias("decode"))


@query("""
SELECT experiment_id, request_uid, round(100 * avg(value / 1000), 10) AS mean_pct, round(100 * max(value / 1000), 10) AS max_pct, count(*) AS n FROM matched WHERE metric = 'view' OR metric = 'click' GROUP BY ALL
""")
def a35_kv_occupancy(spark, sf):
    rows = correlated(spark, sf).where("metric = 'view' or metric = 'click'")
    return sm.kv_occupancy(rows, ["experiment_id", "request_uid"], F.col("value") / 1000).withColumns({c: F.round(c, 10) for c in ("mean_pct", "max_pct")})


@query("""
, c AS (SELECT scenario, run_id, avg(ttft_ms) AS ttft, count(ttft_ms) / count(*) AS coverage FROM requests GROUP BY scenario, run_id)
SELECT scenario, run_id, round(ttft, 6) AS ttft FROM c WHERE coverage >= 0.9 AND ttft IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY ttft, run_id) = 1
""")
def t9_best_by_metric(spark, sf):
    """The run with the quickest first token of each scenario, among those that have it for nine tenths of their requests."""
    cells = base.requests(spark, sf).groupBy("scenario", "run_id").agg(F.avg("ttft_ms").alias("ttft"), (F.count("ttft_ms") / F.count("*")).alias("coverage"))
    return sm.best_by_metric(cells, ["scenario"], "run_id", "ttft", "coverage", 0.9, highest=False).withColumn("ttft", F.round("ttft", 6))


RUNTIMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT scenario, " + ", ".join(f"""round(avg(ttft_ms) FILTER (runtime = '{r}'), 6) AS r{k}, count(ttft_ms) FILTER (runtime = '{r}') || '/' || count(*) FILTER (runtime = '{r}') AS c{k}""" for k, r in enumerate(RUNTIMES)) + " FROM requests GROUP BY scenario")
def t10_pivot_resources(spark, sf):
    """Every runtime's mean, with how many of its requests have a value."""
    wide = sm.pivot_resources(base.requests(spark, sf), "scenario", "runtime", RUNTIMES, "ttft_ms")
    return wide.select("scenario", *[x for k, r in enumerate(RUNTIMES) for x in (F.round(F.col(f"`{r}`"), 6).alias(f"r{k}"), F.col(f"`{r} coverage`").alias(f"c{k}"))])


@query("""
SELECT scenario, row_number() OVER (ORDER BY CASE scenario WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, scenario) AS place FROM (SELECT DISTINCT scenario FROM requests)
""")
def t11_ordered_scenarios(spark, sf):
    names = base.requests(spark, sf).select("scenario").distinct()  # a handful of names
    key = runs.ordered_scenarios(names, ["MACHINERY", "BUILDING"])
    return names.select("scenario", F.row_number().over(Window.orderBy(key)).cast("long").alias("place"))


@query("SELECT event_id, avg(CAST(answered <> asked AS INT)) AS mismatch FROM (SELECT event_id % 50 AS event_id, event_id AS asked, CASE WHEN event_id % 9 = 0 THEN event_id + 1 ELSE event_id END AS answered FROM events) GROUP BY event_id")
def j15_echo_mismatch(spark, sf):
    asked = base.events(spark, sf).select("event_id", F.col("event_id").alias("asked"))
    answers = base.events(spark, sf).select("event_id", F.expr("CASE WHEN event_id % 9 = 0 THEN event_id + 1 ELSE event_id END").alias("answered"))
    return sm.echo_mismatch(asked, answers, "event_id", [(F.col("event_id") % 50).alias("event_id")], "asked", "answered").drop("n")

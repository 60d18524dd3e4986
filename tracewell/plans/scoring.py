"""Queries over tag sets: scores by example, by tag, by group, and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import runs, scoring
from ..operators import summaries as sm
from ..sources.tables import table
from . import base
from .base import query

TYPES = ["view", "click", "purchase", "signup", "error"]


def scored(spark, sf):
    t = base.tagged(spark, sf).withColumn("s", lb.compare_tags(F.col("expected"), F.col("generated")))
    return t.select("*", "s.precision", "s.recall", "s.f1", "s.exact_match", (F.col("user_id") % 9 != 0).alias("parse_ok"), (F.col("user_id") % 17 != 0).alias("request_ok")).drop("s")


@query('SELECT example_id, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, exact_match FROM scored')
def x6_compare_tags(spark, sf):
    return scored(spark, sf).select("example_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "exact_match")


@query("SELECT example_id, array_to_string(list_sort(list_intersect(expected, generated)), ',') AS correct, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(generated, x))), ',') AS missing FROM tagged")
def u3_tag_set_ops(spark, sf):
    c = lb.compare_tags(F.col("expected"), F.col("generated"))
    return base.tagged(spark, sf).select("example_id", F.array_join(c["correct"], ",").alias("correct"), F.array_join(c["missing"], ",").alias("missing"))


@query("SELECT model, split, n, parse_rate, mean_f1, exact_rate, macro_f1 FROM (SELECT model, split, count(*) AS n, round(avg(CAST(parse_ok AS INT)), 9) AS parse_rate, round(avg(f1), 9) AS mean_f1, round(avg(CAST(exact_match AS INT)), 9) AS exact_rate FROM scored GROUP BY ALL) JOIN (SELECT model, split, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1 FROM (SELECT model, split, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM marks GROUP BY ALL) GROUP BY ALL) USING (model, split)")
def a7_quality_summary(spark, sf):
    out = scoring.quality_summary(scored(spark, sf), ["model", "split"])
    return out.withColumns({c: F.round(c, 9) for c in ("parse_rate", "mean_f1", "exact_rate", "macro_f1")})


@query("SELECT model, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1 FROM (SELECT model, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM marks GROUP BY ALL) GROUP BY model")
def a8_macro_f1(spark, sf):
    return scoring.macro_f1(scored(spark, sf), ["model"]).withColumn("macro_f1", F.round("macro_f1", 9))


TAGS_SQL = ", ".join(f"'{t}'" for t in [*TYPES, "never"])


@query(f"""
, pairs AS (SELECT split, label, tp, fp, fn FROM marks UNION ALL SELECT 'all', label, tp, fp, fn FROM marks),
grid AS (SELECT s.split, l.label FROM (SELECT DISTINCT split FROM pairs) s, (SELECT unnest([{TAGS_SQL}]) AS label) l),
sums AS (SELECT g.split, g.label, coalesce(sum(tp), 0) AS tp, coalesce(sum(fp), 0) AS fp, coalesce(sum(fn), 0) AS fn FROM grid g LEFT JOIN pairs b ON g.split = b.split AND g.label = b.label GROUP BY ALL)
SELECT split, label, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, CAST(tp + fn AS BIGINT) AS expected_support, CAST(tp + fp AS BIGINT) AS generated_support FROM sums
""")
def a9_metrics_by_tag(spark, sf):
    out = scoring.metrics_by_tag(scored(spark, sf), "split", [*TYPES, "never"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("SELECT model, count(*) AS n, round(avg(CAST(request_ok AS INT)), 9) AS request_rate, round(avg(CAST(parse_ok AS INT)), 9) AS parse_rate, round(avg(f1), 9) AS mean_f1, round(avg(latency_ms), 4) AS mean_latency FROM scored GROUP BY model")
def a10_summarize_predictions(spark, sf):
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 9)
    return scored(spark, sf).groupBy("model").agg(F.count("*").alias("n"), rate("request_ok").alias("request_rate"), rate("parse_ok").alias("parse_rate"), F.round(F.avg("f1"), 9).alias("mean_f1"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"))


@query('SELECT split, count(*) AS n, round(avg("precision"), 9) AS "precision", round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, round(avg(CAST(exact_match AS INT)), 9) AS exact_rate FROM (SELECT * FROM scored UNION ALL SELECT * REPLACE (\'all\' AS split) FROM scored) GROUP BY split')
def a11_compare_split(spark, sf):
    r = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    return scoring.with_all(scored(spark, sf), "split").groupBy("split").agg(F.count("*").alias("n"), *[r(c).alias(c) for c in ("precision", "recall", "f1")], r("exact_match").alias("exact_rate"))


@query("SELECT split, model, count(DISTINCT user_id) AS runs, min(day) AS first_day, max(day) AS last_day FROM tagged WHERE split IS NOT NULL AND model IS NOT NULL GROUP BY split, model")
def a12_eval_groups(spark, sf):
    return base.tagged(spark, sf).dropna(subset=["split", "model"]).groupBy("split", "model").agg(F.count_distinct("user_id").alias("runs"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("SELECT model, count(DISTINCT user_id) AS runs, count(*) AS requests, round(avg(latency_ms), 4) AS mean_latency, arg_min(day, (day, pos)) AS first_day FROM tagged GROUP BY model")
def a13_model_summary(spark, sf):
    return base.tagged(spark, sf).groupBy("model").agg(F.count_distinct("user_id").alias("runs"), F.count("*").alias("requests"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.min_by("day", F.struct("day", "pos")).alias("first_day"))


TURNS = "turns AS (SELECT *, user_id // 2 AS pair, user_id % 2 + 1 AS turn FROM scored), deltas AS (SELECT b.*, b.f1 - a.f1 AS d FROM turns b JOIN (SELECT pair, day, arg_min(f1, pos) AS f1 FROM turns WHERE turn = 1 GROUP BY ALL) a ON a.pair = b.pair AND a.day = b.day WHERE b.turn = 2)"


def deltas(spark, sf):
    t = scored(spark, sf).withColumn("pair", F.floor(F.col("user_id") / 2)).withColumn("turn", F.col("user_id") % 2 + 1)
    return scoring.review_deltas(t, ["pair", "day"])


@query(f", {TURNS} SELECT example_id, round(d, 9) AS f1_delta, d > 0 AS improved, d < 0 AS regressed FROM deltas")
def j5_review_deltas(spark, sf):
    return deltas(spark, sf).select("example_id", F.round("f1_delta", 9).alias("f1_delta"), "improved", "regressed")


@query(f", {TURNS} SELECT model, count(*) AS n, round(avg(d), 9) AS mean_delta, round(avg(CAST(d > 0 AS INT)), 9) AS improved, round(avg(CAST(d < 0 AS INT)), 9) AS regressed FROM deltas GROUP BY model")
def a14_review_effect(spark, sf):
    return sm.review_effect(deltas(spark, sf), ["model"]).withColumns({c: F.round(c, 9) for c in ("mean_delta", "improved", "regressed")})


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS unmatched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j3_join_golden(spark, sf):
    found = sm.join_golden(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return found.select("doc_id", "quality", "unmatched")


@query("SELECT e.event_id, r.ttft_ms FROM ev e LEFT JOIN (SELECT request_uid, run_id, repetition, min(ttft_ms) AS ttft_ms FROM requests WHERE benchmark_phase = 'measure' GROUP BY ALL) r ON e.event_id = r.request_uid AND e.user_id % 7 = r.run_id AND e.event_id % 3 = r.repetition")
def j4_join_performance(spark, sf):
    left = base.events(spark, sf).select(F.col("event_id").alias("request_uid"), (F.col("user_id") % 7).alias("run_id"), (F.col("event_id") % 3).alias("repetition"))
    return sm.join_performance(left, base.requests(spark, sf), ["request_uid", "run_id", "repetition"], ["ttft_ms"]).select(F.col("request_uid").alias("event_id"), "ttft_ms")


@query("SELECT example_id, array_to_string(list_filter(['view', 'click', 'purchase', 'signup', 'error'], lambda t: CAST(list_contains(expected, t) AS INT) + CAST(list_contains(generated, t) AS INT) + CAST(list_contains(third, t) AS INT) >= 2), ',') AS golden FROM tagged")
def x7_majority_vote(spark, sf):
    t = base.tagged(spark, sf)
    return t.select("example_id", F.array_join(lb.majority_vote([F.col(c) for c in ("expected", "generated", "third")], lb.array_of(TYPES)), ",").alias("golden"))


@query("SELECT a.example_id, len(a.expected) AS n_a, len(b.generated) AS n_b, len(c.third) AS n_c FROM tagged a JOIN (SELECT * FROM tagged WHERE pos % 2 = 0) b USING (example_id) JOIN (SELECT * FROM tagged WHERE pos % 3 = 0) c USING (example_id)")
def j6_three_voter_join(spark, sf):
    t = base.tagged(spark, sf)
    voter = lambda rows, c, a: rows.select("example_id", F.size(c).cast("long").alias(a))
    return sm.three_voter_join(voter(t, "expected", "n_a"), voter(t.where("pos % 2 = 0"), "generated", "n_b"), voter(t.where("pos % 3 = 0"), "third", "n_c"), "example_id")


@query("SELECT split, count(*) AS n FROM tagged JOIN (SELECT DISTINCT user_id || '-' || strftime(ts, '%Y-%m-%d') AS k FROM events WHERE value > 100) ON k = example_id GROUP BY split")
def j7_golden_vs_model(spark, sf):
    e = table(spark, sf, "events").where("value > 100").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).alias("example_id"))
    return sm.golden_vs_model(base.tagged(spark, sf), e, "example_id").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT example_id, array_to_string(list_filter(expected, lambda x: x IN ('view', 'purchase')), ',') AS tags, len(list_filter(expected, lambda x: x IN ('view', 'purchase'))) AS n_tags, len(expected) AS n_all FROM tagged")
def x8_project_tags(spark, sf):
    kept = lb.project_tags(F.col("expected"), lb.array_of(["view", "purchase"]))
    return base.tagged(spark, sf).select("example_id", F.array_join(kept, ",").alias("tags"), F.size(kept).cast("long").alias("n_tags"), F.size("expected").cast("long").alias("n_all"))


@query("SELECT len(list_filter(expected, lambda x: x NOT IN ('view', 'click'))) AS n_invalid, count(*) AS n FROM tagged GROUP BY 1")
def x9_n_invalid_tags(spark, sf):
    return base.tagged(spark, sf).groupBy(lb.n_outside(F.col("expected"), lb.array_of(["view", "click"])).cast("long").alias("n_invalid")).agg(F.count("*").alias("n"))


@query("SELECT example_id, array_to_string(list_sort(list_distinct(list_transform(expected, lambda x: lower(x)))), '|') AS tags FROM tagged")
def x1_normalize_tags(spark, sf):
    messy = F.flatten(F.transform("expected", lambda x: F.array(F.concat(F.lit("  "), F.upper(x), F.lit(" ")), x, F.lit(" "))))
    return base.tagged(spark, sf).select("example_id", F.array_join(lb.normalize_tags(messy), "|").alias("tags"))


#: Ways to write a list of tags, by user: the text's start and end, and whether it is then a list literal.
FORMS = [
    ("['", "', '", "']", True), ("```python\n['", "', '", "']\n```", True), ('["', '", "', '"]', True), ("['", "' ,\n'", "',]", True), ("['", "', '", "'] trailing", False), ("('", "', '", "',)", False),
    ("(['", "', '", "'])", True), ("['", "', None, '", "']", True), ("no ['", "', '", "']", False), ("['' '", "', r'", "']", True), ("['", "', '", "'", False), ('{"tags":["', '", "', '"]}', False),
]
SHOWN = "CASE user_id % 12 " + " ".join(f"WHEN {k} THEN {ok}" for k, (*_, ok) in enumerate(FORMS)) + " END"
#: Between two tags stands a None in the eighth form; it counts as the tag none.
WITH_NONE = "CASE WHEN user_id % 12 = 7 AND len(expected) > 1 THEN list_sort(list_append(expected, 'none')) ELSE expected END"


def written_lists():
    pick = lambda at: F.element_at(F.array(*[F.lit(f[at]) for f in FORMS]), (F.col("user_id") % 12 + 1).cast("int"))
    return F.concat(pick(0), F.array_join("expected", "\x00"), pick(2)), pick(1)


def with_lists(spark, sf):
    text, between = written_lists()
    return base.tagged(spark, sf).withColumn("shown", F.replace(text, F.lit("\x00"), between))


@query(f"SELECT example_id, CASE WHEN {SHOWN} THEN array_to_string({WITH_NONE}, '|') ELSE '' END AS tags, {SHOWN} AS ok FROM tagged")
def x3_parse_model_output(spark, sf):
    """Lists in a dozen forms, five of which hold more or less than a list literal."""
    out = lb.parse_model_output(F.col("shown"))
    return with_lists(spark, sf).select("example_id", F.array_join(out["tags"], "|").alias("tags"), out["ok"].alias("ok"))


@query(f"SELECT example_id, CASE WHEN {SHOWN} AND user_id % 12 <> 1 THEN array_to_string({WITH_NONE}, '|') ELSE '' END AS tags FROM tagged")
def x2_parse_tags(spark, sf):
    """The same without code fences, which parse_tags doesn't know."""
    tags = F.coalesce(lb.normalize_tags(lb.parse_list(F.col("shown"))), lb.array_of([]))
    return with_lists(spark, sf).select("example_id", F.array_join(tags, "|").alias("tags"))


@query("""
SELECT example_id, CASE user_id % 6 WHEN 0 THEN array_to_string(expected, '|') WHEN 1 THEN array_to_string(expected, '|') WHEN 2 THEN array_to_string(expected, '|') WHEN 3 THEN array_to_string(expected, '|') ELSE '' END AS tags,
    user_id % 6 < 4 AS ok FROM tagged
""")
def x4_parse_tags_either(spark, sf):
    """JSON lists (also with null), list literals (also with None), lists of nothing and lists with text behind."""
    js = F.to_json("expected")
    py = F.concat(F.lit("['"), F.array_join("expected", "', '"), F.lit("']"))
    end = lambda t, more: F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit(more))
    forms = [js, py, end(js, ", null]"), end(py, ", None]"), F.lit("[null]"), F.concat(js, F.lit(" so"))]
    got = lb.parse_tags_either(F.element_at(F.array(*forms), (F.col("user_id") % 6 + 1).cast("int")))
    return base.tagged(spark, sf).select("example_id", F.array_join(got["tags"], "|").alias("tags"), got["ok"].alias("ok"))


@query("SELECT example_id, CASE WHEN list_contains(expected, 'error') OR user_id % 5 > 1 THEN '' ELSE array_to_string(expected, '|') END AS tags, NOT list_contains(expected, 'error') AND user_id % 5 < 2 AS ok FROM tagged")
def x5_parse_structured_output(spark, sf):
    """Objects as they should be, with blanks around, with text behind, with a null tag, and twice."""
    allowed = lb.array_of([t for t in TYPES if t != "error"])
    whole = F.to_json(F.struct(F.col("expected").alias("tags")))
    forms = [whole, F.concat(F.lit(" \n"), whole, F.lit("\n")), F.concat(whole, F.lit(" thanks")), F.replace(whole, F.lit("["), F.lit("[null,")), F.concat(whole, whole)]
    out = lb.parse_structured_output(F.element_at(F.array(*forms), (F.col("user_id") % 5 + 1).cast("int")), allowed)
    return base.tagged(spark, sf).select("example_id", F.array_join(out["tags"], "|").alias("tags"), out["ok"].alias("ok"))


@query("SELECT example_id, round(f1, 9) AS f1, round(latency_ms, 6) AS latency_ms FROM scored ORDER BY f1, latency_ms, example_id LIMIT 20")
def t1_worst_examples(spark, sf):
    return scoring.worst(scored(spark, sf)).select("example_id", F.round("f1", 9).alias("f1"), F.round("latency_ms", 6).alias("latency_ms"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
def w3_dedup(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    order = [F.col("ts"), F.col("event_id")]
    first, last = scoring.dedup(e, ["user_id"], order), scoring.dedup(e, ["user_id"], order, last=True)
    return first.select("user_id", F.col("event_id").alias("first_id")).join(last.select("user_id", F.col("event_id").alias("last_id")), "user_id")


@query("SELECT event_id, event_type, value, sha256(event_type || event_id) AS payload, 'all-' || lpad(CAST(row_number() OVER (ORDER BY event_type, user_id, event_id) - 1 AS VARCHAR), 6, '0') AS custom_id, (row_number() OVER (ORDER BY event_type, user_id, event_id) - 1) // 1000 AS chunk FROM events")
def w13_row_ordinals(spark, sf):
    """Wide rows in few types and users, whose exact places depend on their ids."""
    e = table(spark, sf, "events").withColumn("payload", F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256))
    out = scoring.row_ordinals(e, ["event_type", "user_id", "event_id"])
    return out.select("event_id", "event_type", "value", "payload", F.concat(F.lit("all-"), F.lpad(F.col("ordinal").cast("string"), 6, "0")).alias("custom_id"), F.floor(F.col("ordinal") / 1000).alias("chunk"))


@query("SELECT example_id, 'm' || (user_id % 4) AS label, CASE user_id % 4 WHEN 0 THEN CAST(7 AS DOUBLE) WHEN 1 THEN 1.5 END AS parameters_b, CASE user_id % 4 WHEN 0 THEN 'q4_K_M' WHEN 1 THEN 'Q8_0' END AS quantization FROM tagged")
def x21_model_attributes(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("fam-7b-q4_K_M", "fam", "other", "plain8bx"))), (F.col("user_id") % 4 + 1).cast("int"))
    size, level = F.when(F.col("user_id") % 4 == 1, "1.5 B"), F.when(F.col("user_id") % 4 == 1, "Q8_0")
    a = tx.model_attributes(name, size, level)
    return base.tagged(spark, sf).select("example_id", F.col("model").alias("label"), a["parameters_b"].alias("parameters_b"), a["quantization"].alias("quantization"))


@query("SELECT comparison_id, runs, runtimes, n_runtimes >= 2 AS ready FROM (SELECT run_id % 3 AS comparison_id, count(*) AS runs, '[' || array_to_string(list_transform(list_sort(list_distinct(list(runtime))), lambda x: '\"' || x || '\"'), ',') || ']' AS runtimes, count(DISTINCT runtime) AS n_runtimes FROM (SELECT DISTINCT run_id, runtime FROM requests) GROUP BY 1)")
def a15_comparison_groups(spark, sf):
    r = base.requests(spark, sf).select("run_id", "runtime").distinct().withColumn("comparison_id", F.col("run_id") % 3).withColumn("model", F.lit("m"))
    return runs.comparison_groups(r).select("comparison_id", "runs", "runtimes", F.col("cross_runtime_ready").alias("ready"))

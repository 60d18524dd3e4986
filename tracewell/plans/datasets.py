"""Queries over labelled examples, samples, conversations, batches and companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import company as co
from ..functions import json as js
from ..functions import labels as lb
from ..functions import numbers, text as tx
from ..operators import conversations as cv
from ..operators import datasets as ds
from ..operators import gates, runs
from ..operators import summaries as sm
from ..operators.percentiles import with_percentiles
from ..operators.scoring import dedup
from ..sources import tables as io
from ..sources.tables import table
from . import base
from .base import query


#: Raw records of documents: a domain in several forms, a date that a seventh lacks, and tags of which two fifths are none.
RAW = """
, raw AS (SELECT doc_id, coalesce(source, '') AS domain, coalesce(text, '') AS text, doc_id % 7 <> 0 AS dated, [['b2b', 'produto'], ['b2b'], [], [], ['zz']][doc_id % 5 + 1] AS tags FROM documents)
"""


def raw_records(spark, sf):
    d = table(spark, sf, "documents")
    form = lambda n, *forms: F.element_at(F.array(*[f if isinstance(f, Column) else F.lit(f) for f in forms]), (F.col("doc_id") % n + 1).cast("int"))
    domain = form(3, F.concat(F.lit("https://www."), F.upper("source"), F.lit("/a/b")), F.concat(F.lit(" "), "source"), F.col("source"))
    raw = d.select("doc_id", domain.alias("domain"), F.col("text").alias("business_model"), form(5, '["b2b", null, "produto"]', "['b2b',]", "[]", "oops", '["zz"]').alias("tags"), F.when(F.col("doc_id") % 7 == 0, "no date").otherwise("20240102T030405Z").alias("enriched_at"))
    return ds.cleaned(raw, lb.TAXONOMY)


@query(RAW + "SELECT domain, count(*) AS n FROM raw WHERE domain <> '' AND regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') <> '' AND dated AND tags IN (['b2b'], ['b2b', 'produto']) GROUP BY domain")
def f2_eligible(spark, sf):
    return ds.eligible(raw_records(spark, sf)).groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id % 5 NOT IN (0, 1, 2)")
def f3_valid_source_rows(spark, sf):
    tags = F.element_at(F.array(*map(F.lit, (" [] ", "None", "nan", "['a']", "x"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return ds.valid_source_rows(table(spark, sf, "documents").withColumn("tags", tags), "text", "tags").select("doc_id")


@query("""
, d AS (SELECT CASE WHEN doc_id % 4 = 0 THEN sha256(text) ELSE CAST(doc_id AS VARCHAR) END AS example_id, sha256(text) AS input_sha256, length(text) AS chars FROM documents WHERE trim(text) <> '')
SELECT *, CASE WHEN count(*) OVER (PARTITION BY example_id) > 1 THEN 'duplicate id' END AS reason FROM d
""")
def f5_load_unlabelled(spark, sf):
    d = table(spark, sf, "documents").withColumn("id", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("doc_id").cast("string")))
    rows, errors = ds.load_unlabelled(d)
    return rows.join(errors.select("example_id", F.lit("duplicate id").alias("reason")), "example_id", "left")


@query("""
, d AS (SELECT doc_id, sha256(text) AS example_id, ['produto', 'b2b'] AS tags FROM documents WHERE text IS NOT NULL AND doc_id % 4 IN (0, 1)),
o AS (SELECT doc_id, CAST(doc_id % 500 AS VARCHAR) AS example_id FROM documents WHERE text IS NOT NULL AND doc_id % 4 IN (0, 1) AND doc_id % 9 <> 0)
SELECT 'text' AS ids, example_id, min(doc_id) AS doc_id, 'b2b|produto' AS tags FROM d GROUP BY example_id UNION ALL SELECT 'own', example_id, min(doc_id), 'b2b|produto' FROM o GROUP BY example_id
""")
def f4_load_labelled(spark, sf):
    """With ids of the texts and with own ones, of which a ninth is null; half of the rows have no list, or an empty one."""
    d = table(spark, sf, "documents")
    shown = F.element_at(F.array(*map(F.lit, ("['Produto ', 'b2b']", "['b2b', 'produto', 'B2B']", "[]", "['b2b'] and more"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = d.select("doc_id", F.col("text").alias("business_model"), shown.alias("tags"))
    own = rows.withColumn("example_id", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 500))
    both = [ds.load_labelled(x, ["doc_id"]).select(F.lit(name).alias("ids"), "example_id", "doc_id", F.array_join("expected_tags", "|").alias("tags")) for name, x in (("text", rows), ("own", own))]
    return both[0].unionByName(both[1])


@query("""
SELECT id, array_to_string(list_filter([CASE WHEN n > 1 THEN 'duplicate id' END, CASE WHEN trim(text) = '' THEN 'blank text' END, CASE WHEN id IN ('0', '1') THEN 'unknown tag' END], lambda x: x IS NOT NULL), ';') AS reasons
FROM (SELECT CAST(doc_id % 900 AS VARCHAR) AS id, text, count(*) OVER (PARTITION BY doc_id % 900) AS n FROM documents) WHERE n > 1 OR trim(text) = '' OR id IN ('0', '1')
""")
def f6_load_golden_strict(spark, sf):
    g = table(spark, sf, "documents").select((F.col("doc_id") % 900).cast("string").alias("id"), "text")
    g = g.withColumn("tags", F.when(F.col("id").isin("0", "1"), F.array(F.lit("zz"))).otherwise(lb.array_of(lb.TAXONOMY[:2])))
    return ds.golden_errors(g, lb.TAXONOMY).select("id", F.array_join("reasons", ";").alias("reasons"))


@query("SELECT source, arg_max(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY source")
def w1_latest_per_key(spark, sf):
    return ds.latest_per_key(table(spark, sf, "documents").select("source", "n_chars", "doc_id"), "source", "n_chars", "doc_id").select("source", "doc_id")


@query(RAW + "SELECT count(*) AS rows, count(DISTINCT domain) AS domains, count(*) FILTER (doc_id % 5 IN (2, 3)) AS parse_failures, count(*) FILTER (len(tags) = 0) AS empty_tags, count(*) FILTER (NOT dated) AS invalid_dates, count(DISTINCT " + "array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(s, '[ \\t]+', ' ', 'g'))), lambda s: s <> ''), chr(10))) AS texts FROM raw")
def a17_quality_counts(spark, sf):
    return ds.quality_counts(raw_records(spark, sf))


@query("SELECT text_hash, count(DISTINCT tags) AS tag_sets, count(*) AS n FROM examples GROUP BY text_hash HAVING count(DISTINCT tags) > 1")
def a18_label_conflicts(spark, sf):
    return ds.label_conflicts(base.examples(spark, sf), "text_hash", "tags")


@query("SELECT tag, count(*) AS n, count(DISTINCT source) AS domains FROM (SELECT source, unnest(tags) AS tag FROM examples) GROUP BY tag")
def a19_tag_frequency(spark, sf):
    return ds.tag_frequency(base.examples(spark, sf), "tags", "source")


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99, CAST(max(n_chars) AS DOUBLE) AS max FROM documents GROUP BY lang")
def a20_distribution(spark, sf):
    out = runs.distribution(table(spark, sf, "documents"), ["lang"], "n_chars")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p90", "p95", "p99")})


SPLIT = "CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END"
SPLITS = f", splits AS (SELECT *, {SPLIT} AS split FROM (SELECT *, CAST(('0x' || substr(sha256('42:' || text_hash), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM examples))"


@query(SPLITS + " SELECT doc_id, split FROM splits")
def t7_group_split(spark, sf):
    return ds.group_split(base.examples(spark, sf), "text_hash").select("doc_id", "split")


@query(SPLITS + " SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM splits), 9) AS share FROM splits GROUP BY split")
def a21_split_shapes(spark, sf):
    return sm.split_shapes(ds.group_split(base.examples(spark, sf), "text_hash")).withColumn("share", F.round("share", 9))


@query(SPLITS + " SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM splits WHERE split = 'train') GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def t2_top_k_tags(spark, sf):
    return ds.top_k_tags(ds.group_split(base.examples(spark, sf), "text_hash").where("split = 'train'"), "tags", 5)


@query("SELECT id FROM examples ORDER BY sha256('7' || chr(0) || id), id LIMIT 50")
def t3_hash_ranked_sample(spark, sf):
    return ds.hash_ranked_sample(base.examples(spark, sf), 50, "7", "id").select("id")


@query("SELECT id FROM examples ORDER BY sha256('sample' || chr(0) || id), id LIMIT 25")
def t6_random_sample(spark, sf):
    return ds.hash_ranked_sample(base.examples(spark, sf), 25, "sample", "id").select("id")


BUCKETS = ", thirds AS (SELECT quantile_disc(words, 1/3) AS t1, quantile_disc(words, 2/3) AS t2 FROM examples), bucketed AS (SELECT e.*, CASE WHEN words <= t1 THEN 'short' WHEN words <= t2 THEN 'medium' ELSE 'heavy' END AS bucket FROM examples e, thirds)"


def bucketed(spark, sf):
    e = base.examples(spark, sf)
    t = ds.tercile_thresholds(e, "words")
    return e.join(F.broadcast(t)).withColumn("bucket", ds.bucket_for(F.col("words"), F.col("t1"), F.col("t2")))


@query(BUCKETS + " SELECT t1, t2 FROM thirds")
def t5_tercile_thresholds(spark, sf):
    return ds.tercile_thresholds(base.examples(spark, sf), "words").select(F.col("t1").cast("long").alias("t1"), F.col("t2").cast("long").alias("t2"))


@query(BUCKETS + " SELECT bucket, count(*) AS n, sum(words) AS words FROM bucketed GROUP BY bucket")
def x36_token_count_buckets(spark, sf):
    return bucketed(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@query(BUCKETS + ", ranked AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42:' || id), id) AS position FROM bucketed) SELECT id, bucket, position FROM ranked WHERE position <= 20")
def t4_stratified_hash_sample(spark, sf):
    return ds.stratified_hash_sample(bucketed(spark, sf).select("id", "bucket"), 20, "42").select("id", "bucket", F.col("position").cast("long").alias("position"))


@query(BUCKETS + ", ranked AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42:' || id), id) AS position FROM bucketed) SELECT sum(n) AS requests, any_value(t1) AS t1, sha256(string_agg(ids, chr(10) ORDER BY position)) AS order_sha256 FROM (SELECT position, count(*) AS n, string_agg(id, chr(10) ORDER BY list_position(['short', 'medium', 'heavy'], bucket)) AS ids FROM ranked WHERE position <= 20 GROUP BY position), thirds")
def a34_workload_manifest(spark, sf):
    got = ds.stratified_hash_sample(bucketed(spark, sf).select("id", "bucket", "t1"), 20, "42")  # 60 rows
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "bucket_order", "id"))), lambda x: x["id"])
    return got.agg(F.count("*").alias("requests"), F.first("t1").cast("long").alias("t1"), F.sha2(F.array_join(ids, "\n"), 256).alias("order_sha256"))


@query("SELECT doc_id, sha256(text) AS sha, slot FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS total FROM documents) JOIN range(5000) r(slot) ON slot % total = k")
def t8_cycle_rows(spark, sf):
    """Wide records: whole texts go along."""
    return ds.cycle_rows(table(spark, sf, "documents"), "doc_id", 5000).select("doc_id", F.sha2("text", 256).alias("sha"), "slot")


@query("SELECT id FROM examples WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0))")
def j8_pending(spark, sf):
    history = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("request_ok"), (F.col("toxic") == 0).alias("parse_ok"))
    return ds.pending(base.examples(spark, sf).select("id"), history, "id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 30")
def j9_exclude_overlap(spark, sf):
    return ds.exclude_overlap(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", 30)


@query("SELECT doc_id, coalesce(lower(CAST(quality AS VARCHAR)), 'missing') AS error FROM documents LEFT JOIN labels USING (doc_id)")
def j10_batch_results_join(spark, sf):
    last = dedup(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], [F.col("quality")], last=True)
    return table(spark, sf, "documents").select("doc_id").join(last, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("missing")).alias("error"))


@query("""
, c AS (SELECT lang, count(*) AS requests, CAST(sum(ceil(strlen(coalesce(text, '')) / 3) + 200) AS BIGINT) AS input_tokens, CAST(sum(strlen(coalesce(text, '')) + 200) AS BIGINT) AS most_input_tokens FROM documents GROUP BY lang),
u AS (SELECT *, requests * 256 AS most_output_tokens, round((input_tokens * 0.05 + requests * 256 * 0.4) / 1e6, 9) AS total_usd, round((most_input_tokens * 0.05 + requests * 256 * 0.4) / 1e6, 9) AS most_total_usd FROM c)
SELECT *, (SELECT sum(most_input_tokens * 0.05 + requests * 256 * 0.4) / 1e6 <= 0.1 FROM c) AS within FROM u
""")
def a25_batch_cost(spark, sf):
    costs = ds.batch_cost(table(spark, sf, "documents"), F.col("text"), "lang")
    gate = ds.budget_gate(costs, 0.1).select("within")  # one row
    return costs.crossJoin(F.broadcast(gate)).select("lang", "requests", "input_tokens", "most_input_tokens", "most_output_tokens", F.round("total_usd", 9).alias("total_usd"), F.round("most_total_usd", 9).alias("most_total_usd"), "within")


@query("SELECT run_id, round(sum(((prompt_tokens - least(output_tokens * 3, prompt_tokens)) * 0.05 + least(output_tokens * 3, prompt_tokens) * 0.005 + output_tokens * 0.4) / 1e6), 9) AS usd FROM requests GROUP BY run_id")
def a26_usage_cost(spark, sf):
    cost = numbers.usage_cost(F.col("prompt_tokens"), F.col("output_tokens") * 3, F.col("output_tokens"))
    return base.requests(spark, sf).groupBy("run_id").agg(F.round(F.sum(cost), 9).alias("usd"))


@query("""
, h AS (SELECT *, user_id % 5 <> 0 AS there FROM scored)
SELECT split, count(*) AS examples, count(*) FILTER (there) AS materialised, count(*) FILTER (there AND request_ok) AS successful, count(*) FILTER (there AND parse_ok) AS parsed, count(*) FILTER (there AND NOT request_ok) AS failed,
    count(*) - count(*) FILTER (there AND parse_ok) AS pending, round(count(*) FILTER (there AND request_ok) / count(*), 9) AS request_success_rate, round(count(*) FILTER (there AND parse_ok) / count(*), 9) AS parse_rate,
    round(avg(latency_ms) FILTER (there AND request_ok), 6) AS mean_latency_ms, round(avg(f1) FILTER (there AND parse_ok), 9) AS mean_f1, round(avg(CAST(exact_match AS INT)) FILTER (there AND parse_ok), 9) AS exact_match_rate FROM h GROUP BY split
""")
def a24_materialize_summary(spark, sf):
    t = base.tagged(spark, sf).withColumn("s", lb.compare_tags(F.col("expected"), F.col("generated")))
    history = t.where("user_id % 5 <> 0").select("example_id", (F.col("user_id") % 17 != 0).alias("request_ok"), (F.col("user_id") % 9 != 0).alias("parse_ok"), "latency_ms", "s.f1", "s.exact_match")
    got = ds.materialize_summary(t, history, "split")
    exact = ["split", "examples", "materialised", "successful", "parsed", "failed", "pending"]
    return got.select(*exact, *[F.round(c, 6 if c == "mean_latency_ms" else 9).alias(c) for c in ("request_success_rate", "parse_rate", "mean_latency_ms", "mean_f1", "exact_match_rate")])


@query("SELECT page_id, split_part(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '/', 1) AS domain FROM pages")
def x10_normalize_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.normalize_domain(F.col("url")).alias("domain"))


@query(r"SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '\r\n?', chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'))), lambda s: s <> ''), chr(10))) AS text_sha FROM pages")
def x11_normalize_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(tx.normalize_text(F.col("html")), 256).alias("text_sha"))


@query("SELECT doc_id, sha256(text) AS text_hash, sha256(source || '|' || sha256(text)) AS example_id FROM documents")
def x12_content_ids(spark, sf):
    c = tx.content_ids(F.col("source"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", c["text_hash"].alias("text_hash"), c["example_id"].alias("example_id"))


@query("SELECT event_id, lower(trim(event_type)) AS kind, CAST(value AS VARCHAR) AS v FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, lower(trim(event_type)), NULL FROM events WHERE event_id % 2 = 1")
def x13_json_fields(spark, sf):
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit(" "), F.upper("event_type")).alias("kind")).alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).alias("v")))
    return table(spark, sf, "events").select("event_id", F.lower(F.trim(F.get_json_object(doc, "$.a.kind"))).alias("kind"), F.get_json_object(doc, "$.v").alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS v FROM events")
def x14_first_scalar(spark, sf):
    doc = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("a"), F.struct(F.col("user_id").alias("id")).alias("b")))
    return table(spark, sf, "events").select("event_id", tx.first_scalar(doc, "$.a", "$.b", "$.b.id").alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 THEN value END AS v FROM events")
def x15_to_number(spark, sf):
    text = F.element_at(F.array(F.col("value").cast("string"), F.concat(F.lit(" "), F.col("value").cast("string")), F.lit("NaN"), F.lit("inf"), F.lit("x1")), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", numbers.to_number(text).alias("v"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def x30_slug(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.slug(F.concat(F.lit(" "), F.replace("c_name", F.lit("o"), F.lit("ó")), F.lit("!"))).alias("slug"))


@query("SELECT request_uid, 'exp-' || run_id || ':b:' || request_uid || ':' || repetition AS uid, strftime(make_timestamp(CAST(start_s * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS started FROM requests")
def x37_uid(spark, sf):
    r = base.requests(spark, sf)
    return r.select("request_uid", tx.uid(F.concat(F.lit("exp-"), F.col("run_id").cast("string")), F.lit("b"), F.col("request_uid").cast("string"), F.col("repetition")).alias("uid"), tx.utc_text(F.col("start_s")).alias("started"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch_us(date_trunc('second', ts)) END AS us FROM events")
def x38_parse_utc(spark, sf):
    t = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(t, "yyyyMMdd'T'HHmmss'.000000Z'")).when(F.col("event_id") % 3 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("never")
    return table(spark, sf, "events").select("event_id", F.unix_micros(tx.parse_utc(text)).alias("us"))


@query("SELECT event_id, event_id % 8 AS parallel, CASE WHEN event_id % 2 = 0 THEN 'gateway' ELSE 'runtime' END AS via, 'on' AS cache, user_id AS streams FROM events")
def x39_cell_path(spark, sf):
    via = F.when(F.col("event_id") % 2 == 0, "-via-gateway").otherwise("")
    path = F.concat(F.lit("root/p"), F.col("event_id") % 8, F.lit("-ctx65536-cache-on"), via, F.lit("/s"), F.col("user_id"), F.lit("-r1"))
    return table(spark, sf, "events").withColumn("c", tx.cell_path(path)).select("event_id", F.col("c.parallel").cast("long").alias("parallel"), "c.via", "c.cache", F.col("c.streams").cast("long").alias("streams"))


@query("""SELECT o_orderkey, 'runtime:vllm|model-family:qwen|quantization:' || CASE o_orderkey % 3 WHEN 0 THEN 'q4' WHEN 1 THEN 'fp16' ELSE 'unknown' END || '|context:' || CASE WHEN o_orderkey % 6000 < 512 THEN 'short' WHEN o_orderkey % 6000 < 4096 THEN 'medium' ELSE 'long' END
    || '|phase:measure|status:' || CASE WHEN o_orderstatus = 'P' THEN 'degraded' ELSE 'complete' END || '|performance:' || CASE WHEN o_orderkey % 7 = 0 THEN 'ttft-unavailable' WHEN o_totalprice < 50000 THEN 'ttft-fast' WHEN o_totalprice < 200000 THEN 'ttft-medium' ELSE 'ttft-slow' END AS tags FROM orders""")
def x19_run_tags(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("Qwen-Q4_K", "qwen-bf16", "qwen"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    ttft = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") / 100).cast("string"))
    tags = tx.run_tags(name, F.lit("vLLM"), F.lit("s"), F.lit("Measure"), (F.col("o_orderkey") % 6000).cast("string"), F.lit(""), ttft, F.when(F.col("o_orderstatus") == "P", "1").otherwise("0"), F.lit(None).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", tags.alias("tags"))


@query("""SELECT o_orderkey, sha256('{"a":"' || o_orderstatus || '","b":' || o_custkey || ',"c":null}') AS sha FROM orders""")
def x22_canonical_json(spark, sf):
    doc = tx.canonical_json(c=F.lit(None).cast("string"), b=F.col("o_custkey"), a=F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", tx.fingerprint(doc).alias("sha"))


@query("""SELECT run_id, substr(sha256('{"isolation_key":' || CASE WHEN run_id % 2 = 0 THEN '"' || run_id || '"' ELSE 'null' END || ',"model":"m","workload":' || CASE WHEN run_id % 2 = 0 THEN 'null' ELSE '"w"' END || '}'), 1, 16) AS comparison_id, CASE WHEN run_id % 2 = 0 THEN 'workload' ELSE '' END AS missing FROM (SELECT DISTINCT run_id FROM requests)""")
def x23_comparison_identity(spark, sf):
    r = base.requests(spark, sf).select("run_id").distinct()
    i = runs.comparison_identity(F.col("run_id").cast("string"), {"model": F.lit("m"), "workload": F.when(F.col("run_id") % 2 == 1, "w")})
    return r.select("run_id", i["comparison_id"].alias("comparison_id"), F.array_join(i["missing"], ",").alias("missing"))


@query("SELECT conv_id, len(l) AS n, array_to_string(list_transform(list_slice(l, greatest(1, len(l) - 3), len(l)), lambda x: sha256(x)), ',') AS texts FROM (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY conv_id)")
def w8_last_n_messages(spark, sf):
    c = table(spark, sf, "conversations")
    n = c.where("role in ('user', 'assistant') and text is not null").groupBy("conv_id").agg(F.count("*").alias("n"))
    return cv.last_n_messages(c, 4).join(n, "conv_id").select("conv_id", "n", F.array_join(F.transform("messages", lambda m: F.sha2(m["text"], 256)), ",").alias("texts"))


@query("""
, t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 3 <> 0 THEN 'said ' || text ELSE '' END ELSE text END AS text FROM t),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'user' GROUP BY conv_id),
r AS (SELECT t.conv_id, turn, role, text FROM t JOIN l USING (conv_id) WHERE turn <= last
    UNION ALL SELECT conv_id, last + 1, 'assistant', CASE WHEN conv_id % 2 = 0 THEN '["' || conv_id || '"]' ELSE '[]' END FROM l UNION ALL SELECT conv_id, last + 2, 'user', 'Review your answer.' FROM l),
forms AS (SELECT 'replay' AS form, * FROM t UNION ALL SELECT 'closed-loop', * FROM c UNION ALL SELECT 'review', * FROM r)
SELECT a.form, a.conv_id, a.turn, count(*) AS n, CAST(sum(length(b.text)) AS BIGINT) AS chars, sha256(string_agg(b.role || ':' || b.text, chr(10) ORDER BY b.turn)) AS sha256
FROM forms a JOIN forms b ON a.form = b.form AND a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.role = 'user' GROUP BY a.form, a.conv_id, a.turn
""")
def w9_conversation_prompts(spark, sf):
    """Content of every prompt in three forms: with the recorded answers, with the model's own (none for every third turn), and with
    a review of the answer to the last."""
    turns = table(spark, sf, "conversations")
    outputs = turns.where("role = 'assistant' and turn % 3 <> 0").select("conv_id", "turn", F.concat(F.lit("said "), "text").alias("output"))
    answers = turns.select("conv_id").distinct().where("conv_id % 2 = 0").withColumn("answer", F.to_json(F.array(F.col("conv_id").cast("string"))))
    forms = {"replay": turns, "closed-loop": cv.closed_loop(turns, outputs), "review": cv.review_turns(turns, answers, "Review your answer.")}
    both = reduce(DataFrame.unionByName, [t.select(F.lit(form).alias("form"), "conv_id", "turn", "role", "text") for form, t in forms.items()])
    found = cv.prompt_digests(both.select(F.struct("form", "conv_id").alias("key"), "turn", "role", "text"), "key")
    return found.select("key.form", "key.conv_id", "turn", "n", "chars", "sha256")


@query("""
, c AS (SELECT *, length(text) AS n, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations),
m AS (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS pair, role = 'system' OR turn = last AS fixed FROM c WHERE last IS NULL OR turn <= last),
b AS (SELECT conv_id, sum(n) AS base FROM m WHERE fixed GROUP BY conv_id),
p AS (SELECT conv_id, pair, sum(n) AS n FROM m WHERE NOT fixed GROUP BY ALL),
s AS (SELECT p.*, base, sum(n) OVER (PARTITION BY conv_id ORDER BY pair DESC ROWS UNBOUNDED PRECEDING) + base AS total FROM p JOIN b USING (conv_id))
SELECT b.conv_id, count(total) FILTER (total <= 1500) AS kept_pairs, count(total) FILTER (total > 1500) AS dropped_pairs, CAST(any_value(b.base) + coalesce(sum(n) FILTER (total <= 1500), 0) AS BIGINT) AS kept_tokens, any_value(b.base) > 1500 AS over_budget FROM b LEFT JOIN s USING (conv_id) GROUP BY b.conv_id
""")
def w10_trim_to_budget(spark, sf):
    return cv.trim_to_budget(table(spark, sf, "conversations"), 1500, F.length("text"))


@query("SELECT doc_id, count(*) AS spans, CAST(sum(target_len) AS BIGINT) AS total FROM (SELECT doc_id, least(b + 512, n_chars) - CASE WHEN b = 0 THEN 0 ELSE b - 256 + 512 END AS target_len FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(greatest(0, ceil((n_chars - 512) / 256)) AS BIGINT) + 1)) * 256 AS b FROM documents WHERE n_chars > 0)) GROUP BY doc_id")
def w11_sliding_spans(spark, sf):
    spans = cv.sliding_spans(table(spark, sf, "documents").withColumn("n", F.col("n_chars").cast("int")), 512, 256, "doc_id")
    return spans.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum("target_len").cast("long").alias("total"))


@query("SELECT source, round(exp(sum(n_chars * 0.001) / max(doc_id + 1000)), 9) AS perplexity FROM documents GROUP BY source")
def a32_perplexity(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.round(F.exp(F.sum(F.col("n_chars") * 0.001) / F.max(F.col("doc_id") + 1000)), 9).alias("perplexity"))


@query("SELECT c_custkey, '55' || c_custkey AS authorized FROM customer WHERE c_custkey IN (7, 21, 300)")
def f11_allowlist_filter(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lit(None).cast("string").alias("phone"), F.concat(F.lit("+55 "), F.col("c_custkey")).alias("alt"))
    return cv.allowlist_filter(c, ["+55-7", "5521", "55 300"], ["phone", "alt"]).select("c_custkey", "authorized")


def normalised(spark, sf):
    return co.company_normalize(base.companies(spark, sf))


COMPANY_FIELDS = [
    "company_id", "cnpj", "domain", "name", "description", "main_cnae", "segment", "estimated_segment", "business_model", "company_size", "employees", "sales_team_size", "annual_revenue",
    "is_ecommerce", "has_blog", "relationship_rd", "relationship_totvs", "updated_at", "sources_metadata",
]


def text_companies(spark, sf):
    """Companies whose containers are JSON text or Python literals, with empty containers before those that count."""
    part = lambda **fields: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))
    name, odd = F.col("c_name"), F.col("c_custkey") % 2 == 1
    inner = part(
        name=name,
        identity=part(description=F.concat(F.lit("sells to "), F.lower("c_mktsegment")), receita_federal=part(cnae_principal=F.col("c_nationkey"))),
        technologies=F.concat(F.lit("['Spark', None, ' spark ', '"), name, F.lit("']")),
        tags=F.when(odd, "lone").otherwise('["x", null, "", "X"]'),
        mopep=F.when(odd, '{"x": 1}').otherwise("{}"),
        scores=part(mopep=part(businessModel="B2C", companyTags=F.array(F.lit("y")))),
        company_size="{}",
        employees=F.when(odd, 0).otherwise(F.col("c_custkey")),
        businessIntelligence=F.concat(F.lit("{'employees': 7, 'competitors': ['"), name, F.lit("'], 'estimated': {'annualRevenue': 5}}")),
        digital_presence=part(domain_details=part(hasBlog=F.when(odd, "Sim").otherwise("0")), social_media=part(twitterX="", twitter_x="t")),
        crmContext=part(relationshipRd="client"),
        updated_at="",
        enriched_at="2024-01-01",
        sources_metadata='{"a": 1}',
        _warnings=F.array(F.lit("w"), F.lit("W"), name),
    )
    return table(spark, sf, "customer").select("c_custkey", part(data=part(company=inner), domain="outside").alias("record"))


@query("""
SELECT c_custkey, 'export' AS shape, c_name AS company_id, CASE WHEN even THEN c_name END AS cnpj, CASE WHEN odd THEN c_name END AS domain, CASE WHEN odd THEN c_name END AS name, CAST(NULL AS VARCHAR) AS description,
    CAST(NULL AS VARCHAR) AS main_cnae, c_mktsegment AS segment, CASE WHEN odd THEN 'ecommerce' END AS estimated_segment, CASE WHEN even THEN 'B2B ' || lower(c_mktsegment) END AS business_model, CAST(NULL AS VARCHAR) AS company_size,
    CASE WHEN odd THEN CAST(c_custkey AS VARCHAR) END AS employees, CAST(NULL AS VARCHAR) AS sales_team_size, CAST(NULL AS VARCHAR) AS annual_revenue, CASE WHEN odd OR c_acctbal > 5000 THEN true END AS is_ecommerce,
    CAST(NULL AS BOOLEAN) AS has_blog, CAST(NULL AS VARCHAR) AS relationship_rd, CAST(NULL AS VARCHAR) AS relationship_totvs, CAST(NULL AS VARCHAR) AS updated_at, CAST(NULL AS VARCHAR) AS sources_metadata,
    CASE WHEN even THEN n_name || '|SaaS' ELSE '' END AS tags, CASE WHEN odd THEN 'Spark|' || n_name ELSE '' END AS technologies, '' AS competitors, '' AS warnings, CASE WHEN odd THEN 'instagram' ELSE '' END AS channels
FROM (SELECT *, c_custkey % 2 = 0 AS even, c_custkey % 2 = 1 AS odd FROM customer JOIN nation ON c_nationkey = n_nationkey)
UNION ALL
SELECT c_custkey, 'text', c_name, NULL, NULL, c_name, 'sells to ' || lower(c_mktsegment), CASE WHEN c_nationkey <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '0' END, NULL, NULL, CASE WHEN even THEN 'B2C' END, NULL,
    CASE WHEN odd OR c_custkey = 0 THEN '7' ELSE CAST(c_custkey AS VARCHAR) END, NULL, '5', NULL, odd, 'client', NULL, '2024-01-01', '{"a": 1}', CASE WHEN odd THEN 'lone' ELSE 'x|y' END, 'Spark|' || c_name, c_name, 'w|' || c_name, 'twitter_x'
FROM (SELECT *, c_custkey % 2 = 0 AS even, c_custkey % 2 = 1 AS odd FROM customer)
""")
def x29_company_normalize(spark, sf):
    found = normalised(spark, sf).select("c_custkey", F.lit("export").alias("shape"), "company").unionByName(co.company_normalize(text_companies(spark, sf)).select("c_custkey", F.lit("text").alias("shape"), "company"))
    lists = [F.array_join(f"company.{n}", "|").alias(n) for n in ("tags", "technologies", "competitors", "warnings")]
    channels = F.concat_ws("|", *[F.when(F.col(f"company.social_media.{n}").isNotNull(), n) for n in co.CHANNELS]).alias("channels")
    return found.select("c_custkey", "shape", *[f"company.{n}" for n in COMPANY_FIELDS], *lists, channels)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'segment:' || s || '|business-model:b2b-' || s || CASE WHEN c_acctbal > 5000 THEN '|ecommerce:true' ELSE '' END || '|eaas:' || n || '|eaas:saas'
    ELSE 'segment:' || s || '|estimated-segment:ecommerce|ecommerce:true|technology:spark|technology:' || n || '|channel:instagram' END AS tags
FROM (SELECT *, lower(c_mktsegment) AS s, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
""")
def x31_company_tags(spark, sf):
    return normalised(spark, sf).select("c_custkey", F.array_join(co.company_tags(F.col("company")), "|").alias("tags"))


@query("""
SELECT c_name AS company_id, CASE WHEN c_custkey % 2 = 0 THEN 'Empresas (hipotese baseada no modelo B2B)' ELSE 'Nao identificado nos dados EaaS' END AS customer_segments,
    CASE WHEN c_custkey % 2 = 1 THEN 'Website: ' || c_name || '; Instagram' ELSE 'Nao identificado nos dados EaaS' END AS channels,
    CASE WHEN c_custkey % 2 = 1 THEN 'Venda online (hipotese)' ELSE 'Assinaturas recorrentes (hipotese)' || CASE WHEN c_acctbal > 5000 THEN '; Venda online (hipotese)' ELSE '' END END AS revenue_streams,
    CASE WHEN c_custkey % 2 = 1 THEN CAST(0.63 AS DOUBLE) WHEN c_acctbal > 5000 THEN 0.38 ELSE 0.25 END AS evidence_coverage
FROM customer
""")
def x32_baseline_canvas(spark, sf):
    return co.canvas_table(normalised(spark, sf)).select("company_id", "customer_segments", "channels", "revenue_streams", "evidence_coverage")


@query("""
, u(block, unknown) AS (
    SELECT unnest(['customer_segments', 'value_propositions', 'channels', 'customer_relationships', 'revenue_streams', 'key_resources', 'key_activities', 'key_partners', 'cost_structure']),
        unnest([odd, true, NOT odd, NOT odd AND c_acctbal <= 5000, false, NOT odd, false, true, true]) FROM (SELECT *, c_custkey % 2 = 1 AS odd FROM customer))
SELECT block, count(*) FILTER (unknown) AS unknown_rows, round(100 * (1 - avg(CAST(unknown AS INT))), 6) AS coverage_pct FROM u GROUP BY block
""")
def a29_block_coverage(spark, sf):
    return co.block_coverage(co.canvas_table(normalised(spark, sf))).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS ok, CASE c_custkey % 3 WHEN 1 THEN 'missing blocks: cost_structure' WHEN 2 THEN 'not a JSON object' END AS error FROM customer")
def x33_parse_canvas_response(spark, sf):
    blocks = [F.col("c_name").alias(b) for b in co.BLOCKS[:-1]]
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(*blocks, F.col("c_name").alias(co.BLOCKS[-1]))), F.lit("\n```"))).when(F.col("c_custkey") % 3 == 1, F.to_json(F.struct(*blocks))).otherwise("[oops")
    got = co.parse_canvas_response(text)
    return table(spark, sf, "customer").select("c_custkey", got["canvas"].isNotNull().alias("ok"), got["error"].alias("error"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS text FROM customer")
def x25_output_text(spark, sf):
    body = F.to_json(F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content")), F.struct(F.when(F.col("c_custkey") % 2 == 0, "message").otherwise("tool").alias("type"), F.array(F.struct(F.lit("other").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("output_text").alias("type"), F.col("c_name").alias("text"))).alias("content"))).alias("output")))
    return table(spark, sf, "customer").select("c_custkey", tx.output_text(body).alias("text"))


@query("SELECT c_custkey, '--cache-size=' || c_custkey || '|-ctk=q8|--enable-prefix-caching=true' AS flags FROM customer")
def x26_cache_flags(spark, sf):
    argv = F.array(F.lit("serve"), F.lit("--cache-size"), F.col("c_custkey").cast("string"), F.lit("-ctk"), F.lit("q8"), F.lit("--enable-prefix-caching"), F.lit("x"), F.lit("--port"), F.lit("1"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(tx.cache_flags(argv), lambda p: F.concat_ws("=", p["flag"], p["value"])), "|").alias("flags"))


@query("SELECT c_custkey, '--token|[REDACTED]|api-key=[REDACTED]|x[REDACTED]|' || c_name AS argv FROM customer")
def x28_redact(spark, sf):
    argv = F.array(F.lit("--token"), F.col("c_name"), F.lit("api-key=1"), F.lit("xS3"), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(tx.redact_argv(argv, F.lit("S3")), "|").alias("argv"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 2 END AS n FROM supplier")
def x27_gpu_inventory(spark, sf):
    csv = F.concat(F.lit("0, "), F.col("s_name"), F.lit(", GPU-1, 24 GiB, 550\n1, b, GPU-2, 24 GiB, 550"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("\nbroken line"))
    g = tx.gpu_inventory(csv)
    return table(spark, sf, "supplier").select("s_suppkey", F.get(g, F.lit(0))["name"].alias("name"), F.when(g.isNotNull(), F.size(g)).alias("n"))


@query("SELECT 'ev' || event_type AS metric, user_id % 3 AS gpu, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 10 <> 0 GROUP BY ALL")
def s5_explode_range_matrix(spark, sf):
    point = F.array(F.array(F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 == 0, "NaN").otherwise(F.col("value").cast("string"))))
    metric = F.create_map(F.lit("__name__"), F.concat(F.lit("ev"), F.col("event_type")), F.lit("gpu"), (F.col("user_id") % 3).cast("string"))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(metric.alias("metric"), point.alias("values"))).alias("result")).alias("data")))
    out = io.explode_range_matrix(table(spark, sf, "events").select(payload.alias("payload")))
    return out.groupBy("metric", F.col("labels").getItem("gpu").cast("long").alias("gpu")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id AS scrape_id, CASE WHEN event_id % 2 = 0 THEN 'vllm:kv_cache_usage_perc{gpu=\"0\"}' ELSE 'vllm:gpu_cache_usage_perc' END AS series, CAST(event_id % 100 AS DOUBLE) / 100 AS fraction FROM events WHERE event_id % 5 <> 4")
def s6_parse_exposition(spark, sf):
    v = F.when(F.col("event_id") % 5 == 4, F.lit("7")).otherwise(((F.col("event_id") % 100) / 100).cast("string"))
    text = F.concat(F.lit("# HELP x\nvllm:gpu_cache_usage_perc "), v, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('\nvllm:kv_cache_usage_perc{gpu="0"} '), v)).otherwise(""))
    return io.parse_exposition(table(spark, sf, "events").select(F.col("event_id").alias("scrape_id"), text.alias("text")))


@query("SELECT status, count(*) AS n, count(output) AS outputs, min(i) AS first_index FROM (SELECT unnest(['successful', 'errored']) AS status, unnest(['x', NULL]) AS output, 1 AS i FROM customer) GROUP BY status")
def s11_flatten_report(spark, sf):
    row = F.struct(F.col("c_custkey").cast("string").alias("request_id"), F.lit("x").alias("output"), F.lit("e").alias("error"), F.col("c_acctbal").alias("latency"))
    report = F.to_json(F.struct(F.struct(F.array(row).alias("successful"), F.array(row).alias("errored")).alias("requests")))
    out = io.flatten_report(table(spark, sf, "customer").select(F.lit("e").alias("experiment_id"), F.lit("b").alias("block"), report.alias("report")))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count("output").alias("outputs"), F.min("request_index").alias("first_index"))


@query("SELECT parallel, via, sum(ok) AS ok, count(*) AS cells FROM (SELECT event_id % 4 AS parallel, CASE WHEN event_id % 2 = 0 THEN 'gateway' ELSE 'runtime' END AS via, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS ok FROM events WHERE event_id % 7 <> 0) GROUP BY ALL")
def s12_load_cells(spark, sf):
    e = table(spark, sf, "events")
    via = F.when(F.col("event_id") % 2 == 0, "-via-gateway").otherwise("")
    good = F.concat(F.lit("p"), F.col("event_id") % 4, F.lit("-ctx1-cache-off"), via, F.lit("/s1-r1"))
    doc = F.when(F.col("event_id") % 3 == 0, "{}").otherwise(F.to_json(F.struct(F.struct(F.col("user_id").alias("successful_count")).alias("summary"))))
    cells = io.load_cells(e.select(F.when(F.col("event_id") % 7 == 0, "elsewhere").otherwise(good).alias("path"), doc.alias("document")))
    return cells.groupBy(F.col("parallel").cast("long").alias("parallel"), "via").agg(F.sum("ok").alias("ok"), F.count("*").alias("cells"))


@query("SELECT s.experiment_id, s.sample_id, round(s.timestamp_s - i.start_s, 3) AS elapsed_s FROM samples s JOIN (SELECT experiment_id, min(start_s) AS start_s FROM intervals GROUP BY 1) i USING (experiment_id)")
def s13_telemetry_frame(spark, sf):
    starts = base.intervals(spark, sf).groupBy("experiment_id").agg(F.min("start_s").alias("start_s"))
    s = base.samples(spark, sf).withColumn("labels", F.create_map(F.lit("id"), F.col("sample_id").cast("string")))
    out = io.telemetry_frame(s, starts, ["id"])
    return out.select("experiment_id", F.col("label_id").cast("long").alias("sample_id"), F.round("elapsed_s", 3).alias("elapsed_s"))


@query("SELECT CAST(doc_id AS VARCHAR) AS request_id, doc_id % 3 = 0 AS bad FROM documents")
def s2_read_jsonl(spark, sf):
    msg = F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content")))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("request_id"), F.when(F.col("doc_id") % 3 == 0, "huge").otherwise("short").alias("bucket"), F.lit("again").alias("review_instruction"), msg.alias("initial_messages")))
    out = io.workload_rows(table(spark, sf, "documents").select(line.alias("value")))
    return out.select("request_id", (F.size("reasons") > 0).alias("bad"))


@query("SELECT doc_id, '[\"' || lang || '\"]' AS tags FROM documents WHERE lang IS NOT NULL")
def s7_write_table_arrays(spark, sf):
    return io.arrays_as_json(table(spark, sf, "documents").where("lang is not null").select("doc_id", F.array("lang").alias("tags")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256('{\"id\":\"' || doc_id || '\",\"n\":' || n_chars || '}') AS line FROM documents")
def s9_write_messages_jsonl(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("n"))
    return io.message_lines(d, ["id", "n"]).select(F.get_json_object("value", "$.id").alias("id"), F.sha2("value", 256).alias("line"))


RUNS = ", runs AS (SELECT run_id, count(*) AS n, CASE WHEN run_id = 3 THEN 'partial' ELSE 'complete' END AS status, run_id % 2 AS comparison_id, count(DISTINCT runtime) AS runtimes FROM requests GROUP BY run_id)"


def run_table(spark, sf):
    r = base.requests(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("runtime").alias("runtimes"))
    final = F.when(F.col("run_id") == 3, "Partial").otherwise("complete")
    r = r.withColumn("status", runs.run_status(F.lit("complete"), final)).withColumn("comparison_id", F.col("run_id") % 2)
    return runs.integrity(r, {"no_rows": F.col("n") == 0, "odd_run": F.col("run_id") == 5})


@query(RUNS + " SELECT status, count(*) AS n FROM runs GROUP BY status")
def f8_run_status(spark, sf):
    return run_table(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(RUNS + " SELECT count(*) AS discovered, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'complete' AND run_id <> 5) AS included, count(*) FILTER (NOT (status = 'complete' AND run_id <> 5)) AS excluded, count(DISTINCT comparison_id) FILTER (status = 'complete' AND run_id <> 5) AS groups FROM runs")
def s10_dataset_manifest(spark, sf):
    return io.dataset_manifest(run_table(spark, sf))


@query(RUNS + """ SELECT run_id, CASE WHEN status <> 'complete' OR run_id = 5 THEN 'excluded: status or integrity contract failed'
    WHEN run_id = 4 THEN 'run isolated because comparison identity is incomplete: hardware, workload'
    WHEN run_id % 2 = 0 THEN 'eligible control fingerprint; effective runtime argv is unavailable, so launch and cache equivalence for the existing server is not established'
    ELSE 'eligible control fingerprint; runtime, runtime_version, effective argv/environment, cache flags, KV/prefix-cache state and model residency remain treatment dimensions' END AS reason FROM runs""")
def f9_compatibility_reason(spark, sf):
    missing = F.when(F.col("run_id") == 4, F.array(F.lit("hardware"), F.lit("workload"))).otherwise(lb.array_of([]))
    return run_table(spark, sf).select("run_id", runs.compatibility_reason(F.col("included"), missing, F.col("run_id") % 2 == 1).alias("reason"))


@query("""
, k AS (SELECT runtime, scenario, CASE WHEN request_uid % 7 <> 0 THEN CAST(request_uid % 50 AS VARCHAR) END AS h FROM requests),
c AS (SELECT runtime, scenario || '|' || h || '|' || count(*) AS line, substr(sha256(scenario || '|' || h), 1, 2) AS part, count(*) AS n, scenario, h FROM k WHERE h IS NOT NULL GROUP BY runtime, scenario, h),
p AS (SELECT runtime, part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS groups, sum(n) AS n FROM c GROUP BY runtime, part),
r AS (SELECT runtime, CAST(sum(groups) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS requests, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS signature FROM p GROUP BY runtime),
d AS (SELECT count(*) AS differing FROM (SELECT scenario, h FROM c GROUP BY scenario, h HAVING count(*) < (SELECT count(DISTINCT runtime) FROM k) OR min(n) <> max(n)))
SELECT r.*, differing, differing = 0 AS paired FROM r, d
""")
def a30_pairing_signature(spark, sf):
    """Signatures by runtime, and in how many (scenario, hash) the runtimes differ; a seventh of the requests has no hash."""
    r = base.requests(spark, sf).withColumn("request_hash", F.when(F.col("request_uid") % 7 != 0, (F.col("request_uid") % 50).cast("string")))
    return runs.pairing_signature(r).crossJoin(F.broadcast(runs.pairing(r).select("differing", "paired")))  # one row


@query("""
, metric AS (SELECT unnest(['view', 'click', 'absent']) AS metric UNION SELECT DISTINCT event_type FROM events), run AS (SELECT unnest(range(4)) AS run_id), s AS (SELECT user_id % 3 AS run_id, event_type AS metric, CASE WHEN event_type <> 'click' THEN value END AS value FROM events)
SELECT r.run_id, m.metric, count(s.value) AS n, round(avg(s.value), 6) AS mean, CASE WHEN count(s.value) > 0 THEN NULL WHEN count(s.metric) > 0 THEN 'values_are_null' ELSE 'metric_not_collected' END AS missing_reason FROM run r CROSS JOIN metric m LEFT JOIN s ON s.run_id = r.run_id AND s.metric = m.metric GROUP BY ALL
""")
def a16_metric_coverage(spark, sf):
    s = table(spark, sf, "events").select((F.col("user_id") % 3).alias("run_id"), F.col("event_type").alias("metric"), F.when(F.col("event_type") != "click", F.col("value")).alias("value"))
    names = spark.createDataFrame([("view",), ("click",), ("absent",)], "metric string")
    out = runs.metric_coverage(spark.range(4).withColumnRenamed("id", "run_id"), names, s, s.where("false"))
    return out.select("run_id", "metric", "n", F.round("mean", 6).alias("mean"), "missing_reason")


@query("SELECT s.n_nationkey, s.n_name, 'R' || s.n_regionkey AS runtime FROM nation s WHERE n_regionkey <> 2")
def u1_collect_table(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "run_id")
    own = table(spark, sf, "region").select(F.col("r_regionkey").alias("run_id"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("runtime"), (F.col("r_regionkey") != 2).alias("included"))
    out = runs.collect_table([n.where("n_nationkey < 10"), n.where("n_nationkey >= 10").withColumn("runtime", F.lit(None).cast("string"))], own)
    return out.select("n_nationkey", "n_name", "runtime")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def u2_union_splits(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("doc_id % 2 = 0").unionByName(d.where("doc_id % 2 <> 0 or doc_id is null")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT u.run_id, u.scenario FROM (SELECT * FROM (SELECT unnest(range(9)) AS run_id), (SELECT DISTINCT scenario FROM requests)) u ANTI JOIN requests r ON u.run_id = r.run_id AND u.scenario = r.scenario")
def u4_missing_members(spark, sf):
    r = base.requests(spark, sf)
    return sm.missing_members(spark.range(9).withColumnRenamed("id", "run_id"), r, "run_id", sm.catalogue(r, "scenario"), "scenario")


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS run_id FROM events GROUP BY event_type")
def w2_latest_run_per_stage(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type"), F.col("event_id").alias("run_id"), F.col("ts").alias("started"))
    return runs.latest_run(e, ["event_type"]).select("event_type", "run_id")


@query("""
SELECT run_id, sum(CAST(lower(status) <> 'error' AS INT)) AS ok, sum(CAST(status = 'error' AS INT)) AS failed, count(*) AS blocks, CAST(1.0 AS DOUBLE) AS progress,
    CASE WHEN run_id % 3 = 0 THEN count(DISTINCT scenario) * 2 * greatest(1, run_id) WHEN run_id % 3 = 1 THEN greatest(1, run_id) * (1 + count(DISTINCT scenario) FILTER (repetition = 0)) END AS planned
FROM requests GROUP BY run_id
""")
def a33_campaign_progress(spark, sf):
    """Progress, and the blocks that each run plans: generic, by buckets (their counts by scenario), or by none."""
    r = base.requests(spark, sf)
    s = r.select("run_id", (F.lower("status") != "error").cast("int").alias("ok"), (F.col("status") == "error").cast("int").alias("errored"), F.lit(0).alias("incomplete"), F.lit(1).alias("expected"))
    counts = r.groupBy("run_id", "scenario").agg(F.count_if(F.col("repetition") == 0).alias("n")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("scenario", "n"))).alias("buckets"))
    plan = counts.select("run_id", runs.expected_blocks(F.when(F.col("run_id") % 3 > 0, "buckets"), F.map_keys("buckets"), F.col("run_id"), F.when(F.col("run_id") % 3 == 1, F.col("buckets"))).alias("planned"))
    return runs.campaign_progress(s, ["run_id"]).join(plan, "run_id").select("run_id", "ok", "failed", "blocks", "progress", "planned")


@query("SELECT scenario, CASE WHEN m IS NULL THEN 'no data' WHEN m <= 1700 THEN 'pass' ELSE 'fail' END AS ttft, CASE WHEN m > 1700 THEN 'fail' WHEN m IS NULL THEN 'undetermined' ELSE 'pass' END AS overall FROM (SELECT scenario, quantile_cont(ttft_ms, 0.5) AS m FROM requests GROUP BY 1)")
def f13_slo_check(spark, sf):
    r = base.requests(spark, sf)
    m = with_percentiles(r.select("scenario").distinct(), r, ["scenario"], {"ttft": F.col("ttft_ms")}, (0.5,)).withColumnRenamed("ttft_p50", "m")
    ttft, none = runs.slo(F.col("m"), F.lit(1700.0)), runs.slo(F.col("m"), F.lit(None).cast("double"))
    return m.select("scenario", ttft.alias("ttft"), runs.slo_overall([ttft, none]).alias("overall"))


@query("""
, parts AS (SELECT doc_id // 200 AS block, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, coalesce(text, ''))) AS found, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT 'block=' || block AS path, CASE WHEN block % 5 <> 2 THEN found END AS sha256, CASE WHEN block % 5 <> 2 THEN bytes END AS bytes, ['', 'hash differs;size differs;external differs', 'missing file', 'not in external list', ''][block % 5 + 1] AS reasons FROM parts
""")
def j14_checksum_audit(spark, sf):
    """Documents written as compressed files of 200 ids, hashed where they lie, held to an inventory that tells another hash and
    size for a fifth of them and a file more for another fifth, and to a list that lacks a fifth."""
    folder = io.shared_folder(spark)
    d = table(spark, sf, "documents").where("doc_id is not null").select(F.expr("doc_id div 200").alias("block"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    d.repartition("block").sortWithinPartitions("block", "doc_id", "value").select("block", "value").write.partitionBy("block").option("compression", "gzip").text(f"{folder}/files")
    hashes = io.hash_files(spark, f"{folder}/files", contents=True).select(F.element_at(F.split("path", "/"), -2).alias("path"), "sha256", "bytes")
    hashes.write.parquet(f"{folder}/hashes")  # a row a file, so that each is read once
    found = spark.read.schema(hashes.schema).parquet(f"{folder}/hashes")
    kind = F.substring_index("path", "=", -1).cast("long") % 5
    there = found.where(kind != 2)
    claims = found.withColumns({"sha256": F.when(kind == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")), "bytes": F.when(kind == 1, F.col("bytes") + 1).otherwise(F.col("bytes"))})
    reasons = runs.checksum_audit(there, claims, found.where(kind != 3).select("path", "sha256"))
    told = claims.select("path").join(there, "path", "left").join(reasons, "path", "left")
    return told.select("path", "sha256", "bytes", F.coalesce(F.array_join("reasons", ";"), F.lit("")).alias("reasons"))


@query("SELECT id, site IS NOT NULL AS private FROM (SELECT CAST(doc_id AS VARCHAR) AS id, source AS site FROM documents)")
def s8_identity_and_shareable(spark, sf):
    g = base.examples(spark, sf).select("id", F.col("source").alias("site"), F.col("text").alias("business_model"), "tags", F.lit("test").alias("split"))
    private, public = io.identity_and_shareable(g)
    return public.select("id").join(private, "id", "left").select("id", F.col("site").isNotNull().alias("private"))


#: An object of the answers that a31 checks.
ANSWER = {
    "type": "object",
    "required": ["v", "items"],
    "properties": {"v": {"type": "string", "minLength": 1}, "score": {"type": "number", "minimum": 0, "maximum": 1}, "items": {"type": "array", "items": {"enum": ["a", "b"]}, "maxItems": 3}},
    "additionalProperties": False,
}


@query("""
SELECT agent, reason, count(*) AS n FROM (
    SELECT user_id % 5 AS agent, CASE event_id % 12 WHEN 0 THEN 'missing text' WHEN 1 THEN 'invalid JSON' WHEN 2 THEN '$.v: not string' WHEN 3 THEN '$.v: not string' WHEN 4 THEN '$.items: missing' WHEN 5 THEN '$.items[1]: not one of the values'
        WHEN 6 THEN '$.score: breaks maximum' WHEN 7 THEN '$.more: not allowed' WHEN 8 THEN 'invalid JSON' WHEN 9 THEN '$: not object' WHEN 10 THEN '$.items: breaks maxItems' END AS reason
    FROM events) WHERE reason IS NOT NULL GROUP BY ALL
""")
def a31_schema_failures(spark, sf):
    """Answers that each break one rule, and a twelfth that breaks none: a number and an object for a text, a value that isn't among
    those allowed, one too large, an unknown field, text behind the object."""
    v = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    obj = lambda *parts: F.concat(F.lit("{"), *parts, F.lit("}"))
    whole = obj(F.lit('"v":'), v, F.lit(',"items":["a","b"],"score":1'))
    forms = [
        F.lit(None), F.lit("{oops"), F.concat(F.lit('{"items":[],"v":'), F.col("value").cast("string"), F.lit("}")), F.lit('{"v":{"a":1},"items":[]}'), obj(F.lit('"v":'), v), obj(F.lit('"v":'), v, F.lit(',"items":["a",5]')),
        obj(F.lit('"v":'), v, F.lit(',"items":[],"score":1.5')), obj(F.lit('"v":'), v, F.lit(',"items":[],"more":1')), F.concat(whole, F.lit(" thanks")), F.concat(F.lit("["), whole, F.lit("]")), obj(F.lit('"v":'), v, F.lit(',"items":["a","a","b","b"]')), whole,
    ]
    body = F.element_at(F.array(*[f.cast("string") for f in forms]), (F.col("event_id") % 12 + 1).cast("int"))
    reason = js.schema_failure(body, ANSWER)
    return table(spark, sf, "events").select((F.col("user_id") % 5).alias("agent"), reason.alias("reason")).where("reason is not null").groupBy("agent", "reason").agg(F.count("*").alias("n"))

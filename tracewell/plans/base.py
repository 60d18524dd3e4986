"""Tables of the shapes that the operators take, as views over the given tables, and the same in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{VIEWS}\n{sql}"
        return f

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Request intervals: a user's sign-ups, as long as their value says."""
    e = events(spark, sf).where("event_type = 'signup'")
    return e.select(
        F.col("user_id").alias("experiment_id"),
        F.col("event_id").alias("request_uid"),
        F.col("t").alias("start_s"),
        F.expr("t + value * 600").alias("end_s"),
        F.expr("CASE WHEN event_id % 10 <> 0 THEN t + value * 60 END").alias("first_s"),
        F.expr("CASE WHEN event_id % 13 <> 0 THEN t + value * 540 END").alias("last_s"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where("event_type <> 'signup'")
    return e.select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("sample_id"), F.col("t").alias("timestamp_s"), F.col("event_type").alias("metric"), "value", F.expr("CASE WHEN event_type = 'purchase' THEN 'counter' ELSE 'gauge' END").alias("kind"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request log: orders with their customers' segments as scenarios."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("request_uid"),
        F.expr("o_custkey % 7").cast("long").alias("run_id"),
        F.col("o_orderpriority").alias("runtime"),
        F.col("c_mktsegment").alias("scenario"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'warmup' ELSE 'measure' END").alias("benchmark_phase"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Successful' WHEN 'O' THEN 'ok' ELSE 'error' END").alias("status"),
        F.expr("o_orderkey % 3").cast("long").alias("repetition"),
        F.expr("CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 100 END").alias("ttft_ms"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 1000 END").alias("tokens_per_second"),
        F.expr("o_totalprice / 10000").alias("request_latency"),
        F.expr("o_orderkey % 20000").cast("long").alias("prompt_tokens"),
        F.expr("o_orderkey % 300").cast("long").alias("output_tokens"),
        F.expr("unix_micros(cast(o_orderdate as timestamp)) / 1e6 + o_orderkey % 86400").alias("start_s"),
        F.expr("unix_micros(cast(o_orderdate as timestamp)) / 1e6 + o_orderkey % 86400 + o_totalprice / 10").alias("end_s"),
    )


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Tag sets of a user's day: all event types, and those of events above two thresholds."""
    e = table(spark, sf, "events").withColumn("day", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    above = lambda v: F.array_sort(F.collect_set(F.when(F.col("value") > v, F.col("event_type"))))
    g = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("event_type")).alias("expected"), above(20).alias("generated"), above(10).alias("third"), F.sum("value").alias("latency_ms"), F.min("event_id").alias("pos"))
    return g.withColumn("example_id", F.concat_ws("-", F.col("user_id").cast("string"), "day")).withColumn("model", F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string"))).withColumn("split", F.element_at(F.array(*map(F.lit, ("test", "train", "validation"))), (F.col("user_id") % 3 + 1).cast("int")))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string")).withColumn("text_hash", F.sha2("text", 256))
    return d.withColumn("tags", F.array_sort(F.array_distinct(F.array("lang", F.expr("CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END"), F.expr("concat('s', doc_id % 5)"))))).withColumn("words", F.size(F.filter(F.split("text", r"[\t\n\x0B\f\r ]+"), lambda w: w != "")))


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """JSON records of companies in two shapes, made of customers and their nations."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    flat = F.to_json(F.struct(F.col("c_name").alias("cnpj"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.concat(F.lit("B2B "), F.lower("c_mktsegment")).alias("business_model"), F.array("n_name", F.lower("n_name"), F.lit("SaaS")).alias("tags"), F.when(F.col("c_acctbal") > 5000, "sim").alias("is_ecommerce"))).alias("payload")))
    nested = F.to_json(F.struct(F.struct(F.struct(F.struct(F.col("c_name").alias("name")).alias("identity"), F.col("c_name").alias("domain"), F.struct(F.struct(F.lit("ecommerce").alias("segment"), F.col("c_custkey").alias("employees")).alias("estimated"), F.col("c_mktsegment").alias("segment")).alias("businessIntelligence"), F.struct(F.struct(F.array(F.lit("Spark"), F.col("n_name")).alias("technologies")).alias("domainDetails"), F.struct(F.lit("https://x").alias("instagram")).alias("socialMedia")).alias("digitalPresence")).alias("company")).alias("data")))
    return c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "n_name", F.when(F.col("c_custkey") % 2 == 0, flat).otherwise(nested).alias("record"))


VIEWS = r"""
WITH ev AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events),
intervals AS (
    SELECT user_id AS experiment_id, event_id AS request_uid, t AS start_s, t + value * 600 AS end_s,
        CASE WHEN event_id % 10 <> 0 THEN t + value * 60 END AS first_s, CASE WHEN event_id % 13 <> 0 THEN t + value * 540 END AS last_s
    FROM ev WHERE event_type = 'signup'),
samples AS (
    SELECT user_id AS experiment_id, event_id AS sample_id, t AS timestamp_s, event_type AS metric, value,
        CASE WHEN event_type = 'purchase' THEN 'counter' ELSE 'gauge' END AS kind
    FROM ev WHERE event_type <> 'signup'),
hits AS (
    SELECT s.sample_id, r.*, row_number() OVER (PARTITION BY s.sample_id ORDER BY r.start_s, r.request_uid) AS k
    FROM samples s JOIN intervals r ON s.experiment_id = r.experiment_id AND s.timestamp_s >= r.start_s AND s.timestamp_s <= r.end_s),
matched AS (
    SELECT s.*, h.request_uid, h.start_s AS request_start_s,
        CASE WHEN h.request_uid IS NULL THEN 'outside_request' WHEN h.first_s IS NULL THEN 'request_without_first_content' WHEN s.timestamp_s < h.first_s THEN 'prefill_observed'
            WHEN h.last_s IS NULL OR s.timestamp_s <= h.last_s THEN 'decode_observed' ELSE 'response_close' END AS observed_phase
    FROM samples s LEFT JOIN hits h ON s.sample_id = h.sample_id AND h.k = 1),
requests AS (
    SELECT o_orderkey AS request_uid, o_custkey % 7 AS run_id, o_orderpriority AS runtime, c_mktsegment AS scenario,
        CASE WHEN o_orderkey % 5 = 0 THEN 'warmup' ELSE 'measure' END AS benchmark_phase,
        CASE o_orderstatus WHEN 'F' THEN 'Successful' WHEN 'O' THEN 'ok' ELSE 'error' END AS status, o_orderkey % 3 AS repetition,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 100 END AS ttft_ms, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 1000 END AS tokens_per_second,
        o_totalprice / 10000 AS request_latency, o_orderkey % 20000 AS prompt_tokens, o_orderkey % 300 AS output_tokens,
        epoch_us(o_orderdate) / 1e6 + o_orderkey % 86400 AS start_s, epoch_us(o_orderdate) / 1e6 + o_orderkey % 86400 + o_totalprice / 10 AS end_s
    FROM orders JOIN customer ON o_custkey = c_custkey),
tagged AS (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list_distinct(list(event_type))) AS expected,
        coalesce(list_sort(list_distinct(list(event_type) FILTER (value > 20))), []) AS generated, coalesce(list_sort(list_distinct(list(event_type) FILTER (value > 10))), []) AS third,
        sum(value) AS latency_ms, min(event_id) AS pos, user_id || '-' || strftime(ts, '%Y-%m-%d') AS example_id, 'm' || (user_id % 4) AS model, ['test', 'train', 'validation'][user_id % 3 + 1] AS split
    FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')),
scored AS (
    SELECT *, len(list_intersect(expected, generated)) AS tp,
        CASE WHEN len(generated) = 0 THEN 0 ELSE len(list_intersect(expected, generated)) / len(generated) END AS "precision",
        CASE WHEN len(expected) = 0 THEN 0 ELSE len(list_intersect(expected, generated)) / len(expected) END AS recall,
        CASE WHEN len(expected) + len(generated) = 0 THEN 0 ELSE 2 * len(list_intersect(expected, generated)) / (len(expected) + len(generated)) END AS f1,
        expected = generated AS exact_match, user_id % 9 <> 0 AS parse_ok, user_id % 17 <> 0 AS request_ok
    FROM tagged),
marks AS (
    SELECT example_id, model, split, l AS label, CAST(list_contains(expected, l) AND list_contains(generated, l) AS INT) AS tp, CAST(NOT list_contains(expected, l) AS INT) AS fp, CAST(NOT list_contains(generated, l) AS INT) AS fn
    FROM (SELECT *, unnest(list_distinct(list_concat(expected, generated))) AS l FROM tagged)),
examples AS (
    SELECT *, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS text_hash, list_sort(list_distinct([lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END, 's' || (doc_id % 5)])) AS tags,
        len(list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda w: w <> '')) AS words
    FROM documents)
"""

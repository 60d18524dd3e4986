"""Gates before a comparison: integrity of runs, comparability of runtimes, answers for a replay, responses by schema.

Each gives the reasons against, and none means passed. Rules are frames of (key, reason) put together and collected by key:
a fixed number of texts for each run, however large its tables are."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_scalar

#: The tables that a run must have, and their least columns.
REQUIRED = {
    "all-requests": ["experiment_id", "request_uid", "benchmark_phase", "status"],
    "request-events": ["experiment_id", "request_uid", "event", "timestamp_s"],
    "prometheus-samples": ["experiment_id", "metric", "value", "timestamp_s"],
    "telemetry-by-request": ["experiment_id", "request_uid", "metric", "value"],
    "request-phase-metrics": ["experiment_id", "request_uid", "metric", "observed_phase"],
}
INVENTORY = "array<struct<path:string,sha256:string,bytes:long>>"


def reasons_by(key: str, found: list[DataFrame]) -> DataFrame:
    """key, reasons array<string> in ascending order, of keys that have any."""
    return reduce(DataFrame.union, found).groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, reason of every rule that holds for a row; a rule that is null doesn't hold. {name} in a reason is a column."""
    part = lambda x: F.coalesce(F.col(x[1:-1]).cast("string"), F.lit("")) if x.startswith("{") else F.lit(x)
    texts = [F.when(bad, F.concat(*map(part, filter(None, re.split(r"(\{\w+\})", text))))) for text, bad in rules.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*texts))).alias("reason"))


def run_integrity(manifests: DataFrame, files: DataFrame, tables: DataFrame, listed: DataFrame, required: dict = REQUIRED) -> DataFrame:
    """run, reasons of the runs that break a rule.

    manifests: run, kind ('dataset-manifest', the declared one, or 'manifest', the final one), document, error. files: run,
    path, sha256, bytes of what lies in the run's folder. tables: run, name, path, columns array<string>, rows, foreign (rows
    of another experiment_id, or of none), measured (successful rows of the measured phase; of all-requests alone).
    listed: run, path, sha256 of the run's checksum list. The inventory is the declared document's `files`.

    Both manifests must be there, be JSON objects and name the run; every inventoried path must lie in the run's folder, be
    named once, exist, and have the hash and size that are declared; required tables must be inventoried where they lie, have
    their columns and rows, and rows of their run alone; one measured row must have succeeded; and the checksum list must
    have the inventory's hashes. A run without any manifest isn't known here."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("document")))
    runs = manifests.groupBy("run").agg(of("dataset-manifest").alias("declared"), of("manifest").alias("final"), F.count("error").alias("errors"))
    name = lambda d: first_scalar(F.col(d), "$.experiment_id", "$.run_id")
    inventory = F.from_json(F.get_json_object("declared", "$.files"), INVENTORY)
    runs = runs.select("*", name("declared").alias("declared_id"), name("final").alias("final_id"), inventory.alias("inventory"))
    manifest_rules = {
        "declared manifest is missing": F.col("declared").isNull(),
        "final manifest is missing": F.col("final").isNull(),
        "manifest is no JSON": F.col("errors") > 0,
        "declared manifest names no run": F.col("declared").isNotNull() & F.col("declared_id").isNull(),
        "final manifest names no run": F.col("final").isNotNull() & F.col("final_id").isNull(),
        "declared manifest names run {declared_id}": F.col("declared_id") != F.col("run"),
        "final manifest names run {final_id}": F.col("final_id") != F.col("run"),
        "declared manifest has no list of files": F.col("declared").isNotNull() & F.col("inventory").isNull(),
    }
    item = runs.select("run", F.explode("inventory").alias("i")).select("run", "i.path", F.lower("i.sha256").alias("want"), F.col("i.bytes").alias("want_bytes"))
    item = item.groupBy("run", "path").agg(F.min("want").alias("want"), F.min("want_bytes").alias("want_bytes"), F.count("*").alias("times"))
    own = files.select("run", "path", F.lower("sha256").alias("found"), "bytes").withColumn("there", F.lit(True))
    told = listed.groupBy("run", "path").agg(F.min(F.lower("sha256")).alias("told"))
    audit = item.join(own, ["run", "path"], "left").join(told, ["run", "path"], "left")
    valid = F.coalesce(F.col("want").rlike("^[0-9a-f]{64}$"), F.lit(False))
    outside = F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")
    file_rules = {
        "a file has no path": F.coalesce(F.trim("path"), F.lit("")) == "",
        "{path} lies outside the run": outside,
        "{path} is named more than once": F.col("times") > 1,
        "{path} is missing": ~outside & F.col("there").isNull(),
        "{path} has no valid hash": ~valid,
        "{path} has another hash": valid & (F.col("want") != F.col("found")),
        "{path} has no size": F.col("want_bytes").isNull() | (F.col("want_bytes") < 0),
        "{path} has another size": F.col("want_bytes") != F.col("bytes"),
        "{path} is not in the checksum list": F.col("told").isNull(),
        "{path} has another hash in the checksum list": valid & (F.col("told") != F.col("want")),
    }
    need = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, c)).alias("needs")) for n, c in required.items()])
    grid = runs.select("run", F.explode(need).alias("t")).select("run", "t.name", "t.needs")
    state = grid.join(tables, ["run", "name"], "left").join(item.select("run", "path", F.lit(True).alias("inventoried")), ["run", "path"], "left")
    state = state.withColumn("lacks", F.array_join(F.array_except("needs", "columns"), ", "))
    table_rules = {
        "table {name} is missing": F.col("path").isNull(),
        "table {name} is not inventoried": F.col("path").isNotNull() & F.col("inventoried").isNull(),
        "table {name} lacks columns {lacks}": F.col("lacks") != "",
        "table {name} is empty": F.col("rows") == 0,
        "table {name} has rows of another run": F.col("foreign") > 0,
        "no measured request succeeded": (F.col("name") == "all-requests") & (F.coalesce("measured", F.lit(0)) == 0),
    }
    return reasons_by("run", [broken(runs, "run", manifest_rules), broken(audit, "run", file_rules), broken(state, "run", table_rules)])


def comparability(runs: DataFrame, groups: DataFrame, pairs: DataFrame, expected: list[str], by: str = "campaign") -> DataFrame:
    """by, ready runs, comparable, pairing_verified and reasons of every campaign.

    runs: by, run_id, runtime, included, comparison_id, identity_missing array<string>. groups: comparison_id, n_runtimes,
    cross_runtime_ready. pairs: run_id, signature of its measured requests (none, or null, where their hashes aren't known).

    Each expected runtime must have exactly one included run, run ids must differ, all must have one comparison_id and a
    complete identity, the group must hold as many runtimes as are expected and be ready, and signatures must be equal."""
    ready = runs.where("included")
    names = F.array(*map(F.lit, expected))
    seen = runs.select(by).distinct().select(by, F.explode(names).alias("runtime")).join(ready.groupBy(by, "runtime").agg(F.count("*").alias("n")), [by, "runtime"], "left")
    runtime_rules = {"no included run of {runtime}": F.col("n").isNull(), "{n} included runs of {runtime}": F.col("n") > 1}
    told = ready.where(F.col("runtime").isin(expected)).join(pairs.select("run_id", "signature"), "run_id", "left").join(groups.select("comparison_id", "n_runtimes", "cross_runtime_ready"), "comparison_id", "left")
    facts = told.groupBy(by).agg(
        F.count("*").alias("ready"), F.count_distinct("run_id").alias("ids"), F.count_distinct("comparison_id").alias("comparisons"), F.count_if(F.col("comparison_id").isNull()).alias("unknown"),
        F.count_if(F.size("identity_missing") > 0).alias("incomplete"), F.min(F.coalesce("n_runtimes", F.lit(0))).alias("group_runtimes"), F.bool_and(F.coalesce("cross_runtime_ready", F.lit(False))).alias("group_ready"),
        F.count("signature").alias("signed"), F.count_distinct("signature").alias("signatures"),
    )
    paired = (F.col("signed") == F.col("ready")) & (F.col("signatures") == 1) & (F.col("ready") >= len(expected))
    group_rules = {
        "run ids repeat": F.col("ids") < F.col("ready"),
        "runs have {comparisons} comparison ids": (F.col("comparisons") != 1) | (F.col("unknown") > 0),
        "{incomplete} runs have an incomplete identity": F.col("incomplete") > 0,
        "the group holds {group_runtimes} runtimes": (F.col("comparisons") == 1) & (F.col("group_runtimes") < len(expected)),
        "the group is not ready": (F.col("comparisons") == 1) & ~F.col("group_ready"),
        "pairing is not proven": ~paired,
    }
    reasons = reasons_by(by, [broken(seen, by, runtime_rules), broken(facts, by, group_rules)])
    whole = runs.select(by).distinct().join(facts.select(by, "ready", paired.alias("pairing_verified")), by, "left").join(reasons, by, "left")
    none = F.coalesce("reasons", F.array().cast("array<string>"))
    return whole.select(by, F.coalesce("ready", F.lit(0)).alias("ready"), (F.size(none) == 0).alias("comparable"), F.coalesce("pairing_verified", F.lit(False)).alias("pairing_verified"), none.alias("reasons"))


def replay_map(responses: DataFrame, manifests: DataFrame, runtime: str, key: str = "source") -> tuple[DataFrame, DataFrame]:
    """(answers: key, request_id, answer; reasons: key, reasons). Answers are those of first turns that aren't blank, of sources
    that break no rule.

    responses: key, request_id, turn_index, answer. manifests: key, source_runtime, responses_sha256 (as declared), sha256
    (of the responses as they are). A source needs a manifest, of the named runtime, whose hash is that of the responses, at
    least one answer, and no request that has two."""
    said = responses.where((F.col("turn_index") == 1) & (F.coalesce(F.trim("answer"), F.lit("")) != ""))
    twice = said.groupBy(key, "request_id").agg(F.count("*").alias("n")).where("n > 1").groupBy(key).agg(F.count("*").alias("twice"))
    some = said.groupBy(key).agg(F.count("*").alias("answers"))
    known = responses.select(key).union(manifests.select(key)).distinct()
    state = known.join(manifests.withColumn("told", F.lit(True)), key, "left").join(twice, key, "left").join(some, key, "left")
    rules = {
        "manifest is missing": F.col("told").isNull(),
        "hash differs from the manifest": F.col("told") & ~F.col("responses_sha256").eqNullSafe(F.col("sha256")),
        "source runtime is not the canonical one": F.col("told") & ~F.col("source_runtime").eqNullSafe(F.lit(runtime)),
        "{twice} requests have two answers": F.col("twice") > 0,
        "no answer": F.col("answers").isNull(),
    }
    reasons = reasons_by(key, [broken(state, key, rules)])
    return said.join(reasons, key, "left_anti").select(key, "request_id", "answer"), reasons


def stream_text(body: Column) -> Column:
    """Text of a streamed response: the deltas of its data lines one after another, up to [DONE]; null if there are none."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:"))
    data = F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    delta = F.transform(F.filter(data, lambda x: x != "[DONE]"), lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit("")))
    return F.when(F.size(lines) > 0, F.array_join(delta, ""))

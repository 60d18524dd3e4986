"""Benchmark runs: status, integrity, comparability, distributions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.text import cache_flags, canonical_json, fingerprint, first_scalar, model_attributes
from .percentiles import percentiles, with_percentiles

#: The sets differ by place.
OK_STRICT = ["successful", "success", "ok"]
OK_WIDE = [*OK_STRICT, "complete", "completed"]
FAILED = ["errored", "error", "failed", "incomplete", "timeout"]
METRICS = {
    "ttft_ms": [("time_to_first_token_ms", 1.0), ("ttft_ms", 1.0), ("request_first_token_latency_milliseconds", 1.0), ("time_to_first_token_seconds", 1000.0)],
    "decode_tokens_s": [("decode_tokens_s", 1.0), ("decode_tokens_per_second", 1.0), ("tokens_per_second", 1.0)],
    "effective_tokens_s": [("effective_tokens_s", 1.0), ("end_to_end_tokens_per_second", 1.0)],
    "e2e_seconds": [("end_to_end_latency_seconds", 1.0), ("e2e_seconds", 1.0), ("request_latency", 1.0)],
    "generation_seconds": [("generation_time_seconds", 1.0), ("generation_seconds", 1.0)],
    "prompt_tokens": [("prompt_tokens", 1.0), ("input_tokens", 1.0)],
    "completion_tokens": [("completion_tokens", 1.0), ("output_tokens", 1.0)],
}


def status_is(kind: list[str]) -> Column:
    return F.coalesce(F.lower("status").isin(kind), F.lit(False))


def measured(df: DataFrame) -> DataFrame:
    return df.where((F.col("benchmark_phase") == "measure") & status_is(OK_STRICT))


def status_counts() -> list[Column]:
    ok, bad = status_is(OK_WIDE), status_is(FAILED)
    return [F.count("*").alias("requests"), F.count_if(ok).alias("ok"), F.count_if(bad).alias("failed"), F.count_if(~ok & ~bad).alias("unknown")]


def run_status(declared: Column, final: Column) -> Column:
    d, f = F.lower(F.trim(declared)), F.lower(F.trim(final))
    return F.coalesce(F.when(f != "complete", f), F.when(d != "complete", d), f, d, F.lit("unknown"))


def experiment_summary(requests: DataFrame, keys: list[str], metrics: dict = METRICS) -> DataFrame:
    """Counts by status and, over successful rows, n, mean, p50, p95, min and max of each metric by keys. A metric's source
    is the first of its columns that has any value in the group, and is named."""
    ok, aggregates, out = status_is(OK_WIDE), status_counts(), []
    for name, sources in metrics.items():
        known = [(c, f) for c, f in sources if c in requests.columns]
        for k, (c, f) in enumerate(known):
            v = F.when(ok, finite(F.col(c)) * f)
            aggregates.append(F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.min(v).alias("min"), F.max(v).alias("max"), F.lit(c).alias("source")).alias(f"__{name}_{k}"))
        pick = F.coalesce(*[F.when(F.col(f"__{name}_{k}.n") > 0, F.col(f"__{name}_{k}")) for k in range(len(known))]) if known else None
        for part, value in (("source", "source"), ("n", "n"), ("mean", "mean"), ("p50", "p"), ("p95", "p"), ("min", "min"), ("max", "max")):
            got = F.lit(None) if pick is None else pick[value][0 if part == "p50" else 1] if value == "p" else pick[value]
            out.append((F.coalesce(got, F.lit(0)) if part == "n" else got).alias(f"{name}_{part}"))
    facts = requests.groupBy(*keys).agg(*aggregates)
    return facts.select(*keys, "requests", "ok", "failed", "unknown", *out)


QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, std, min, p25, p50, p75, p90, p95, p99, max of a column's finite values by group."""
    v = finite(F.col(value))
    facts = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    got = with_percentiles(facts, df, keys, {"v": F.col(value)}, QUANTILES)
    return got.select(*keys, F.col("v_n").alias("n"), "mean", "std", "min", *[F.col(f"v_p{round(100 * p)}").alias(f"p{round(100 * p)}") for p in QUANTILES], "max")


def comparison_identity(run: Column, controls: dict[str, Column]) -> Column:
    """struct<comparison_id, missing>: a digest of the controls alone, never of the runtime; what is unknown isolates the run."""
    missing = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k)) for k, v in sorted(controls.items())]))
    alone = F.when(F.size(missing) > 0, run)
    doc = canonical_json(**{k: v.cast("string") for k, v in controls.items()}, isolation_key=alone)
    return F.struct(fingerprint(doc, 16).alias("comparison_id"), missing.alias("missing"))


def comparison_groups(runs: DataFrame) -> DataFrame:
    names = lambda c: F.to_json(F.sort_array(F.collect_set(c)))
    got = runs.groupBy("comparison_id").agg(F.count("*").alias("runs"), names("runtime").alias("runtimes"), names("model").alias("models"), F.count_distinct("runtime").alias("n_runtimes"))
    return got.withColumn("cross_runtime_ready", F.col("n_runtimes") >= 2)


def compatibility_reason(included: Column, missing: Column, argv_known: Column) -> Column:
    # Fixed values.
    return (
        F.when(~included, "excluded: status or integrity contract failed")
        .when(F.size(missing) > 0, F.concat(F.lit("run isolated because comparison identity is incomplete: "), F.array_join(missing, ", ")))
        .when(~argv_known, "eligible control fingerprint; effective runtime argv is unavailable, so launch and cache equivalence for the existing server is not established")
        .otherwise("eligible control fingerprint; runtime, runtime_version, effective argv/environment, cache flags, KV/prefix-cache state and model residency remain treatment dimensions")
    )


def integrity(runs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """runs with reasons (codes of the rules that fail) and included."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), code) for code, bad in rules.items()]))
    return runs.withColumn("reasons", reasons).withColumn("included", (F.size("reasons") == 0) & (F.col("status") == "complete"))


#: Places of a run's controls in its manifests; what isn't a scalar there counts as its JSON text.
CONTROLS = {
    "model": ("$.model_identity.sha256", "$.model_sha256"),
    "tokenizer": ("$.tokenizer_identity.sha256", "$.tokenizer_sha256"),
    "context_window": ("$.config.context_window", "$.context_window"),
    "generation": ("$.config.generation_parameters", "$.generation_parameters"),
    "workload": ("$.workload.sha256", "$.workload_sha256"),
    "hardware": ("$.hardware", "$.environment.hardware"),
}
DESCRIPTION = {
    "runtime": ("$.runtime", "$.config.runtime"),
    "runtime_version": ("$.config.runtime_version", "$.runtime_version"),
    "model_name": ("$.model", "$.config.model"),
    "model_revision": ("$.model_identity.resolved_revision", "$.model_revision", "$.revision", "$.config.model_revision"),
    "started_utc": ("$.started_utc", "$.started_at", "$.metadata.started_utc"),
    "ended_utc": ("$.ended_utc", "$.ended_at", "$.metadata.ended_utc"),
}


def run_inventory(manifests: DataFrame, found: DataFrame, controls: dict = CONTROLS, description: dict = DESCRIPTION) -> DataFrame:
    """One row for each discovered run, included or not.

    manifests: run, kind ('dataset-manifest', the declared one, or 'manifest', the final one), document, error. found: run,
    reasons array<string>, from the integrity rules; a run without a row there has none. Scalars come from the declared
    document, then the final one. A broken or missing manifest is a reason of its own. Columns: run, status, included,
    integrity_ok, reasons, comparison_id, identity_missing, the controls, the description, effective argv with its cache
    flags and digests as JSON, both documents' digests, compatibility_reason, exclusion_reasons (null if included)."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    runs = manifests.groupBy("run").agg(of("dataset-manifest", "document").alias("declared"), of("manifest", "document").alias("final"), F.count("error").alias("broken"))
    runs = runs.join(found.select("run", F.col("reasons").alias("__found")), "run", "left")

    def value(paths: tuple[str, ...], scalar: bool) -> Column:
        read = first_scalar if scalar else lambda d, *ps: F.coalesce(*[F.get_json_object(d, p) for p in ps])
        return F.coalesce(read(F.col("declared"), *paths), read(F.col("final"), *paths))

    runs = runs.select("*", *[value(p, False).alias(n) for n, p in controls.items()], *[value(p, True).alias(n) for n, p in description.items()], F.from_json(value(("$.runtime_process.argv", "$.argv"), False), "array<string>").alias("argv"))
    runs = runs.withColumn("status", run_status(first_scalar(F.col("declared"), "$.status", "$.dataset.status"), first_scalar(F.col("final"), "$.status", "$.run.status")))
    rules = {"declared manifest is missing": F.col("declared").isNull(), "final manifest is missing": F.col("final").isNull(), "manifest is no JSON": F.col("broken") > 0}
    own = F.array_compact(F.array(*[F.when(bad, code) for code, bad in rules.items()]))
    runs = runs.withColumn("reasons", F.concat(own, F.coalesce("__found", F.lit([]).cast("array<string>"))))
    runs = runs.withColumn("__id", comparison_identity(F.col("run"), {n: F.col(n) for n in controls}))
    included = (F.size("reasons") == 0) & (F.col("status") == "complete")
    why = F.concat(F.when(F.col("status") != "complete", F.array(F.concat(F.lit("status="), F.col("status")))).otherwise(F.array().cast("array<string>")), F.col("reasons"))
    return runs.select(
        "run", "status", included.alias("included"), (F.size("reasons") == 0).alias("integrity_ok"), "reasons",
        F.col("__id.comparison_id").alias("comparison_id"), F.col("__id.missing").alias("identity_missing"), *controls, *description,
        F.to_json("argv").alias("argv_json"), F.sha2(F.to_json("argv"), 256).alias("argv_sha256"), F.to_json(cache_flags(F.col("argv"))).alias("cache_flags_json"),
        F.sha2("declared", 256).alias("declared_sha256"), F.sha2("final", 256).alias("final_sha256"),
        compatibility_reason(included, F.col("__id.missing"), F.col("argv").isNotNull()).alias("compatibility_reason"), F.when(~included, F.to_json(why)).alias("exclusion_reasons"),
    )


def collect_table(tables: list[DataFrame], runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Union by name of the same table of several runs, of included runs alone; what a row lacks its run fills in."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    shared = [c for c in ("experiment_id", "runtime", "model", "run_status") if c in runs.columns]
    own = runs.where("included").select(key, *[F.col(c).alias(f"__{c}") for c in shared])
    got = whole.join(own, key)
    filled = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in whole.columns else F.col(f"__{c}").alias(c) for c in shared]
    return got.select(key, *filled, *[c for c in whole.columns if c not in (key, *shared)])


def metric_coverage(runs: DataFrame, metrics: DataFrame, samples: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Every run with every expected or observed metric: n, mean, min and max from raw samples if any has a value, else from
    aggregated telemetry, and why there is none. metrics is a catalogue of names, so it is small; nothing is imputed."""
    facts = lambda df, p: df.groupBy("run_id", "metric").agg(F.count("*").alias(f"{p}rows"), F.count("value").alias(f"{p}n"), F.avg("value").alias(f"{p}mean"), F.min("value").alias(f"{p}min"), F.max("value").alias(f"{p}max"))
    names = metrics.select("metric").union(samples.select("metric")).union(aggregated.select("metric")).distinct()
    listed = F.broadcast(names.groupBy().agg(F.sort_array(F.collect_set("metric")).alias("all")))
    grid = runs.select("run_id").join(listed).select("run_id", F.explode("all").alias("metric"))
    got = grid.join(facts(samples, "a_"), ["run_id", "metric"], "left").join(facts(aggregated, "b_"), ["run_id", "metric"], "left")
    raw = F.coalesce("a_n", F.lit(0)) > 0
    n = F.when(raw, F.col("a_n")).otherwise(F.coalesce("b_n", F.lit(0)))
    seen = F.coalesce("a_rows", F.lit(0)) + F.coalesce("b_rows", F.lit(0)) > 0
    value = lambda c: F.when(raw, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
    return got.select("run_id", "metric", n.alias("n"), value("mean"), value("min"), value("max"), F.when(n > 0, None).when(seen, "values_are_null").otherwise("metric_not_collected").alias("missing_reason"))


def request_counts(requests: DataFrame, runtime: str = "runtime") -> DataFrame:
    """runtime, scenario, request_hash, n: the multiset of requests; those without a hash take no part."""
    return requests.where("request_hash is not null").groupBy(runtime, "scenario", "request_hash").agg(F.count("*").alias("n"))


def pairing(requests: DataFrame, runtime: str = "runtime") -> DataFrame:
    """One row: runtimes, groups (scenario and hash), differing (groups that a runtime lacks or has more or less often) and paired:
    there are runtimes and hashes, and nothing differs. The counts themselves are compared, group by group."""
    counts = request_counts(requests, runtime)
    total = requests.agg(F.count_distinct(runtime).alias("runtimes"))
    by = counts.groupBy("scenario", "request_hash").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    shapes = by.groupBy("k", (F.col("low") == F.col("high")).alias("even")).agg(F.count("*").alias("groups"))  # a row for each number of runtimes
    sums = shapes.crossJoin(F.broadcast(total)).agg(F.max("runtimes").alias("runtimes"), F.sum("groups").alias("groups"), F.sum(F.when(~F.col("even") | (F.col("k") < F.col("runtimes")), F.col("groups")).otherwise(0)).alias("differing"))
    return sums.select(F.coalesce("runtimes", F.lit(0)).alias("runtimes"), F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("differing", F.lit(0)).alias("differing"), (F.coalesce("groups", F.lit(0)) > 0).alias("known")).select("runtimes", "groups", "differing", (F.col("known") & (F.col("differing") == 0)).alias("paired"))


def pairing_signature(requests: DataFrame, runtime: str = "runtime", digits: int = 2) -> DataFrame:
    """runtime, groups, requests, signature: SHA-256 of the multiset's lines `scenario|hash|count`, by runtime.

    A list of digests: lines fall into 16 ** digits parts by a digest of scenario and hash, a part's lines are digested in order,
    and so are the parts. So no list of all lines stands anywhere; with more groups, more digits. Two runtimes' signatures
    are equal if and only if (but for collisions of SHA-256) their multisets are."""
    counts = request_counts(requests, runtime)
    name = F.concat_ws("|", F.coalesce("scenario", F.lit("")), "request_hash")
    parts = counts.groupBy(runtime, F.substring(F.sha2(name, 256), 1, digits).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", name, F.col("n").cast("string")))), "\n"), 256).alias("digest"), F.count("*").alias("groups"), F.sum("n").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: F.concat_ws(":", p["part"], p["digest"])), "\n")
    return parts.groupBy(runtime).agg(F.sum("groups").alias("groups"), F.sum("n").alias("requests"), F.sha2(whole, 256).alias("signature"))


def consolidate_evals(metadata: DataFrame, performance: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, predictions). runs: the runs that have metadata, performance and predictions, with the first performance row's values
    and the run's attributes; predictions: theirs, each with its run's attributes.

    metadata: run_id, created_at, model, dataset, dataset_rows, seed, prompt_sha256, options (JSON text), digest, size_bytes,
    parameter_size, quantization_level; a row for each run. performance: run_id, and values. predictions: run_id, example_id,
    expected_tags (text), input_sha256, and values. The sample's hash is SHA-256 of the lines `example_id|expected_tags|input_sha256`
    in the order of ids; runs with the same sample, data, prompt and options share a comparison_id. Runs without any of the three are
    left out; if none is left both are empty (require_runs makes that an error)."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("example_id", "expected_tags", "input_sha256")])
    samples = sample_digests(predictions.select(F.col("run_id").cast("string"), F.col("example_id").cast("string"), line.alias("line"), F.lit(None).cast("string").alias("day"))).select("run_id", F.col("sha").alias("sample_sha256"), F.col("n").alias("predictions"))
    values = [c for c in performance.columns if c != "run_id"]
    first = performance.groupBy("run_id").agg(F.min(F.struct(*values)).alias("p")).select("run_id", *[F.col(f"p.{c}").alias(c) for c in values])
    stem = F.regexp_replace(F.regexp_extract("dataset", r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    named = model_attributes(F.coalesce("model", F.lit("")), F.col("parameter_size"), F.col("quantization_level"))
    identity = canonical_json(dataset=F.regexp_extract("dataset", r"([^/]*)/*$", 1), prompt_sha256=F.col("prompt_sha256"), sample_sha256=F.col("sample_sha256"), options=F.col("options"))
    label = F.when(F.coalesce("digest", F.lit("")) != "", F.concat("model", F.lit(" ["), F.substring("digest", 1, 8), F.lit("]"))).otherwise(F.col("model"))
    own = metadata.withColumn("run_id", F.col("run_id").cast("string")).join(samples, "run_id").select("*", stem.alias("dataset_name"), named.alias("__named"), label.alias("model_label"), F.when(F.col("size_bytes") > 0, F.col("size_bytes") / 1e9).alias("model_size_gb"), fingerprint(identity, 12).alias("comparison_id"))
    own = own.select("*", F.col("__named.parameters_b").alias("parameter_size_b"), F.col("__named.quantization").alias("quantization")).drop("__named")
    runs = first.withColumn("run_id", F.col("run_id").cast("string")).join(own, "run_id")
    attributes = ["created_at", "dataset_name", "prompt_sha256", "sample_sha256", "comparison_id", "model_label", "parameter_size_b", "quantization", "model_size_gb"]
    kept = predictions.withColumn("run_id", F.col("run_id").cast("string"))
    return runs, kept.drop(*attributes).join(runs.select("run_id", *attributes), "run_id")


def require_runs(runs: DataFrame) -> DataFrame:
    if runs.isEmpty():
        raise ValueError("no complete evaluation")
    return runs.orderBy("created_at", "run_id")


def sample_digests(lines: DataFrame) -> DataFrame:
    """run_id, n, created, sha from run_id, example_id, line, day: rows, first day, and SHA-256 of the lines in the order of
    their ids. The digest is fed row by row, so no list or text of a run's lines stands anywhere; a run is one task's."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        names, held = ["run_id", "n", "created", "sha"], None
        close = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*held[:3], held[3].hexdigest()], (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names)
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != r[0]:
                    if held:
                        yield close()
                    held = [r[0], 0, None, hashlib.sha256()]
                if held[1]:
                    held[3].update(b"\n")
                held[3].update(r[2].encode())
                held[1] += 1
                held[2] = r[3] if held[2] is None else held[2] if r[3] is None else min(held[2], r[3])
        if held:
            yield close()

    rows = lines.select("run_id", "example_id", "line", "day").repartition("run_id").sortWithinPartitions("run_id", "example_id", "line")
    return rows.mapInArrow(run, "run_id string, n long, created string, sha string")


def slo(value: Column, threshold: Column, at_most: bool = True) -> Column:
    met = value <= threshold if at_most else value >= threshold
    return F.when(threshold.isNull(), "not defined").when(value.isNull(), "no data").when(met, "pass").otherwise("fail")


def slo_overall(checks: list[Column]) -> Column:
    has = lambda s: F.array_contains(F.array(*checks), s)
    return F.when(has("fail"), "fail").when(has("no data"), "undetermined").when(has("pass"), "pass").otherwise("no targets")


def representative(requests: DataFrame, key: str, value: str, id_col: str) -> DataFrame:
    """By key the row nearest to the median, ties to the smaller id."""
    middle = percentiles(requests, [key], {value: F.col(value)}, [0.5]).select(key, F.col("p")[0].alias("median"))
    near = requests.where(F.col(value).isNotNull()).join(middle, key)
    return near.groupBy(key).agg(F.first("median").alias("median"), F.min(F.struct(F.abs(F.col(value) - F.col("median")).alias("d"), F.col(id_col).alias("id"), F.col(value).alias("v"))).alias("best")).select(key, "median", F.col("best.id").alias(id_col), F.col("best.v").alias(value))


def device_summary(samples: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """n, means and extremes of text columns; cells that don't parse or aren't finite are missing."""
    from ..functions.numbers import to_number

    v = {c: to_number(F.col(c)) for c in columns}
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), *[f(x).alias(f"{c}_{p}") for c, x in v.items() for p, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def cell_summary(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Closed-loop curve cells: ok and errors, rates over the wall from first start to last end (null unless above 0)."""
    ok = status_is(OK_STRICT)
    wall = F.max("end_s") - F.min("start_s")
    got = requests.groupBy(*keys).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), wall.alias("wall_s"), F.sum(F.when(ok, F.col("output_tokens"))).alias("tokens"), F.count_if(ok & F.col("prompt_tokens").isNull()).alias("missing_prompt_tokens"))
    got = with_percentiles(got, requests, keys, {"ttft": F.when(ok, F.col("ttft_ms")), "e2e": F.when(ok, F.col("latency_s"))})
    rate = lambda c: F.when(F.col("wall_s") > 0, F.col(c) / F.col("wall_s"))
    return got.withColumn("requests_s", rate("ok")).withColumn("tokens_s", rate("tokens"))


def cell_complete(requested: Column) -> Column:
    return (F.col("ok") == requested) & (F.col("errors") == 0) & (F.col("missing_prompt_tokens") == 0)


def resource_summary(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: median, p95 and max, distinct requests, and the share of those expected by scenario that have a value."""
    facts = rows.groupBy(*keys).agg(F.max("value").alias("peak"), F.count_distinct("request_uid").alias("n_requests"))
    facts = with_percentiles(facts, rows, keys, {"value": F.col("value")}).withColumnsRenamed({"value_p50": "median", "value_p95": "p95"}).drop("value_n")
    return facts.join(expected, keys[0]).withColumn("coverage", F.col("n_requests") / F.col("expected"))


def checksum_audit(files: DataFrame, inventory: DataFrame, external: DataFrame) -> DataFrame:
    """path, reasons of a three-way comparison: files (path, sha256, bytes) as they are, the inventory's claims (the same
    columns) and an external list (path, sha256)."""
    claims = inventory.groupBy("path").agg(F.min("sha256").alias("want"), F.min("bytes").alias("want_bytes"), F.count("*").alias("times"))
    outer = external.groupBy("path").agg(F.min("sha256").alias("listed"))
    got = claims.join(files, "path", "full").join(outer, "path", "full")
    rules = {
        "missing file": F.col("want").isNotNull() & F.col("sha256").isNull(),
        "hash differs": F.col("want") != F.col("sha256"),
        "size differs": F.col("want_bytes") != F.col("bytes"),
        "duplicate path": F.col("times") > 1,
        "path outside root": F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"),
        "not in external list": F.col("want").isNotNull() & F.col("listed").isNull(),
        "external differs": F.col("want") != F.col("listed"),
    }
    return got.select("path", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), r) for r, bad in rules.items()])).alias("reasons")).where(F.size("reasons") > 0)


def ordered_scenarios(df: DataFrame, fixed: list[str], column: str = "scenario") -> Column:
    """Sort key: the fixed order first, then the rest by name."""
    place = F.array_position(F.lit(fixed), F.col(column))
    return F.struct(F.when(place > 0, place).otherwise(F.lit(len(fixed) + 1)), F.col(column))


def latest_run(runs: DataFrame, keys: list[str], started: str = "started") -> DataFrame:
    row = F.struct(*runs.columns)
    return runs.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, F.struct(started, "run_id")).alias("r")).select("r.*")


def campaign_progress(summaries: DataFrame, keys: list[str]) -> DataFrame:
    got = summaries.groupBy(*keys).agg(F.sum("ok").alias("ok"), F.sum(F.col("errored") + F.col("incomplete")).alias("failed"), F.sum("expected").alias("expected"), F.count("*").alias("blocks"))
    return got.withColumn("progress", F.when(F.col("expected") > 0, (F.col("ok") + F.col("failed")) / F.col("expected")))


def expected_blocks(profile: Column, scenarios: Column, repetitions: Column, bucket_counts: Column) -> Column:
    """Blocks that a run plans: two for each scenario and repetition of the generic profile (a null profile is that), else one
    for each repetition and one more for each of its buckets with requests (map of counts); null if none has any."""
    times = F.when(F.coalesce(repetitions, F.lit(0)) == 0, 1).otherwise(repetitions)
    measured = F.size(F.filter(F.map_values(bucket_counts), lambda n: n > 0))
    return F.when(F.coalesce(profile, F.lit("generic")) == "generic", F.coalesce(F.size(F.coalesce(scenarios, F.array().cast("array<string>"))), F.lit(0)) * times * 2).when(measured > 0, times * (1 + measured))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))

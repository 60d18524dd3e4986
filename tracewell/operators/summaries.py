"""Joins of runs, answers and truths, and small summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import dedup

#: Names that a catalogue may have where each stands in every row's list.
CATALOGUE = 10_000


def golden_errors(responses: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    """key, error: keys of golden that stand there more than once ('repeated'), and keys of responses that it lacks ('unmatched')."""
    counts = golden.groupBy(key).agg(F.count("*").alias("n"))
    repeated = counts.where("n > 1").select(key, F.lit("repeated").alias("error"))
    asked = responses.select(key).distinct()
    lacking = asked.join(counts.where(F.col(key).isNotNull()), key, "left_anti").select(key, F.lit("unmatched").alias("error"))
    return repeated.unionByName(lacking)


def join_golden(responses: DataFrame, golden: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """responses with the columns of golden and `unmatched`. Of a repeated golden key one row counts, the least; strict: any error
    that golden_errors tells ends the job."""
    if strict and (found := golden_errors(responses, golden, key).limit(5).collect()):
        raise ValueError(f"golden keys: {[tuple(r) for r in found]}")
    own = dedup(golden, [key], [F.struct(*[c for c in golden.columns])]).withColumn("__there", F.lit(True)).withColumnRenamed(key, "__key")
    return responses.join(own, F.col(key) == F.col("__key"), "left").withColumn("unmatched", F.col("__there").isNull()).drop("__key", "__there")


def join_performance(scored: DataFrame, requests: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """scored with the values of the measured request of the same keys; of several the one with the least values."""
    own = dedup(requests.where("benchmark_phase = 'measure'").select(*keys, *values), keys, [F.col(v) for v in values])
    return scored.join(own, keys, "left")


def three_voter_join(base: DataFrame, second: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """Rows that all three voters have; each has a row for a key."""
    return base.join(second, key).join(third, key)


def golden_vs_model(golden: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Rows of golden that the model has answered, once each, whatever it repeats."""
    return golden.join(model.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def with_scenario(metrics: DataFrame, requests: DataFrame, key: str, scenario: str) -> DataFrame:
    """metrics with the scenario of their request, 'unassigned' where it is unknown; of a request's several the first by name."""
    own = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(scenario).alias("__scenario"))
    return metrics.join(own, key, "left").withColumn("scenario", F.coalesce("__scenario", F.lit("unassigned"))).drop("__scenario")


def compare_curves(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, y_a, y_b, ratio (null over zero) and delta where both curves have a point."""
    both = a.select(*keys, F.col(value).alias("y_a")).join(b.select(*keys, F.col(value).alias("y_b")), keys)
    return both.select(*keys, "y_a", "y_b", F.try_divide("y_b", "y_a").alias("ratio"), (F.col("y_b") - F.col("y_a")).alias("delta"))


def echo_mismatch(asked: DataFrame, answered: DataFrame, key: str, by: list[Column], sent: str, echoed: str) -> DataFrame:
    """Share of pairs whose answer names another request than was asked; a null echo is a mismatch."""
    pairs = asked.join(answered, key)
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg((~F.col(sent).eqNullSafe(F.col(echoed))).cast("int")).alias("mismatch"))


def catalogue(names: DataFrame, column: str) -> list[str]:
    """The distinct names of a catalogue in order. It is small by nature; one of more than CATALOGUE names is an error, as each would
    stand in every row's list."""
    found = [r[0] for r in names.select(column).where(F.col(column).isNotNull()).distinct().limit(CATALOGUE + 1).collect()]
    if len(found) > CATALOGUE:
        raise ValueError(f"{column}: more than {CATALOGUE} names are no catalogue")
    return sorted(found)


def expected_grid(members: DataFrame, key: str, names: list[str], name: str) -> DataFrame:
    """key, name: every distinct member with every name of a catalogue."""
    return members.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias(name))


def missing_members(members: DataFrame, rows: DataFrame, key: str, names: list[str], name: str) -> DataFrame:
    """The places of the expected grid for which there is no row."""
    return expected_grid(members, key, names, name).join(rows.select(key, name).distinct(), [key, name], "left_anti")


def coverage_gate(rows: DataFrame, keys: list[str], member: str, least: float = 0.8) -> DataFrame:
    """keys and coverage, the share of all members of rows that a group has, of groups with at least `least`."""
    total = rows.agg(F.count_distinct(member).alias("__expected"))  # one row
    got = rows.groupBy(*keys).agg(F.count_distinct(member).alias("__n")).join(F.broadcast(total))
    return got.select(*keys, F.try_divide(F.col("__n"), F.col("__expected")).alias("coverage")).where(F.col("coverage") >= least)


def best_by_metric(cells: DataFrame, by: list[str], name: str, value: str, coverage: str, least: float = 0.8, highest: bool = True) -> DataFrame:
    """by, name, value: of the cells with enough coverage and a value the best of each group, ties to the smaller name."""
    fit = cells.where((F.col(coverage) >= least) & F.col(value).isNotNull())
    key = F.struct((-F.col(value) if highest else F.col(value)).alias("v"), F.col(name).alias("n"))
    return fit.groupBy(*by).agg(F.min(key).alias("__b")).select(*by, F.col("__b.n").alias(name), (-F.col("__b.v") if highest else F.col("__b.v")).alias(value))


def pivot_resources(rows: DataFrame, index: str, column: str, names: list[str], value: str) -> DataFrame:
    """index, and for each name of column its mean value and its coverage as text `rows with a value/rows`; null and `0/0` where a
    name has no row."""
    facts = rows.where(F.col(column).isin(names)).groupBy(index, column).agg(F.avg(value).alias("mean"), F.concat_ws("/", F.count(value).cast("string"), F.count("*").cast("string")).alias("coverage"))
    of = lambda n, c: F.max(F.when(F.col(column) == n, F.col(c)))
    wide = facts.groupBy(index).agg(*[x for n in names for x in (of(n, "mean").alias(n), F.coalesce(of(n, "coverage"), F.lit("0/0")).alias(f"{n} coverage"))])
    return rows.select(index).distinct().join(wide, index, "left").na.fill("0/0", [f"{n} coverage" for n in names])


def review_effect(deltas: DataFrame, keys: list[str]) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    return deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("f1_delta").alias("mean_delta"), rate("improved"), rate("regressed"))


def split_shapes(df: DataFrame, split: str = "split") -> DataFrame:
    """split, n, share of all rows."""
    sizes = df.groupBy(split).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("__t"))  # one row
    return sizes.join(F.broadcast(total)).select(split, "n", (F.col("n") / F.col("__t")).alias("share"))


def mean_curve(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over the repetitions of a cell; cells with a null key are none."""
    known = cells
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count(value).alias("repetitions"), F.avg(value).alias("mean"))


def kv_occupancy(samples: DataFrame, keys: list[str], share: Column) -> DataFrame:
    """Mean and largest share in percent, and the number of samples with one."""
    return samples.groupBy(*keys).agg((100 * F.avg(share)).alias("mean_pct"), (100 * F.max(share)).alias("max_pct"), F.count(share).alias("n"))


def perplexity(losses: DataFrame, keys: list[str], loss: Column, tokens: Column) -> DataFrame:
    """exp of the summed loss of the windows over the tokens that they score."""
    return losses.groupBy(*keys).agg(F.exp(F.try_divide(F.sum(loss), F.sum(tokens))).alias("perplexity"))

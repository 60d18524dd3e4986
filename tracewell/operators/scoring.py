"""Multi-label predictions against golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import over


def outcomes(scored: DataFrame, keys: list[str], expected: str = "expected", generated: str = "generated") -> DataFrame:
    """keys, label, tp, fp, fn: one row for each group and label that it saw, counted before the shuffle."""
    e, g = F.col(expected), F.col(generated)
    mark = lambda arr, tp, fp, fn: F.transform(arr, lambda t: F.struct(t.alias("label"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn")))
    marks = F.concat(mark(F.array_intersect(e, g), 1, 0, 0), mark(F.array_except(g, e), 0, 1, 0), mark(F.array_except(e, g), 0, 0, 1))
    rows = scored.select(*keys, F.explode(marks).alias("m"))
    return rows.groupBy(*keys, F.col("m.label").alias("label")).agg(*[F.sum(f"m.{c}").alias(c) for c in ("tp", "fp", "fn")])


def macro_f1(scored: DataFrame, keys: list[str], **names) -> DataFrame:
    """Unweighted mean over the labels a group saw, in either set, of 2tp / (2tp + fp + fn); no row for a group without."""
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return outcomes(scored, keys, **names).groupBy(*keys).agg(F.avg(f1).alias("macro_f1"))


def grouped(scored: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates and macro F1 by keys; null keys are groups and meet again."""
    facts, macro = scored.groupBy(*keys).agg(*aggregates), macro_f1(scored, keys)
    same = [facts[k].eqNullSafe(macro[k]) for k in keys]
    return facts.join(macro, same, "left").select(facts["*"], macro["macro_f1"])


def quality_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return grouped(scored, keys, [F.count("*").alias("n"), rate("parse_ok").alias("parse_rate"), F.avg("f1").alias("mean_f1"), rate("exact_match").alias("exact_rate")])


def metrics_by_tag(scored: DataFrame, split: str, labels: list[str]) -> DataFrame:
    """Precision, recall and F1 of every label (0 where undefined) with both supports, by split and for all."""
    spark = scored.sparkSession
    sums = outcomes(scored, [split]).rollup("label", split).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).where("label is not null")
    sums = sums.select("label", F.coalesce(split, F.lit("all")).alias(split), "tp", "fp", "fn")
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    splits = scored.select(split).distinct().union(spark.createDataFrame([("all",)], f"{split} string"))
    grid = splits.withColumn("label", F.explode(F.lit(labels))) if labels else splits.join(names)
    got = grid.join(sums, [split, "label"], "left").na.fill(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.select(split, "label", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("expected_support"), (tp + fp).alias("generated_support"))


def with_all(scored: DataFrame, split: str) -> DataFrame:
    """Every row twice, once for its split and once for all, so that both are made of rows."""
    return scored.withColumn(split, F.explode(F.array(F.col(split), F.lit("all"))))


def review_deltas(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The second turn against the first of the same keys (the earliest, if there are several); without one no row."""
    first = scored.where("turn = 1").groupBy(*keys).agg(F.min_by("f1", "pos").alias("base_f1"))
    second = scored.where("turn = 2")
    delta = F.col("f1") - F.col("base_f1")
    return second.join(first, keys).withColumn("f1_delta", delta).withColumn("improved", delta > 0).withColumn("regressed", delta < 0)


def one_golden(golden: DataFrame, key: str) -> DataFrame:
    """Keys of golden that occur more than once: rows here are errors."""
    return golden.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dedup(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by an explicit order; partial aggregates, so hot keys are no sort."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(pick(row, F.struct(*order)).alias("__row")).select("__row.*")


def worst(df: DataFrame, n: int = 20) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("f1"), F.asc_nulls_last("latency_ms"), "example_id").limit(n)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def comparable(df: DataFrame, name: str) -> Column:
    """A column in its order; points in time as whole numbers, so that they come back from the driver as they went."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    return F.col(name)


def split_points(keys: DataFrame, n: int, oversample: int = 32) -> list[tuple]:
    """At most n - 1 increasing rows of keys that part them about evenly: a random sample of oversample * n rows, of which every
    oversample-th is collected."""
    (at,) = fresh(keys, "at")
    sample = keys.orderBy(F.rand(7)).limit(oversample * n)
    # A window without keys over a sample of bounded size.
    ranked = sample.withColumn(at, F.row_number().over(Window.orderBy(*keys.columns)))
    points: list[tuple] = []
    for r in sorted(ranked.where(F.col(at) % oversample == 0).collect(), key=lambda r: r[at])[: n - 1]:
        if not points or points[-1] != tuple(r)[:-1]:
            points.append(tuple(r)[:-1])
    return points


def bucket_of(key: Column, points: list[tuple], schema: T.StructType) -> Column:
    """How many of the increasing points aren't above a struct, by halving."""
    if not points:
        return F.lit(0)
    lits = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, schema, strict=True)]) for p in points])

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["low"] + state["high"]) / 2).cast("int")
        more, open_ = F.element_at(lits, mid + 1) <= key, state["low"] < state["high"]
        return F.struct(F.when(open_ & more, mid + 1).otherwise(state["low"]).alias("low"), F.when(open_ & ~more, mid).otherwise(state["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(points)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(points).bit_length())), start, halve)["low"]


def row_ordinals(df: DataFrame, order: list[str], name: str = "ordinal", buckets: int = 0) -> DataFrame:
    """df with the 0-based place of each row in the order of columns (null first), as a long; equal keys in the order of a hash of
    the whole row, so that places follow from the rows alone (wholly equal rows take theirs in any order).

    Split points are collected once, at most `buckets` (the shuffle partitions, if 0) less one. A row's bucket follows from its
    key and those literals, as do the counts of buckets, of which one number each is collected; so both reads of df agree
    whatever partitions they have, and a lost task numbers its rows as before. df must give the same rows each time: write one
    that doesn't (rand, limit without order) first. Equal keys are parted by the hash; only wholly equal rows share a bucket."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tie, bucket = fresh(df, "tie", "bucket")
    keyed = df.withColumn(tie, F.xxhash64(*hashed) if hashed else F.lit(0).cast("long"))
    keys = keyed.select(*[comparable(df, c).alias(f"k{k}") for k, c in enumerate(order)], F.col(tie).alias("k"))
    points = split_points(keys, n)
    key = F.struct(*[comparable(df, c).alias(f"k{k}") for k, c in enumerate(order)], F.col(tie).alias("k"))
    dealt = keyed.withColumn(bucket, bucket_of(key, points, keys.schema))
    counts = dict(map(tuple, dealt.groupBy(bucket).agg(F.count("*")).collect()))
    before = [sum(counts.get(b, 0) for b in range(k)) for k in range(len(points) + 1)]
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(*order, tie)).cast("long") - 1
    return dealt.withColumn(name, within + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col(bucket) + 1)).select(*[f"`{c}`" for c in df.columns if c != name], name)

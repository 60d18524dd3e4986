"""Exact percentiles of few large groups, without a group's values in one buffer.

The built-in aggregate holds all distinct values of a group in memory that can't spill, in one task. Here, values are counted,
the counts are added up by coarse buckets of the value (a monotone function of it), and only the buckets in which a wanted
rank falls are sorted, each by itself. So what one task sorts is a few values in ten thousand of a smooth distribution, and
a sort spills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite

#: Buckets for a factor of e; and what makes the numbers of all positive doubles positive.
FINENESS, SHIFT = 4096, 746


def bucket(value: Column) -> Column:
    """A long that doesn't fall as the double rises."""
    place = lambda x: F.floor(F.log(x) * FINENESS) + SHIFT * FINENESS
    return F.when(value > 0, place(value)).when(value < 0, -place(-value)).otherwise(0)


def same(left: str, right: str, keys: list[str]) -> Column:
    """Equal keys; nulls are a group."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def percentiles(df: DataFrame, keys: list[str], values: dict[str, Column], points: Sequence[float]) -> DataFrame:
    """keys, name, n long, p array<double>: of every group of keys (nulls are groups) and every named value its count and its
    percentiles at the points, interpolated between neighbours. Nulls, NaN and infinities don't count; a group without other
    values has no row."""
    own = [*keys, "name"]
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), finite(v.cast("double")).alias("v")) for n, v in values.items()]))
    rows = df.select(*keys, named.alias("e")).select(*keys, "e.name", "e.v").where("v is not null")
    counted = rows.groupBy(*own, "v").agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("v")))
    sums = counted.groupBy(*own, "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*own)
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*own, "bucket", F.sum("n").over(group).alias("total"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    place = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in points for f in (F.floor, F.ceil)]))
    held = lambda start, n: F.filter("ranks", lambda r: (r >= start) & (r < start + n))
    asked = sums.withColumn("ranks", ranks).withColumn("ranks", held(F.col("before"), F.col("n"))).where(F.size("ranks") > 0).drop("n")
    near = counted.alias("c").join(asked.alias("a"), same("c", "a", own) & (F.col("c.bucket") == F.col("a.bucket"))).select("c.*", "a.total", "a.before", "a.ranks")
    within = Window.partitionBy(*own, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("start", F.col("before") + F.sum("n").over(within) - F.col("n"))
    found = near.select(*own, "total", "v", F.explode(held(F.col("start"), F.col("n"))).alias("rank"))
    # At most two ranks for each point.
    at = found.groupBy(*own, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    low, high = (lambda p, f=f: F.col("at")[f(place(p)).cast("long")] for f in (F.floor, F.ceil))
    return at.select(*own, F.col("total").alias("n"), F.array(*[low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p))) for p in points]).alias("p"))


def with_percentiles(facts: DataFrame, df: DataFrame, keys: list[str], values: dict[str, Column], points: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """facts (one row for each group of keys of df) with {name}_n and {name}_p50 and so on of every named value; 0 and null
    where a group has no value."""
    got = percentiles(df, keys, values, points)
    of = lambda name, c: F.max(F.when(F.col("name") == name, c))
    label = lambda p: f"p{round(100 * p):02d}"
    wide = got.groupBy(*keys).agg(*[x for name in values for x in (of(name, F.col("n")).alias(f"{name}_n"), *[of(name, F.col("p")[k]).alias(f"{name}_{label(p)}") for k, p in enumerate(points)])])
    columns = [c for name in values for c in (F.coalesce(F.col(f"b.{name}_n"), F.lit(0)).alias(f"{name}_n"), *[F.col(f"b.{name}_{label(p)}").alias(f"{name}_{label(p)}") for p in points])]
    return facts.alias("a").join(wide.alias("b"), same("a", "b", keys), "left").select("a.*", *columns)

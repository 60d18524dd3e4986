"""Running sums and neighbours over long series, in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import bucket_of, comparable, fresh, split_points


def blocked_scan(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, source: DataFrame | None = None, blocks: int = 0) -> DataFrame:
    """rows with running sums (name: what is summed, this row included), values of the row before and of the row after (name:
    column), by keys in an order that is theirs alone (no two rows of a key are equal in it).

    The order of keys and columns is cut at split points, at most `blocks` (the shuffle partitions, if 0) less one, so a key with
    most rows lies in many blocks and a task scans one block, not one key. Totals and border rows of the blocks, a row for each
    key and block, carry what comes before and after into them. Null keys are a key. source: rows with the same keys and order,
    cheaper to sample. Sums are exact for whole numbers; of floats the order of addition differs from a plain scan."""
    sums, before, after = sums or {}, before or {}, after or {}
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*keys, *order]
    picked = (source or rows).select(*[comparable(source or rows, c).alias(f"k{k}") for k, c in enumerate(names)])
    points = split_points(picked, n)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in picked.schema])
    block, base, *own_keys = fresh(rows, "block", "base", *[f"key{k}" for k in range(len(keys))])
    dealt = rows.withColumn(block, bucket_of(F.struct(*[comparable(rows, c).alias(f"k{k}") for k, c in enumerate(names)]), points, schema))
    place = F.struct(*order)
    border = lambda pick, columns: pick(F.struct(F.lit(True).alias("there"), *[F.col(c).alias(name) for name, c in columns.items()]), place)
    totals = dealt.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own_keys, strict=True)], block).agg(F.struct(F.lit(0).alias("zero"), *[F.sum(c).alias(name) for name, c in sums.items()]).alias("sums"), border(F.min_by, after).alias("first"), border(F.max_by, before).alias("last"))
    line = Window.partitionBy(*own_keys).orderBy(block)
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*own_keys, F.col(block).alias(base), F.lag("last").over(line).alias("last"), F.lead("first").over(line).alias("first"), F.struct(F.lit(0).alias("zero"), *[F.sum(F.col(f"sums.{name}")).over(earlier).alias(name) for name in sums]).alias("sums"))
    carry = carry.select(*own_keys, base, F.struct("last", "first", "sums").alias("carried"))
    carried = fresh(dealt, "carried")[0]
    carry = carry.withColumnRenamed("carried", carried)
    same = (F.col(block) == F.col(base)) if not keys else None
    for k, o in zip(keys, own_keys, strict=True):
        same = F.col(k).eqNullSafe(F.col(o)) if same is None else same & F.col(k).eqNullSafe(F.col(o))
    joined = dealt.join(carry, same & (F.col(block) == F.col(base)))
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    c = F.col(carried)
    found = {name: F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(c["sums"][name], F.lit(0)) for name, v in sums.items()}
    at_start, at_end = F.row_number().over(inside) == 1, F.lead(F.lit(True)).over(inside).isNull()
    found |= {name: F.when(at_start, c["last"][name]).otherwise(F.lag(v).over(inside)) for name, v in before.items()}
    found |= {name: F.when(at_end, c["first"][name]).otherwise(F.lead(v).over(inside)) for name, v in after.items()}
    return joined.select(*[f"`{x}`" for x in rows.columns], *[v.alias(name) for name, v in found.items()])

"""Global ordinals: exact on wide frames of many partitions, with equal keys, under any plan."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import datasets, scoring


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Rows with two long columns beside the order, in many files; a third of them has one key."""
    path = str(tmp_path_factory.mktemp("wide") / "rows")
    k = F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id") % 5000)
    rows = spark.range(60_000, numPartitions=9).select(k.alias("k"), F.when(F.col("id") % 11 != 0, F.timestamp_millis(F.col("id") * 1000)).alias("at"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("a"), F.repeat(F.md5(F.col("id").cast("string")), 5).alias("tie"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.files.maxPartitionBytes": "300k"}, {"spark.sql.shuffle.partitions": "37"}])
def test_every_place_once(spark, wide, conf):
    before = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = scoring.row_ordinals(wide, ["k", "at"])
        assert got.columns == [*wide.columns, "ordinal"]
        rows = got.select("k", "at", "id", "ordinal").toPandas().sort_values("ordinal")
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert rows["ordinal"].tolist() == list(range(60_000)) and rows["id"].nunique() == 60_000
    keys = list(zip(rows["k"], rows["at"].notna(), rows["at"].fillna(rows["at"].min()), strict=True))
    assert keys == sorted(keys)


def test_equal_rows_and_odd_keys(spark):
    rows = [(None, float("nan"))] * 5 + [("a", 1.0)] * 20 + [("a", None), ("b", float("inf")), ("é", -1.0)]
    df = spark.createDataFrame(rows, "s string, x double").repartition(6)
    got = scoring.row_ordinals(df, ["s", "x"], "n", buckets=50).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(28)) and [r["s"] for r in got] == [None] * 5 + ["a"] * 21 + ["b", "é"] and got[5]["x"] is None
    assert scoring.row_ordinals(df.limit(0), ["s"]).collect() == []
    one = scoring.row_ordinals(spark.createDataFrame([(1, {"a": 1})], "id int, m map<string,int>"), ["id"]).collect()
    assert one[0]["ordinal"] == 0


def test_cycle_of_wide_rows(spark, wide):
    got = datasets.cycle_rows(wide.where("id < 7000"), "id", 100_000)
    slots = got.agg(F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot")).collect()[0]
    assert tuple(slots) == (100_000, 100_000, 0, 99_999)
    assert got.where(F.col("slot") % 7000 != F.col("id")).count() == 0
    assert datasets.cycle_rows(wide.limit(0), "id", 10).count() == 0 and datasets.cycle_rows(wide.where("id < 5"), "id", 3).count() == 3

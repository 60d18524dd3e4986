"""What the operators of this subpackage share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to Python; texts are long, so the default of 10,000 is too many.
BATCH_ROWS = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session already asks for fewer rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, codec: str = "lz4") -> tuple[DataFrame, str]:
    """(df written to the shared folder and read again, its place): its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, codec: str = "lz4") -> DataFrame:
    return written(df, codec)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def held_out(doc_id: str = "doc_id"):
    """True for a fifth of the ids; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one array of strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def by_bytes(texts: pa.Array, most: int = 16 << 20, rows: int | None = None):
    """Slices (from, to) of texts of about `most` bytes, and of at most `rows` texts; one longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        to = min(to, at + rows) if rows else to
        yield at, to
        at = to

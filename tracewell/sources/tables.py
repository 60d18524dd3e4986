"""Readers and writers of the files around benchmark runs and labelled data."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import to_number
from ..functions.text import cell_path, first_scalar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines see; where that is unset (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    return f"{base}/tracewell/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the pattern lets the table be one file or a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def csv_rows(files: DataFrame) -> DataFrame:
    """path, head, cells map<string,string>: the header (head true, its names) and the rows of CSV texts (path, value), quotes
    doubled inside quoted fields. Rows go out in small batches, so only a file's text is held."""

    def run(batches):
        import csv
        import io

        import pyarrow as pa

        kinds = [pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string())]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "head", "cells"])
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for path, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = csv.reader(io.StringIO(value.removeprefix("\ufeff"), newline=""))
                names = next((line for line in lines if line), None)
                if names is None:
                    continue
                rows = [(path, True, [(n, "") for n in dict.fromkeys(names)])]
                for line in lines:
                    if line:
                        rows.append((path, False, list(dict(zip(names, line)).items())))  # noqa: B905  short lines lack cells
                    if len(rows) >= 2000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, "path string, head boolean, cells map<string,string>")


#: Columns that summaries may have together.
COLUMNS = 10_000


def read_summaries(spark: SparkSession, *roots: str, name: str = "summary.csv") -> DataFrame:
    """Every summary.csv (or other file pattern) below the roots: source_file, experiment_id (the folder, or the one above a folder csv), then the
    sorted union of all columns, as text, missing as ''. No file at all is an error, and so are more than COLUMNS columns.

    Headers and lines become maps where the files are read; of them only the union of names, an aggregate, reaches the driver, and
    no path. Files that differ in every header are one read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(list(roots), wholetext=True)
    rows = csv_rows(files.select(F.col("_metadata.file_path").alias("path"), "value"))
    names = rows.where("head").select(F.explode(F.map_keys("cells")).alias("name")).distinct().limit(COLUMNS + 1)
    names = sorted(r[0] for r in names.collect())
    if not names:
        raise ValueError(f"no {name} found")
    if len(names) > COLUMNS:
        raise ValueError(f"{name}: more than {COLUMNS} columns")
    folder = F.split("path", "/")
    parent, above = F.element_at(folder, -2), F.element_at(folder, -3)
    own = [n for n in names if n not in ("source_file", "experiment_id")]
    cells = [F.coalesce(F.col("cells")[n], F.lit("")).alias(n) for n in own]
    return rows.where("not head").select(F.col("path").alias("source_file"), F.when(parent == "csv", above).otherwise(parent).alias("experiment_id"), *cells)


def open_stream(path: str, contents: bool = False):
    """A file's stored bytes, or (contents) what a compressed file holds, its kind told by its name; through the file systems that pyarrow knows (file, hdfs, s3, gs, abfs)."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        system, place = fs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    else:
        system, place = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_stream(place, compression="detect" if contents else None)


def hash_files(spark: SparkSession, folder: str, name: str = "*", contents: bool = False, opener=open_stream, piece: int = 4 << 20) -> DataFrame:
    """path, sha256, bytes, error of every file below a folder whose name fits the pattern.

    Spark lists the files and deals them to tasks by size, without their contents; each is then read on its executor in pieces
    of so many bytes, so a file of any size takes one piece of memory. A file that can't be read (forbidden, broken off) has an
    error and nulls; one that is gone since the listing has no row. contents: of compressed files (gz, bz2, zst, lz4) what they hold counts, not what is stored. opener: from path and `contents` to an
    object with read(n), for file systems that pyarrow lacks. No file: no row. As in all
    of Spark's readers, names that start with _ or . don't count, nor do files without a byte: an audit tells them as missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).option("ignoreMissingFiles", True).load(folder)

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                try:
                    with opener(path, contents) as source:
                        while data := source.read(piece):
                            digest.update(data)
                            size += len(data)
                    out.append((path, digest.hexdigest(), size, None))
                except OSError as e:
                    out.append((path, None, None, type(e).__name__))
            kinds = {"path": pa.string(), "sha256": pa.string(), "bytes": pa.int64(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return files.select("path").mapInArrow(run, "path string, sha256 string, bytes long, error string")


WORKLOAD = "request_id string, bucket string, review_instruction string, initial_messages array<struct<role:string,content:string>>"


def workload_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed rows of JSON lines with reasons; blank lines are skipped. Rows without reasons are the workload."""
    rows = lines.where(F.trim(column) != "").select(F.col(column).alias("line"), F.from_json(column, WORKLOAD).alias("r"))
    rows = rows.select("line", "r.*")
    counts = rows.where("request_id is not null").groupBy("request_id").agg(F.count("*").alias("__n"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "not an object": ~F.trim("line").startswith("{") | F.try_parse_json("line").isNull(),
        "blank request_id": blank("request_id"),
        "no messages": F.coalesce(F.size("initial_messages"), F.lit(0)) <= 0,
        "unknown bucket": ~F.coalesce(F.col("bucket").isin("short", "medium", "heavy"), F.lit(False)),
        "blank review_instruction": blank("review_instruction"),
        "duplicate request_id": F.coalesce(F.col("__n"), F.lit(0)) > 1,
    }
    reasons = F.array_compact(F.array(*[F.when(bad, r) for r, bad in rules.items()]))
    return rows.join(counts, "request_id", "left").withColumn("reasons", reasons).drop("__n")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return workload_rows(spark.read.text(path))


def read_company_export(spark: SparkSession, path: str) -> DataFrame:
    """record string: one JSON object for each record of a CSV, Parquet, JSON-lines or JSON file (an array, an object with
    records, or one object)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "ndjson"):
        return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("record"))
    if kind == "json":
        text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
        many = F.coalesce(F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")), F.from_json(F.get_json_object("v", "$.records"), "array<string>"), F.array("v"))
        return text.select(F.explode(many).alias("record"))
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if kind == "csv" else spark.read.parquet(path)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("record"))


def read_manifests(spark: SparkSession, root: str, name: str = "*manifest.json", deep: int = 0) -> DataFrame:
    """run, kind (dataset-manifest or manifest), document, error of every manifest below a folder json; broken JSON is a row.

    Files of the pattern `name` are <run>/json/<kind>.json, or with deep = 1 any files in <run>/json/<kind>; folders may be
    written as partitions, column=value."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    place = F.split(F.col("_metadata.file_path"), "/")
    part = lambda k: F.element_at(place, k - deep)
    kind = F.regexp_replace(F.regexp_replace(part(-1), r"\.json$", ""), "^[^=]*=", "")
    rows = files.select(part(-3).alias("run"), F.regexp_replace(part(-2), "=.*", "").alias("folder"), kind.alias("kind"), F.col("value").alias("document"))
    rows = rows.where((F.col("folder") == "json") & F.col("kind").isin("dataset-manifest", "manifest"))
    return rows.select("run", "kind", "document", F.when(F.try_parse_json("document").isNull(), "invalid JSON").alias("error"))


def manifest_field(runs: DataFrame, name: str, *paths: str) -> DataFrame:
    """runs (final, declared documents) with the first scalar at the paths, the final manifest first."""
    return runs.withColumn(name, F.coalesce(first_scalar(F.col("final"), *paths), first_scalar(F.col("declared"), *paths)))


MATRIX = "struct<data:struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>>"


def explode_range_matrix(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """timestamp_s, metric, value, labels of metric API matrices; series without a name and values that aren't finite go."""
    series = payloads.select(F.explode(F.from_json(column, MATRIX)["data"]["result"]).alias("s")).where(F.col("s.metric").getItem("__name__").isNotNull())
    points = series.select(F.col("s.metric").getItem("__name__").alias("metric"), F.map_filter("s.metric", lambda k, _: k != "__name__").alias("labels"), F.explode("s.values").alias("p"))
    return points.select(to_number(F.col("p")[0]).alias("timestamp_s"), "metric", to_number(F.col("p")[1]).alias("value"), "labels").where("timestamp_s is not null and value is not null")


def parse_exposition(scrapes: DataFrame, modern: str = "vllm:kv_cache_usage_perc", legacy: str = "vllm:gpu_cache_usage_perc", key: str = "scrape_id", column: str = "text") -> DataFrame:
    """key, series, fraction of metric text; within a scrape the legacy name counts only where the modern one is missing."""
    shape = rf"^({modern}|{legacy})(\{{[^}}]*\}})?\s+(\S+)"
    lines = scrapes.select(key, F.explode(F.split(column, r"\r?\n")).alias("line")).where(F.col("line").rlike(shape))
    rows = lines.select(key, F.regexp_extract("line", shape, 1).alias("name"), F.regexp_extract("line", shape, 2).alias("labels"), to_number(F.regexp_extract("line", shape, 3)).alias("fraction"))
    new = rows.groupBy(key).agg(F.bool_or(F.col("name") == modern).alias("__modern"))
    got = rows.join(new, key).where((~F.col("__modern") | (F.col("name") == modern)) & F.col("fraction").between(0, 1))
    return got.select(key, F.concat("name", "labels").alias("series"), "fraction")


REPORT_ROW = "array<struct<request_id:string,output:string,error:string,latency:double>>"


def flatten_report(reports: DataFrame, column: str = "report") -> DataFrame:
    """One row for each request of nested reports: successful, errored, then incomplete ones, numbered from 1 within each;
    the output stays for successful rows alone, the error for the others. Prompts never enter."""
    parts = []
    for kind in ("successful", "errored", "incomplete"):
        rows = reports.select("experiment_id", "block", F.posexplode(F.from_json(F.get_json_object(column, f"$.requests.{kind}"), REPORT_ROW)).alias("k", "r"))
        good = F.lit(kind == "successful")
        parts.append(rows.select("experiment_id", "block", F.lit(kind).alias("status"), (F.col("k") + 1).alias("request_index"), F.concat_ws(":", "experiment_id", "block", "r.request_id", (F.col("k") + 1).cast("string")).alias("request_uid"), F.when(good, F.col("r.output")).alias("output"), F.when(~good, F.col("r.error")).alias("error"), F.col("r.latency").alias("latency")))
    return reduce(DataFrame.unionByName, parts)


def load_cells(manifests: DataFrame, path: str = "path", document: str = "document") -> DataFrame:
    """One row for each curve cell: dimensions from the path, unless the manifest has its own; counts default to 0."""
    rows = manifests.withColumn("c", cell_path(F.col(path))).where("c is not null")
    own = lambda n, kind: F.get_json_object(document, f"$.{n}").try_cast(kind)
    dims = [F.coalesce(own(n, k), F.col(f"c.{n}")).alias(n) for n, k in (("parallel", "int"), ("ctx_size", "int"), ("cache", "string"), ("via", "string"), ("streams", "int"), ("repetition", "int"))]
    counts = [F.coalesce(own(f"summary.{n}", "int"), F.lit(0)).alias(a) for n, a in (("successful_count", "ok"), ("errored_count", "errors"))]
    return rows.select(path, *dims, *counts, own("summary.requests_per_second", "double").alias("requests_s"))


def telemetry_frame(samples: DataFrame, starts: DataFrame, labels: list[str]) -> DataFrame:
    """Samples with the seconds since their run's start and one column label_* for each label."""
    got = samples.join(starts, "experiment_id")
    return got.select("experiment_id", "metric", "timestamp_s", (F.col("timestamp_s") - F.col("start_s")).alias("elapsed_s"), "value", *[F.col("labels").getItem(n).alias(f"label_{n}") for n in labels])


def arrays_as_json(df: DataFrame) -> DataFrame:
    return df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, parquet: bool = False) -> None:
    """CSV with lists as JSON text and, if asked for, Parquet beside it."""
    arrays_as_json(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    if parquet:
        df.write.mode("overwrite").parquet(f"{path}/parquet")


def identity_and_shareable(golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(private keys with the domain, public rows without it)."""
    return golden.select("id", "site", "split"), golden.select("id", "business_model", "tags", "split")


def write_by_split(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def message_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def write_lines(df: DataFrame, path: str, separator: str = "\n") -> None:
    df.write.mode("overwrite").option("lineSep", separator).text(path)


def corpus_text(text: Column) -> Column:
    """A text without its line ends at the end; written with a blank line between."""
    return F.regexp_replace(text, r"\n+$", "")


def dataset_manifest(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("discovered"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"), F.count_distinct(F.when(F.col("included"), F.col("comparison_id"))).alias("groups"))

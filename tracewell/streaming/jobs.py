"""Streaming forms of the telemetry, labelling and history jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import OUTSIDE, phase_of


def correlate(samples: DataFrame, requests: DataFrame, late: str = "10 minutes", bucket: int = 3600) -> DataFrame:
    """Samples (experiment_id, sample_id, ts, metric, value) with the requests (request_uid, start_ts, end_ts, first_ts,
    last_ts) that hold their time, ends included; a sample that none holds comes as outside_request once its time has passed
    both watermarks. Samples without a time, and requests without either bound, take no part.

    A request is cut into pieces at every `bucket` seconds, each with a time and state of its own, and a sample meets the pieces
    of its bucket alone. So requests of any length count, state holds what the watermark hasn't passed, one busy experiment
    is split by time, and a pair arises once. A request told at its end finds the samples of the last `late` before it."""
    place = lambda c: F.floor(F.unix_seconds(c) / bucket)
    a = samples.where("ts is not null").withWatermark("ts", late).withColumn("__bucket", place(F.col("ts"))).alias("s")
    pieces = requests.where("end_ts >= start_ts").withColumn("__bucket", F.explode(F.sequence(place(F.col("start_ts")), place(F.col("end_ts")))))
    b = pieces.withColumn("__from", F.greatest("start_ts", F.timestamp_seconds(F.col("__bucket") * bucket))).withWatermark("__from", late).alias("r")
    on = F.expr(f"s.experiment_id = r.experiment_id AND s.__bucket = r.__bucket AND s.ts >= r.__from AND s.ts <= r.end_ts AND s.ts <= r.__from + INTERVAL {bucket} SECONDS")
    seconds = lambda c: F.col(c).cast("double")
    phase = F.when(F.col("r.__from").isNull(), OUTSIDE).otherwise(phase_of(seconds("s.ts"), seconds("r.first_ts"), seconds("r.last_ts")))
    return a.join(b, on, "left").select("s.experiment_id", "s.sample_id", "s.ts", "s.metric", "s.value", "r.request_uid", phase.alias("observed_phase"))


def rolling(samples: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """n, mean and max by window and metric; tumbling, or sliding if `slide` is given."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return samples.withWatermark("ts", late).groupBy(w, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")).select(F.col("window.start").alias("start"), "metric", "n", "mean", "max")


def upsert_latest(log: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 16):
    """A query that keeps the latest row of each key of an append log, in buckets by a hash of the key.

    A batch is merged with the newest rows of the buckets that it touches, and these alone are written again, as
    path/v=batch/bucket=...: the work follows the batch and its buckets. A batch that runs twice reads what stood before it
    and gives the same version. Of a bucket's versions the two newest stay."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        known = bucket_versions(spark, path, number)
        before = {b: v for b in touched if (v := max(known.get(b, ()), default=None)) is not None}
        for b, v in before.items():
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v={v}/bucket={b}").withColumn("bucket", F.lit(b)))
        row = F.struct(*batch.columns)
        latest = rows.groupBy("bucket", F.col(key).alias("__key")).agg(F.max_by(row, order).alias("r"))
        latest.select("bucket", "r.*").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        for b in before:
            remove(spark, *[f"{path}/v={v}/bucket={b}" for v in sorted(known[b])[:-1]])

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder of the cluster's file system; none if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bucket_versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """The versions of each bucket, those under `below` alone if it is given, by the names of their folders."""
    out: dict[int, list[int]] = {}
    for v in folders(spark, path):
        if v.startswith("v=") and (below is None or int(v[2:]) < below):
            for b in folders(spark, f"{path}/{v}"):
                if b.startswith("bucket="):
                    out.setdefault(int(b[7:]), []).append(int(v[2:]))
    return out


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that upsert_latest keeps below path: of each bucket those of its last version."""
    newest = [f"{path}/v={max(vs)}/bucket={b}" for b, vs in bucket_versions(spark, path).items()]
    return spark.read.parquet(*newest)


def keep_whole(result: DataFrame, path: str, checkpoint: str):
    """A query whose result is whole after every batch (complete mode), each written as a new version (path/v=batch)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")

    return result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)


def keep_closed(result: DataFrame, path: str, checkpoint: str):
    """A query in append mode: what the watermark has closed is written once, as path/v=batch, and leaves the state. A batch
    that runs twice writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")

    return result.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)


def late_rows(query) -> int:
    """Rows that a query's stateful operators left out as later than the watermark, over the batches that it still remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def replay(writer):
    """Run a query over all that its sources hold now, to the end; the ended query."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which transformWithState asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version below path; a version without rows follows only others without."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("v")).first()[0]
    return versions.where(F.col("v") == F.lit(newest)).drop("v")


HISTORY = "conv_id long, turn long, messages array<struct<turn:long,role:string,text:string>>"


def last_n_history(turns: DataFrame, n: int) -> DataFrame:
    """After each batch, the last n user and assistant messages of every contact that wrote; n messages are all its state."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in state.get[0]] if state.exists else []
        for b in batches:
            b = b[b.role.isin(["user", "assistant"]) & b.text.notna() & b.turn.notna()]
            held = sorted({*held, *zip(b.turn.astype(int), b.role, b.text, strict=True)})[-n:]
        state.update((held,))
        if held:
            yield pd.DataFrame({"conv_id": [key[0]], "turn": [held[-1][0]], "messages": [[{"turn": t, "role": r, "text": x} for t, r, x in held]]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, HISTORY, "messages array<struct<turn:long,role:string,text:string>>", "update", "NoTimeout")


def gateway_counters(responses: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return responses.withWatermark("ts", late).groupBy(F.window("ts", width), "agent_id", "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "agent_id", "status", "n")


class Level(StatefulProcessor):
    """Running sums of a key's changes by window. What stands at zero is forgotten: it needs no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "in_flight long, waiting long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flight, wait = self.level.get() if self.level.exists() else (0, 0)
        changes = pd.concat(list(rows)).sort_values("start")
        out = pd.DataFrame({"agent_id": key[0], "start": changes.start, "in_flight": flight + changes.f.cumsum(), "waiting": wait + changes.w.cumsum()})
        flight, wait = int(out.in_flight.iloc[-1]), int(out.waiting.iloc[-1])
        if flight or wait:
            self.level.update((flight, wait))
        else:
            self.level.clear()
        yield out

    def close(self) -> None:
        pass


def gateway_gauges(requests: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """agent_id, start, in_flight, waiting: how many requests (agent_id, arrival_ts, start_ts, end_ts) run and wait at the end of
    every window in which any of an agent arrives, starts or ends; between such windows the gauges stay. A request that never
    started (rejected) waits until its end; one without arrival or end counts nowhere.

    Changes are added up by window before they reach an agent's state, two numbers, so a busy agent sends a row a window. A
    window comes once the watermark has passed its end. Requests are told at their end: `late` must be as long as the longest."""
    move = lambda t, flight, wait: F.struct(F.col(t).alias("t"), F.lit(flight).alias("f"), F.lit(wait).alias("w"))
    served, rejected = F.array(move("arrival_ts", 0, 1), move("start_ts", 1, -1), move("end_ts", -1, 0)), F.array(move("arrival_ts", 0, 1), move("end_ts", 0, -1))
    whole = requests.where("agent_id is not null and arrival_ts is not null and end_ts is not null")
    moves = whole.select("agent_id", F.explode(F.when(F.col("start_ts").isNull(), rejected).otherwise(served)).alias("m")).select("agent_id", "m.*")
    net = moves.withWatermark("t", late).groupBy(F.window("t", width), "agent_id").agg(F.sum("f").alias("f"), F.sum("w").alias("w"))
    kind = requests.schema["agent_id"].dataType.simpleString()
    changes = net.select("agent_id", F.unix_seconds("window.start").alias("start"), "f", "w")
    return changes.groupBy("agent_id").transformWithStateInPandas(Level(), f"agent_id {kind}, start long, in_flight long, waiting long", "Append", "None")


def campaign_monitor(runs: DataFrame) -> DataFrame:
    """Newest run of each stage and runtime with its progress, for update mode."""
    return runs.groupBy("stage", "runtime").agg(F.max_by(F.struct("run_id", "ok", "expected"), "started").alias("r")).select("stage", "runtime", "r.*")


def sessions(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")

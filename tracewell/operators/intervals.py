"""Samples in time matched to request intervals, and what follows from the match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import blocked_scan

OUTSIDE = "outside_request"
STATS = ("sample_count", "mean", "p50", "p95", "min", "max", "first", "last", "delta", "rate_mean")


def phase_of(t: Column, first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "request_without_first_content").when(t < first, "prefill_observed").when(last.isNull() | (t <= last), "decode_observed").otherwise("response_close")


def bucket_width(spans: DataFrame) -> float:
    """Mean length of the intervals, so that all of them together touch at most three times as many buckets as they are; or
    more, so that the longest touches no more than a hundred thousand."""
    length = F.col("end_s") - F.col("start_s")
    mean, most = (None, None) if spans.isStreaming else spans.agg(F.avg(length), F.max(length)).first()
    return max(1e-3, mean, most / 100_000) if mean is not None else 3600.0


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows as struct s, with a number of their own that a repeated task gives again: a partition whose rows come in another order,
    as after a shuffle whose executor was lost, is sorted first. Equal rows may change places. Maps can't be sorted by."""
    order = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return rows.sortWithinPartitions(*order).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("s"), F.monotonically_increasing_id().alias(name))


def interval_join(samples: DataFrame, requests: DataFrame, width_s: float | None = None, key: str = "experiment_id") -> DataFrame:
    """Every sample with the request of its key that holds its time, ends included; of several the one that starts first
    (then the smaller request_uid), of none nulls, with observed_phase.

    samples: key, timestamp_s and more; requests: key, request_uid, start_s, end_s, first_s, last_s. Requests without
    either bound match nothing. Each row of samples gives one row, whatever its other columns repeat or lack.

    Requests are put into every bucket of width_s seconds that they touch (by default their mean length), so the join is on
    (key, bucket) and the exact test runs inside; a key that holds most samples is spread over its buckets. Rows carry a
    number through that one join, by which the first match of each is taken: a partial aggregate, not a sort."""
    spans = requests.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & (F.col("start_s") <= F.col("end_s")))
    width = F.lit(width_s if width_s is not None else bucket_width(spans))
    bucket = lambda c: F.floor(c / width)
    spans = spans.select(
        F.col(key).alias("__key"),
        F.struct("start_s", "request_uid", "end_s", "first_s", "last_s").alias("r"),
        F.explode(F.sequence(bucket(F.col("start_s")), bucket(F.col("end_s")))).alias("__in"),
    )
    rows = numbered(samples, "__row")
    t = F.col("s.timestamp_s")
    held = (F.col(f"s.{key}") == F.col("__key")) & (bucket(t) == F.col("__in")) & (t >= F.col("r.start_s")) & (t <= F.col("r.end_s"))
    out = rows.join(spans, held, "left").groupBy("__row").agg(F.first("s").alias("s"), F.min("r").alias("r"))
    phase = F.when(F.col("r").isNull(), OUTSIDE).otherwise(phase_of(t, F.col("r.first_s"), F.col("r.last_s")))
    return out.select("s.*", F.col("r.request_uid").alias("request_uid"), F.col("r.start_s").alias("request_start_s"), phase.alias("observed_phase"))


def phase_metrics(correlated: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of each group of keys (nulls are groups) over rows with a request. Gauges have a mean, percentiles and
    extremes; counters have, in their place, the mean rate from first to last. Resets aren't looked for here."""
    rows = correlated.where(F.col("request_uid").isNotNull())
    v, t = F.col("value"), F.col("timestamp_s")
    facts = rows.groupBy(*keys, "kind").agg(F.count(v).alias("sample_count"), F.avg(v).alias("__mean"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.95))).alias("__p"), F.min(v).alias("__min"), F.max(v).alias("__max"), F.min_by(v, F.struct(t, "sample_id")).alias("first"), F.max_by(v, F.struct(t, "sample_id")).alias("last"), F.min(t).alias("__t0"), F.max(t).alias("__t1"))
    gauge = lambda c: F.when(F.col("kind") != "counter", c)
    delta = F.when(F.col("sample_count") > 1, F.col("last") - F.col("first"))
    rate = F.when((F.col("kind") == "counter") & (F.col("__t1") > F.col("__t0")), delta / (F.col("__t1") - F.col("__t0")))
    return facts.select(*keys, "kind", "sample_count", gauge(F.col("__mean")).alias("mean"), gauge(F.col("__p")[0]).alias("p50"), gauge(F.col("__p")[1]).alias("p95"), gauge(F.col("__min")).alias("min"), gauge(F.col("__max")).alias("max"), "first", "last", delta.alias("delta"), rate.alias("rate_mean"))


def request_events(requests: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each clock reading that isn't null: request_uid, event, timestamp_s, request_elapsed_s."""
    start = F.col(next(iter(columns.values())))
    events = F.explode(F.array(*[F.struct(F.lit(name).alias("event"), F.col(c).cast("double").alias("timestamp_s")) for name, c in columns.items()]))
    rows = requests.select("experiment_id", "request_uid", start.alias("__start"), events.alias("e")).where("e.timestamp_s is not null")
    return rows.select("experiment_id", "request_uid", "e.event", "e.timestamp_s", (F.col("e.timestamp_s") - F.col("__start")).alias("request_elapsed_s"))


def counter_rate(series: DataFrame, keys: list[str], mask_resets: bool = True) -> DataFrame:
    """Change over time between neighbours of a series; equal times are averaged first. mask_resets: no rate where the
    counter falls."""
    even = series.groupBy(*keys, "timestamp_s").agg(F.avg("value").alias("value"))
    even = blocked_scan(even, keys, ["timestamp_s"], before={"__v": "value", "__t": "timestamp_s"}, source=series)
    dv, dt = F.col("value") - F.col("__v"), F.col("timestamp_s") - F.col("__t")
    ok = (dt > 0) & (dv >= 0) if mask_resets else dt > 0
    return even.select(*keys, "timestamp_s", "value", F.when(ok, dv / dt).alias("rate"))


def first_last_delta(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last less first by time; null under two samples or when it is negative."""
    got = rows.groupBy(*keys).agg(F.count("value").alias("samples"), F.min_by("value", F.struct("timestamp_s", "sample_id")).alias("a"), F.max_by("value", F.struct("timestamp_s", "sample_id")).alias("b"))
    return got.select(*keys, "samples", F.when((F.col("samples") > 1) & (F.col("b") >= F.col("a")), F.col("b") - F.col("a")).alias("delta"))


def trapezoid(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Integral over time by group, after equal times are averaged; null under two points."""
    even = rows.groupBy(*keys, "timestamp_s").agg(F.avg("value").alias("value"))
    even = blocked_scan(even, keys, ["timestamp_s"], before={"__v": "value", "__t": "timestamp_s"}, source=rows)
    area = (F.col("value") + F.col("__v")) / 2 * (F.col("timestamp_s") - F.col("__t"))
    return even.withColumn("area", area).groupBy(*keys).agg(F.count("*").alias("points"), F.sum("area").alias("integral"))


def energy_summary(power: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Joules by group and joules a token, null unless tokens are above 0. power: keys, timestamp_s, value, tokens."""
    joules = trapezoid(power, keys).where("points > 1")
    count = power.groupBy(*keys).agg(F.max(tokens).alias("tokens"))
    return joules.join(count, keys).select(*keys, "points", F.col("integral").alias("energy_j"), F.when(F.col("tokens") > 0, F.col("integral") / F.col("tokens")).alias("j_per_token"))


def concurrency(intervals: DataFrame, key: str) -> DataFrame:
    """Most intervals open at once by key: a sweep over starts and ends, ends first where they meet."""
    moves = intervals.select(key, F.explode(F.array(F.struct(F.col("start_s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_s").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    even = moves.groupBy(key, "m.t", "m.d").agg(F.sum("m.d").alias("step"))
    open_ = blocked_scan(even, [key], ["t", "d"], {"open": F.col("step")}, source=moves.select(key, "m.t", "m.d"))
    return open_.groupBy(key).agg(F.max("open").alias("max_in_flight"))


def queue_timeline(requests: DataFrame, key: str) -> DataFrame:
    """key, t, until, in_flight, waiting after every moment at which requests (arrival_s, start_s, end_s) arrive, start or end;
    `until` is the next such moment, null at the last. Moves of one moment count together."""
    move = lambda t, flight, wait: F.struct(F.col(t).alias("t"), F.lit(flight).alias("f"), F.lit(wait).alias("w"))
    moves = requests.select(key, F.explode(F.array(move("arrival_s", 0, 1), move("start_s", 1, -1), move("end_s", -1, 0))).alias("m"))
    even = moves.groupBy(key, "m.t").agg(F.sum("m.f").alias("f"), F.sum("m.w").alias("w"))
    found = blocked_scan(even, [key], ["t"], {"in_flight": F.col("f"), "waiting": F.col("w")}, after={"until": "t"}, source=moves.select(key, "m.t"))
    return found.select(key, "t", "until", "in_flight", "waiting")


def queue_profile(requests: DataFrame, key: str) -> DataFrame:
    """Most requests that wait at once by key, and how many wait and run on average over time."""
    span = F.col("until") - F.col("t")
    over_time = lambda c: F.try_divide(F.sum(F.col(c) * span), F.sum(span))
    return queue_timeline(requests, key).groupBy(key).agg(F.max("waiting").alias("max_waiting"), over_time("waiting").alias("mean_waiting"), over_time("in_flight").alias("mean_in_flight"))


def prefer_precomputed(ready: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `ready` that are valid (a gauge with a mean; a counter with a delta and two samples), and for keys that none
    covers, means and deltas of the raw samples."""
    valid = ready.where(F.when(F.col("kind") == "counter", F.col("delta").isNotNull() & (F.col("sample_count") >= 2)).otherwise(F.col("mean").isNotNull()))
    rest = raw.where(F.col("request_uid").isNotNull()).join(valid.select(*keys).distinct(), keys, "left_anti")
    again = phase_metrics(rest, keys)
    columns = [*keys, "kind", "sample_count", "mean", "delta"]
    return valid.select(*columns, F.lit("precomputed").alias("origin")).unionByName(again.select(*columns, F.lit("telemetry").alias("origin")))

"""Numeric columns in which absence stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the context bands.
BANDS = (512, 1024, 2048, 4096, 8192, 16384)


def finite(x: Column) -> Column:
    """x as double; NaN and infinities are missing."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def to_number(text: Column) -> Column:
    """Text as double; what doesn't parse, NaN and infinities are missing."""
    return finite(F.trim(text).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b if both are finite and above 0."""
    a, b = finite(a), finite(b)
    return F.when((a > 0) & (b > 0), a / b)


def context_band(tokens: Column) -> Column:
    lows = (0, *BANDS[:-1])
    ladder = F.when(tokens.isNull(), F.lit(None).cast("string"))
    for low, high in zip(lows, BANDS, strict=True):
        ladder = ladder.when(tokens < high, F.lit(f"[{low}, {high})"))
    return ladder.otherwise(f"[{BANDS[-1]}, +∞)")


def request_rates(prompt: Column, output: Column, inter_token_ms: Column, latency_s: Column) -> Column:
    """struct of decode (needs over one output token) and effective tokens a second, and the context's end."""
    return F.struct(
        F.when(output > 1, ratio(F.lit(1000.0), inter_token_ms)).alias("decode_tokens_s"),
        ratio(output, latency_s).alias("effective_tokens_s"),
        (prompt + output).alias("context_end_tokens"),
    )


def stream_metrics(start: Column, first: Column, last: Column, end: Column, completion: Column) -> Column:
    """struct of latencies and rates of a streamed answer from its four clock readings in seconds."""
    generation = F.when(completion > 1, last - first)
    return F.struct(
        ((first - start) * 1000).alias("ttft_ms"),
        (end - start).alias("e2e_s"),
        generation.alias("generation_s"),
        ratio(completion, generation).alias("decode_tokens_s"),
        ratio(completion, end - start).alias("effective_tokens_s"),
        (ratio(generation, completion - 1) * 1000).alias("inter_token_ms"),
    )


def metric_metadata(name: Column) -> Column:
    """struct<unit, kind> of a metric by its name; the first rule that fits holds."""
    # Fixed values.
    whole = ["vllm:kv_cache_usage_perc", "vllm:gpu_cache_usage_perc"]
    endings = [("_bytes_total", "bytes", "counter"), ("_bytes", "bytes", "gauge"), ("_total", "count", "counter"), ("_ratio", "fraction", "gauge"), ("_celsius", "celsius", "gauge"), ("_watts", "watts", "gauge")]
    pair = lambda u, k: F.struct(F.lit(u).alias("unit"), F.lit(k).alias("kind"))
    ladder = F.when(name.isin(whole), pair("fraction", "gauge"))
    for ending, unit, kind in endings:
        ladder = ladder.when(name.endswith(ending), pair(unit, kind))
    return ladder.otherwise(pair("unknown", "gauge"))


def usage_cost(input_tokens: Column, cached: Column, output: Column, prices=(0.05, 0.005, 0.40)) -> Column:
    """US dollars at prices a million of fresh input, cached input and output tokens; cached never exceed the input."""
    known = lambda c: F.coalesce(c, F.lit(0))
    reused = F.least(known(cached), known(input_tokens))
    fresh, again, made = prices
    return ((known(input_tokens) - reused) * fresh + reused * again + known(output) * made) / 1e6

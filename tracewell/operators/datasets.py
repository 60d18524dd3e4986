"""Labelled datasets: rules, splits, samples, workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import array_of, normalize_tags, parse_list, parse_tags_either
from ..functions.text import content_ids, normalize_domain, normalize_text, parse_utc
from .scoring import dedup


def valid_source_rows(df: DataFrame, text: str, tags: str) -> DataFrame:
    blank = F.trim(F.col(tags)).isin("", "[]", "None", "nan")
    return df.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(tags).isNotNull() & ~blank)


def golden_errors(df: DataFrame, labels: list[str], id_col: str = "id", text: str = "text", tags: str = "tags") -> DataFrame:
    """id, reasons of the rows that strict loading refuses; the empty list of tags is valid, null is no list."""
    counts = df.groupBy(id_col).agg(F.count("*").alias("__n"))
    t, allowed = F.col(tags), array_of(labels)
    rules = {
        "blank id": F.coalesce(F.trim(id_col), F.lit("")) == "",
        "duplicate id": F.coalesce(F.col("__n"), F.lit(0)) > 1,
        "blank text": F.coalesce(F.trim(text), F.lit("")) == "",
        "tags are no list": t.isNull(),
        "empty tag": F.exists(t, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""),
        "duplicate tag": F.size(F.array_distinct(t)) < F.size(t),
        "unknown tag": F.size(F.array_except(t, allowed)) > 0,
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return df.join(counts, id_col, "left").select(id_col, reasons.alias("reasons")).where(F.size("reasons") > 0)


def load_unlabelled(df: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: example_id, input_sha256, chars of every row whose text isn't blank; errors: example_id, n of the ids that stand more
    than once, which strict loading refuses). A blank or null id is the digest of its text. Copies of an id are
    counted where they lie before they are shuffled, so a hot id is no hot key."""
    own = F.when(F.coalesce(F.trim(id_col), F.lit("")) == "", F.sha2(text_col, 256)).otherwise(F.col(id_col))
    rows = df.where(F.trim(text_col) != "").select(own.alias("example_id"), F.sha2(text_col, 256).alias("input_sha256"), F.length(text_col).cast("long").alias("chars"))
    return rows, rows.groupBy("example_id").agg(F.count("*").alias("n")).where("n > 1")


def cleaned(raw: DataFrame, labels: list[str], domain: str = "domain", text: str = "business_model", tags: str = "tags", when: str = "enriched_at") -> DataFrame:
    """raw with domain and text in normal form (null is empty), `when` as a timestamp (null if it is none), tags as a list with
    parse_ok, n_tags and n_invalid_tags (those outside labels), and the digests text_hash and example_id."""
    parsed = parse_tags_either(F.col(tags))
    ids = content_ids(F.col(domain), F.col(text))
    out = raw.withColumns({domain: F.coalesce(normalize_domain(F.col(domain).cast("string")), F.lit("")), text: F.coalesce(normalize_text(F.col(text)), F.lit("")), when: parse_utc(F.col(when).cast("string")), "__parsed": parsed})
    out = out.withColumns({tags: F.col("__parsed.tags"), "parse_ok": F.col("__parsed.ok"), "__ids": ids}).drop("__parsed")
    return out.withColumns({"n_tags": F.size(tags), "n_invalid_tags": F.size(F.array_except(tags, array_of(labels))), "text_hash": F.col("__ids.text_hash"), "example_id": F.col("__ids.example_id")}).drop("__ids")


def eligible(clean: DataFrame, domain: str = "domain", text: str = "business_model", when: str = "enriched_at") -> DataFrame:
    """The rows of cleaned() with a domain, a text, a date and at least one tag, all of whose tags are labels."""
    return clean.where(F.col("parse_ok") & (F.col(domain) != "") & (F.col(text) != "") & F.col(when).isNotNull() & (F.col("n_tags") > 0) & (F.col("n_invalid_tags") == 0))


def quality_counts(clean: DataFrame, domain: str = "domain", when: str = "enriched_at") -> DataFrame:
    """One row of what cleaned() found: rows, domains, parse_failures, empty_tags, invalid_dates, texts."""
    none = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return clean.agg(F.count("*").alias("rows"), F.count_distinct(domain).alias("domains"), none(~F.col("parse_ok")).alias("parse_failures"), none(F.col("n_tags") == 0).alias("empty_tags"), none(F.col(when).isNull()).alias("invalid_dates"), F.count_distinct("text_hash").alias("texts"))


def load_labelled(df: DataFrame, order: list[str], text: str = "business_model", tags: str = "tags", id_col: str = "example_id") -> DataFrame:
    """Rows with a text and at least one tag, with expected_tags (a list literal's tags in normal form); by id the first in the
    given order. Without a column of ids an id is the digest of the text; with one, null ids go. Missing columns are an error."""
    missing = sorted({text, tags} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = df.withColumn("expected_tags", F.coalesce(normalize_tags(parse_list(F.col(tags))), array_of([]))).where(F.col(text).isNotNull() & (F.size("expected_tags") > 0))
    own = F.col(id_col).cast("string") if id_col in df.columns else F.sha2(text, 256)
    return dedup(rows.withColumn(id_col, own).where(F.col(id_col).isNotNull()), [id_col], [F.col(c) for c in order])


def latest_per_key(df: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The newest row of each key; equal times by the larger tie. A partial aggregate, so hot keys are no sort."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.struct(when, tie)).alias("__row")).select("__row.*")


def label_conflicts(df: DataFrame, key: str, tags: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(F.array_sort(tags)).alias("tag_sets"), F.count("*").alias("n")).where("tag_sets > 1")


def tag_frequency(df: DataFrame, tags: str, domain: str) -> DataFrame:
    return df.select(domain, F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct(domain).alias("domains"))


def top_k_tags(train: DataFrame, tags: str, k: int = 20) -> DataFrame:
    return train.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from a keyed digest: the same for a key wherever it stands."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def group_split(df: DataFrame, group: str, seed: str = "42", shares=(("train", 0.70), ("validation", 0.15), ("test", 0.15))) -> DataFrame:
    """df with split: all rows of a group go to one split, chosen by a digest of the group, so shares hold over groups."""
    u, edge, ladder = unit_hash(seed, F.col(group)), 0.0, None
    for name, share in shares[:-1]:
        edge += share
        ladder = (F if ladder is None else ladder).when(u < edge, name)
    return df.withColumn("split", ladder.otherwise(shares[-1][0]))


def hash_ranked_sample(df: DataFrame, n: int, seed: str, id_col: str) -> DataFrame:
    """n rows by the order of sha256(seed NUL id), then id: whatever the order of the input."""
    rank = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(id_col)), 256)
    return df.withColumn("__rank", rank).orderBy("__rank", id_col).limit(n).drop("__rank")


def tercile_thresholds(lengths: DataFrame, column: str) -> DataFrame:
    """t1, t2: the least lengths that at least a third and two thirds of the lengths don't exceed (nearest rank); nulls don't count.

    Lengths are counted, and the counts added up in blocks, so no list of lengths stands in one buffer."""
    from .scans import blocked_scan

    counts = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n"))
    so_far = blocked_scan(counts, [], ["length"], {"upto": F.col("n")}, source=lengths.select(F.col(column).alias("length")))
    total = lengths.agg(F.count(column).alias("total"))  # one row
    at = lambda k: F.min(F.when(3 * F.col("upto") >= k * F.col("total"), F.col("length"))).alias(f"t{k}")
    return so_far.join(F.broadcast(total)).agg(at(1), at(2))


def bucket_for(n: Column, t1: Column, t2: Column) -> Column:
    return F.when(n <= t1, "short").when(n <= t2, "medium").otherwise("heavy")


def stratified_hash_sample(df: DataFrame, per_bucket: int, seed: str, id_col: str = "id", bucket: str = "bucket") -> DataFrame:
    """The first per_bucket rows of each bucket by sha256(seed:id), interleaved: position, then short, medium, heavy. A
    bucket that is short of rows is an error. Salted top lists are merged, so a bucket with most rows is no hot group."""
    rank = F.sha2(F.concat(F.lit(seed + ":"), F.col(id_col)), 256)
    salt = F.pmod(F.xxhash64(id_col), F.lit(64))
    keyed = df.withColumn("__rank", rank).withColumn("__salt", salt)
    top = lambda d, *by: d.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("__rank", id_col))).where(F.col("position") <= per_bucket)
    got = top(top(keyed, bucket, "__salt"), bucket)
    order = F.array_position(F.lit(["short", "medium", "heavy"]), F.col(bucket)).alias("bucket_order")
    return got.select(*df.columns, "position", order)


def short_buckets(df: DataFrame, per_bucket: int, bucket: str = "bucket") -> DataFrame:
    names = df.sparkSession.createDataFrame([("short",), ("medium",), ("heavy",)], f"{bucket} string")
    have = df.groupBy(bucket).agg(F.count("*").alias("n"))
    return names.join(have, bucket, "left").na.fill(0, ["n"]).where(F.col("n") < per_bucket)


def exclude_overlap(warmup: DataFrame, measured: DataFrame, key: str, n: int) -> DataFrame:
    return warmup.join(measured.select(key).distinct(), key, "left_anti").orderBy(key).limit(n)


def pending(dataset: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows of the dataset without a request that was answered and parsed."""
    done = history.where("request_ok and parse_ok").select(key).distinct()
    return dataset.join(done, key, "left_anti")


def cycle_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows: slot (from 0) and the columns of df, whose rows are repeated in a frozen order; none if df is empty.

    Each row makes its own slots from its place and the number of rows, so nothing is joined or broadcast."""
    from .scoring import fresh, row_ordinals

    (at,) = fresh(df, "at")
    total = df.count()
    mine = F.when(F.col(at) < n, F.sequence(F.col(at), F.lit(n - 1).cast("long"), F.lit(max(1, total)).cast("long")))
    return row_ordinals(df, [order], at).select(F.explode(mine).alias("slot"), *[f"`{c}`" for c in df.columns])


#: USD for a million tokens of a batch.
INPUT_PRICE, OUTPUT_PRICE = 0.05, 0.4


def batch_cost(records: DataFrame, payload: Column, by: str, max_output_tokens: int = 256, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> DataFrame:
    """Requests, tokens and USD of a labelling batch by group, before it is sent: an estimate of a token for three bytes of
    the payload, and a ceiling of one for each byte, both with 200 for the envelope. A null payload counts as empty."""
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    got = records.groupBy(by).agg(F.count("*").alias("requests"), F.sum(F.ceil(size / 3) + 200).cast("long").alias("input_tokens"), F.sum(size + 200).cast("long").alias("most_input_tokens"))
    got = got.withColumn("most_output_tokens", F.col("requests") * max_output_tokens)
    usd = lambda c, price: F.col(c) * F.lit(price) / 1e6
    got = got.select("*", usd("input_tokens", input_price).alias("input_usd"), usd("most_input_tokens", input_price).alias("most_input_usd"), usd("most_output_tokens", output_price).alias("most_output_usd"))
    return got.select("*", (F.col("input_usd") + F.col("most_output_usd")).alias("total_usd"), (F.col("most_input_usd") + F.col("most_output_usd")).alias("most_total_usd"))


def budget_gate(costs: DataFrame, most_usd: float) -> DataFrame:
    """One row: the ceiling of all groups together, the budget, and whether the ceiling keeps within it. A budget that isn't
    above zero is an error."""
    if most_usd <= 0:
        raise ValueError("the budget must be above zero")
    total = costs.agg(F.coalesce(F.sum("most_total_usd"), F.lit(0.0)).alias("ceiling_usd"))
    return total.select("ceiling_usd", F.lit(float(most_usd)).alias("budget_usd"), (F.col("ceiling_usd") <= most_usd).alias("within"))


def materialize_summary(dataset: DataFrame, history: DataFrame, by: str, key: str = "example_id") -> DataFrame:
    """State of a labelling run by group: examples, and of the history (one row for each materialised example: key, request_ok,
    parse_ok, latency_ms, f1, exact_match) counts, rates over all examples, mean latency of successful rows, mean F1 and
    share of exact matches of parsed ones. What isn't parsed is pending."""
    rows = dataset.select(key, by).join(history.withColumn("__there", F.lit(True)), key, "left")
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok, parsed = sure("request_ok"), sure("parse_ok")
    got = rows.groupBy(by).agg(
        F.count("*").alias("examples"), F.count("__there").alias("materialised"), F.count_if(ok).alias("successful"), F.count_if(parsed).alias("parsed"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_latency_ms"), F.avg(F.when(parsed, F.col("f1"))).alias("mean_f1"), F.avg(F.when(parsed, F.col("exact_match").cast("int"))).alias("exact_match_rate"),
    )
    rate = lambda c: F.col(c) / F.col("examples")
    return got.select("*", (F.col("materialised") - F.col("successful")).alias("failed"), (F.col("examples") - F.col("parsed")).alias("pending"), rate("successful").alias("request_success_rate"), rate("parsed").alias("parse_rate"))

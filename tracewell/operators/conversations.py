"""Histories of turns: bounded windows, prompts, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n_messages(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, messages: the last n user and assistant messages with text, oldest first. Only n rows of each key are gathered."""
    valid = turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    ranked = valid.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__k") <= n)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("messages"))


def conversation_prompts(turns: DataFrame, most: int | None = None, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each user turn, the messages sent with it: the system message, all earlier messages (or the last `most` that are
    no system messages), and the turn."""
    w = Window.partitionBy(key).orderBy(order)
    system = F.first(F.when(F.col("role") == "system", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spoken = turns.select(key, order, "role", "text", system.alias("system")).where("role <> 'system'")
    said = F.collect_list(F.struct("role", "text")).over(w.rowsBetween(Window.unboundedPreceding if most is None else -most, 0))
    rows = spoken.select(key, order, "role", "system", said.alias("said")).where("role = 'user'")
    head = F.when(F.col("system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("text"))))
    return rows.select(key, order, F.concat(F.coalesce(head, F.filter("said", lambda _: F.lit(False))), "said").alias("messages"))


def closed_loop(turns: DataFrame, outputs: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with what the model answered (outputs: key, order, output) in place of the recorded texts of assistant turns; a
    turn without an output keeps none (null), so that its absence shows."""
    out = outputs.select(F.col(key).alias("__key"), F.col(order).alias("__order"), "output")
    joined = turns.join(out, F.col(key).eqNullSafe(F.col("__key")) & (F.col(order) == F.col("__order")) & (F.col("role") == "assistant"), "left")
    return joined.select(*[F.when(F.col("role") == "assistant", F.col("output")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in turns.columns])


def review_turns(turns: DataFrame, answers: DataFrame, instruction: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, role, text: the turns up to the last of the user, its answer (answers: key, answer; null or none is `[]`) and
    the instruction to review it, as a user turn."""
    last = turns.where("role = 'user'").groupBy(F.col(key).alias("__key")).agg(F.max(order).alias("__last"))
    begin = turns.join(last, F.col(key).eqNullSafe(F.col("__key"))).where(F.col(order) <= F.col("__last")).select(key, order, "role", "text")
    said = last.join(answers.select(F.col(key).alias("__other"), "answer"), F.col("__key").eqNullSafe(F.col("__other")), "left")
    more = F.array(F.struct((F.col("__last") + 1).alias("at"), F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("[]")).alias("text")), F.struct((F.col("__last") + 2).alias("at"), F.lit("user").alias("role"), F.lit(instruction).alias("text")))
    return begin.unionByName(said.select(F.col("__key").alias(key), F.explode(more).alias("m")).select(key, F.col("m.at").alias(order), "m.role", "m.text"))


def prompt_digests(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, n, chars, sha256: of the prompt of each user turn, which is all turns up to it, the messages, their
    characters and the digest of their lines `role:text`.

    Prompts of a conversation share their beginnings, and so does the digest's state: each turn is hashed once, and a copy of the
    state is closed at each user turn, so the work grows with the turns and no prompt is built. Turns stream through in order (turn,
    role, text), one conversation after another; rows without key or turn take no part, a null text counts as empty."""
    import pyarrow as pa

    known = turns.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = known.repartition("key").sortWithinPartitions("key", "at", "role", "text")

    def run(batches):
        import hashlib

        current, state, n, chars = None, hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for name, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != current:
                    current, state, n, chars = name, hashlib.sha256(), 0, 0
                state.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n, chars = n + 1, chars + len(text)
                if role == "user":
                    out.append((name, at, n, chars, state.copy().hexdigest()))
            if out:
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "at", "n", "chars", "sha256"])

    found = rows.mapInArrow(run, f"key {turns.schema[key].dataType.simpleString()}, at long, n long, chars long, sha256 string")
    return found.withColumnsRenamed({"key": key, "at": order})


def write_prompts(turns: DataFrame, path: str, key: str = "conv_id", order: str = "turn") -> None:
    """Prompts as two tables: `messages`, each message once with its place in the conversation, and `prompts`, for each user turn the
    places it reaches from and to. read_prompts puts the messages of some prompts together."""
    ranked = turns.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order, "role", "text")) - 1)
    ranked.select(key, "place", order, "role", "text").write.parquet(f"{path}/messages")
    messages = turns.sparkSession.read.parquet(f"{path}/messages")
    messages.where("role = 'user'").select(key, order, F.lit(0).alias("from"), F.col("place").alias("to")).write.parquet(f"{path}/prompts")


def read_prompts(spark, path: str, wanted: Column, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, messages array<struct<role, text>> of the prompts that meet a condition; only these are built."""
    prompts = spark.read.parquet(f"{path}/prompts").where(wanted).select(F.col(key).alias("__key"), F.col(order).alias("__order"), "from", "to")
    messages = spark.read.parquet(f"{path}/messages")
    both = prompts.join(messages, (F.col("__key") == F.col(key)) & F.col("place").between(F.col("from"), F.col("to")))
    got = both.groupBy(F.col("__key").alias(key), F.col("__order").alias(order)).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("m"))
    return got.select(key, order, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def trim_to_budget(turns: DataFrame, budget: int, tokens: Column, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, kept_pairs, dropped_pairs, kept_tokens, over_budget: the oldest pairs of user and assistant go until what is
    left fits; the system message and the last user message always stay, and are over budget if they alone don't fit."""
    w = Window.partitionBy(key).orderBy(order)
    counted = turns.withColumn("n", tokens)
    last = F.max(F.when(F.col("role") == "user", F.col(order))).over(Window.partitionBy(key))
    pair = F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = counted.withColumn("__last", last).withColumn("__pair", pair).where(F.col("__last").isNull() | (F.col(order) <= F.col("__last")))
    fixed = (F.col("role") == "system") | (F.col(order) == F.col("__last"))
    base = marked.where(fixed).groupBy(key).agg(F.sum("n").alias("base"))
    pairs = marked.where(~fixed).groupBy(key, "__pair").agg(F.sum("n").alias("n"))
    newest = Window.partitionBy(key).orderBy(F.desc("__pair")).rowsBetween(Window.unboundedPreceding, 0)
    sums = pairs.join(base, key, "left").withColumn("__sum", F.sum("n").over(newest) + F.coalesce("base", F.lit(0)))
    kept = F.col("__sum") <= budget
    per = sums.groupBy(key).agg(F.count_if(kept).alias("kept_pairs"), F.count_if(~kept).alias("dropped_pairs"), F.sum(F.when(kept, F.col("n"))).alias("pair_tokens"))
    out = base.join(per, key, "left").na.fill(0, ["kept_pairs", "dropped_pairs", "pair_tokens"])
    return out.select(key, "kept_pairs", "dropped_pairs", (F.col("base") + F.col("pair_tokens")).alias("kept_tokens"), (F.col("base") > budget).alias("over_budget"))


def sliding_spans(lengths: DataFrame, window: int, stride: int, key: str) -> DataFrame:
    """key, begin, end, target_len of windows over a sequence of length n; the last is the first that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - window) / stride)).cast("int")
    spans = lengths.where("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    begin = F.col("k") * stride
    end = F.least(begin + window, F.col("n"))
    before = F.when(F.col("k") == 0, 0).otherwise(begin - stride + window)
    return spans.select(key, begin.alias("begin"), end.alias("end"), (end - before).alias("target_len"))


def allowlist_filter(messages: DataFrame, allowed: list[str], candidates: list[str]) -> DataFrame:
    """Messages with authorized: the first candidate whose digits are on the list. An empty list lets nothing through."""
    digits = F.array(*[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\D", "") for c in candidates])
    keep = sorted({"".join(ch for ch in a if ch.isdigit()) for a in allowed} - {""})
    hit = F.get(F.filter(digits, lambda d: d.isin(keep) if keep else F.lit(False)), F.lit(0))
    return messages.withColumn("authorized", hit).where(F.col("authorized").isNotNull())

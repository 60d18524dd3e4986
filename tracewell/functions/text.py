"""Text, identifiers, JSON paths, names and times."""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import to_number


def normalize_domain(x: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^[a-z][a-z0-9+.-]*://", ""), r"^www\.", "")
    return F.element_at(F.split(bare, "/"), 1)


def normalize_text(x: Column) -> Column:
    """Line ends as LF, single blanks inside lines, no empty lines."""
    lines = F.split(F.regexp_replace(x, r"\r\n?", "\n"), "\n")
    clean = F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.array_join(F.filter(clean, lambda s: s != ""), "\n")


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def content_ids(domain: Column, text: Column) -> Column:
    """struct<text_hash, example_id>."""
    return F.struct(sha(text).alias("text_hash"), sha(F.concat(domain, F.lit("|"), sha(text))).alias("example_id"))


def first_scalar(document: Column, *paths: str) -> Column:
    """First of the JSON paths that holds a scalar."""
    found = [F.get_json_object(document, p) for p in paths]
    return F.coalesce(*[F.when(~f.rlike(r"^\s*[\[{]"), f) for f in found])


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without anything beyond ASCII."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def latin_fold(text: Column) -> Column:
    """The same for accented letters of Western European languages, in built-in functions."""
    return F.translate(text, "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY")


def slug(text: Column, exact: bool = False) -> Column:
    """Lower-case letters and digits joined by single hyphens. exact: fold any script by NFKD, in Python."""
    folded = ascii_fold(text) if exact else F.regexp_replace(latin_fold(text), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(folded), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def run_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys, nulls kept, for fields known by name."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


@F.pandas_udf(T.StringType())
def canonical_any(text: pd.Series) -> pd.Series:
    """The same for any JSON document; null if it is none."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)


def fingerprint(document: Column, digits: int = 64) -> Column:
    return F.substring(sha(document), 1, digits)


def uid(experiment: Column, block: Column, request: Column, index: Column) -> Column:
    return F.concat_ws(":", experiment, block, request, index.cast("string"))


def utc_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_micros((seconds * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def parse_utc(text: Column) -> Column:
    """Compact or ISO times; without a zone they are UTC, the session's zone."""
    t = F.trim(text)
    compact = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(\.\d+)?Z$", "$1-$2-$3T$4:$5:$6$7Z")
    return F.try_to_timestamp(compact)


def runtime_alias(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.isin("llama", "llama.cpp", "llamacpp", "llama-cpp"), "llama").otherwise(low)


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "sim"), F.lit(False))


CELL = r"p(\d+)-ctx(\d+)-cache-(on|off)(-via-gateway)?/s(\d+)-r(\d+)$"


def cell_path(path: Column) -> Column:
    """struct of a curve cell's dimensions, null if the path names none."""
    part = lambda k: F.regexp_extract(path, CELL, k)
    names = {1: "parallel", 2: "ctx_size", 5: "streams", 6: "repetition"}
    numbers = [part(k).try_cast("int").alias(n) for k, n in names.items()]
    via = F.when(part(4) == "", "runtime").otherwise("gateway").alias("via")
    return F.when(path.rlike(CELL), F.struct(*numbers, part(3).alias("cache"), via))


def model_attributes(name: Column, declared_size: Column, declared_level: Column) -> Column:
    """struct<parameters_b, quantization>: declared values first, then what the name says."""
    own = F.regexp_extract(F.coalesce(declared_size, F.lit("")), r"(\d+(?:\.\d+)?)\s*[bB]", 1)
    named = F.regexp_extract(name, r"(?:^|[^a-zA-Z0-9])(\d+(?:\.\d+)?)[bB](?:$|[^a-zA-Z])", 1)
    level = F.regexp_extract(name, r"(?i)q\d+(?:_[a-zA-Z0-9]+)*", 0)
    return F.struct(F.coalesce(own.try_cast("double"), named.try_cast("double")).alias("parameters_b"), F.coalesce(F.nullif(declared_level, F.lit("")), F.nullif(level, F.lit(""))).alias("quantization"))


def run_tags(model: Column, runtime: Column, scenario: Column, phase: Column, tokens_p50: Column, ttft_ms: Column, first_token_ms: Column, errored: Column, incomplete: Column) -> Column:
    """Seven prefix:value tags of a run summary, joined by bars. The order of the ladders matters: bf16 is met as f16."""
    m, known = F.lower(F.coalesce(model, F.lit(""))), lambda c: F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)
    # Fixed values.
    levels = [(r"q4(?:_|\b)|4bit", "q4"), (r"q8(?:_|\b)|8bit", "q8"), ("awq", "awq"), ("gptq", "gptq"), ("exl3", "exl3"), ("fp16|f16", "fp16"), ("bf16", "bf16")]
    families = ["qwen", "llama", "mistral", "gemma", "phi"]
    level = F.coalesce(*[F.when(m.rlike(p), label) for p, label in levels], F.lit("unknown"))
    family = F.coalesce(*[F.when(m.contains(f), f) for f in families], F.lit("other"))
    tokens, ttft = to_number(tokens_p50), F.coalesce(to_number(ttft_ms), to_number(first_token_ms))
    context = F.when(tokens.isNull(), known(scenario)).when(tokens < 512, "short").when(tokens < 4096, "medium").otherwise("long")
    speed = F.when(ttft.isNull(), "ttft-unavailable").when(ttft < 500, "ttft-fast").when(ttft < 2000, "ttft-medium").otherwise("ttft-slow")
    clean = (F.coalesce(to_number(errored), F.lit(0.0)) == 0) & (F.coalesce(to_number(incomplete), F.lit(0.0)) == 0)
    values = {"runtime": F.lower(known(runtime)), "model-family": family, "quantization": level, "context": context, "phase": F.lower(known(phase)), "status": F.when(clean, "complete").otherwise("degraded"), "performance": speed}
    return F.concat_ws("|", *[F.concat(F.lit(k + ":"), v) for k, v in values.items()])


def cache_flags(argv: Column) -> Column:
    """array<struct<flag, value>> of the arguments that control caches, with the value in or after the argument."""
    # Fixed values.
    exact = ["-ctk", "-ctv", "--block-size", "--cpu-offload-gb", "--gpu-memory-utilization", "--num-gpu-blocks-override", "--swap-space"]
    marks, switches = "cach|keepalive|keep-alive", "^--(enable|disable|no)-"

    def pair(x: Column, i: Column) -> Column:
        follows = F.get(argv, i + 1)
        inline = F.when(x.contains("="), F.substring_index(x, "=", 1)).otherwise(x)
        value = F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).when(~F.lower(inline).rlike(switches) & follows.isNotNull() & ~follows.startswith("-"), follows).otherwise("true")
        wanted = (F.lower(x).rlike(marks) | F.lower(inline).isin(exact)) & (x.startswith("-") | x.contains("="))
        return F.when(wanted, F.struct(inline.alias("flag"), value.alias("value")))

    return F.array_distinct(F.filter(F.transform(argv, pair), lambda p: p.isNotNull()))


#: Names whose values never appear in a table.
SENSITIVE = ["api_key", "authorization", "access_token", "auth_token", "hf_token", "password", "secret", "token"]


#: They are met in any case, after any dashes, with either line between their words.
SENSITIVE_NAME = rf"(?i)^\s*-*(?:{'|'.join(name.replace('_', '[-_]') for name in SENSITIVE)})\s*$"


def is_sensitive(name: Column) -> Column:
    return name.rlike(SENSITIVE_NAME)


def redact_argv(argv: Column, secret: Column) -> Column:
    """Arguments without values of sensitive names, inline or next, and without the secret itself. A value that is hidden
    starts nothing, so in a run of bare sensitive names every second one is such a value."""
    bare = lambda x: is_sensitive(x) & ~x.contains("=")

    def run_before(i: Column) -> Column:
        return F.aggregate(F.slice(argv, 1, i), F.lit(0), lambda n, x: F.when(bare(x), n + 1).otherwise(0))

    def one(x: Column, i: Column) -> Column:
        hidden = F.lit("[REDACTED]")
        named = x.contains("=") & is_sensitive(F.substring_index(x, "=", 1))
        kept = F.when((F.coalesce(secret, F.lit("")) == "") | bare(x), x).otherwise(F.replace(x, secret, hidden))
        return F.when(F.when(i == 0, F.lit(0)).otherwise(run_before(i)) % 2 == 1, hidden).when(named, F.concat(F.substring_index(x, "=", 1), F.lit("="), hidden)).otherwise(kept)

    return F.transform(argv, one)


HIDDEN = "[REDACTED]"


def sensitive_name(name) -> bool:
    """The rule of is_sensitive for one value of a document."""
    return isinstance(name, str) and re.match(SENSITIVE_NAME, name) is not None


def hidden_places(box: dict | list) -> dict:
    """What takes the place of which of a container's items. Of an object, the values of sensitive names. Of a list, as of
    arguments in redact_argv: what stands at an odd place after bare sensitive names, and values within an argument."""
    if isinstance(box, dict):
        return dict.fromkeys(filter(sensitive_name, box), HIDDEN)
    after = accumulate(map(sensitive_name, box), lambda n, bare: n + 1 if bare else 0, initial=0)
    out = {}
    for place, (item, n) in enumerate(zip(box, after, strict=False)):
        inline = isinstance(item, str) and "=" in item and sensitive_name(item[: item.index("=")])
        if n % 2 or inline:
            out[place] = HIDDEN if n % 2 else item[: item.index("=") + 1] + HIDDEN
    return out


def redacted(document, secret: str | None):
    """A JSON document of any depth without what sensitive names hold and without the secret. Containers are changed in place,
    one after another, so depth is no matter."""
    root = {"": document}
    waiting: list = [root]
    while waiting:
        box = waiting.pop()
        hidden = hidden_places(box)
        for place, item in list(box.items() if isinstance(box, dict) else enumerate(box)):
            if place in hidden:
                box[place] = hidden[place]
            elif isinstance(item, dict | list):
                waiting.append(item)
            elif secret and isinstance(item, str) and not (isinstance(box, list) and sensitive_name(item)):
                box[place] = item.replace(secret, HIDDEN)
    return root[""]


@F.pandas_udf(T.StringType())
def redact_json(documents: pd.Series, secrets: pd.Series) -> pd.Series:
    """Redacted JSON documents, compact and in their own order; null where the text is null or no JSON."""

    def one(text, secret):
        try:
            return None if text is None else json.dumps(redacted(json.loads(text), secret), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return pd.Series([one(d, s) for d, s in zip(documents, secrets, strict=True)], dtype=object)


def gpu_inventory(csv: Column) -> Column:
    """array<struct> of device lines with five comma-separated fields; a line of another shape voids the whole text."""
    lines = F.filter(F.split(F.trim(csv), r"\r?\n"), lambda s: F.trim(s) != "")
    names = ["index", "name", "uuid", "memory", "driver"]
    rows = F.transform(lines, lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x)))
    device = F.transform(rows, lambda r: F.struct(*[F.get(r, F.lit(k)).alias(n) for k, n in enumerate(names)]))
    return F.when((F.size(lines) > 0) & F.forall(rows, lambda r: F.size(r) == len(names)), device)


def output_text(body: Column) -> Column:
    """Text of the first output_text part of the first message item of a batch response body, else empty."""
    items = F.from_json(F.get_json_object(body, "$.output"), "array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    content = F.get(F.filter(items, lambda x: x["type"] == "message"), F.lit(0))["content"]
    return F.coalesce(F.get(F.filter(content, lambda c: c["type"] == "output_text"), F.lit(0))["text"], F.lit(""))


def render_messages(system: Column, text: Column, answer: Column | None = None) -> Column:
    """array<struct<role, content>> of a labelling prompt, with the answer if it is known."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", system), say("user", text), *([say("assistant", answer)] if answer is not None else []))


def whitespace_tokens(text: Column) -> Column:
    """The default tokenizer: words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))

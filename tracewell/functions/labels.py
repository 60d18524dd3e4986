"""Sets of labels: parsing, normal forms, comparison, votes."""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json import whole_json

#: The 20 labels of the taxonomy, in its order.
TAXONOMY = [
    "empresa estabelecida", "estabelecimento físico", "b2b", "vendas remotas", "serviço", "atuação nacional", "tecnologia", "produto", "whatsapp", "b2c",
    "instagram", "compra planejada", "blog", "público: empresas médias e grandes", "linkedin", "atuação regional", "facebook", "atuação internacional",
    "público: micro e pequenas empresas", "segmento: tecnologia da informação",
]


def array_of(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def fold(text: Column) -> Column:
    """Caseless form; beyond lower case, sharp s and final sigma are the common letters that differ."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, caseless, single spaces; no blanks, no repeats, sorted."""
    clean = F.transform(tags, lambda t: F.trim(F.regexp_replace(fold(t), r"(?U)\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != ""))))


#: A list literal whose items are strings without prefix or uncommon escapes (neighbours are joined), whole numbers, None, True or
#: False. All repetition is possessive, so that long lists need no stack.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "'": "'", '"': '"'}
QUOTED = r"""(?:'(?:[^'\\\n\r\x00]|\\[\\'"nrt])*+'|"(?:[^"\\\n\r\x00]|\\[\\'"nrt])*+")"""
SPACE = r"[ \t\n\r\f]*+"
ITEM = rf"(?:{QUOTED}(?:{SPACE}{QUOTED})*+|-?+[1-9][0-9]{{0,17}}+|0|None|True|False)"
LITERAL = rf"^{SPACE}\[{SPACE}(?:{ITEM}(?:{SPACE},{SPACE}{ITEM})*+{SPACE}(?:,{SPACE})?+)?+\]{SPACE}\z"


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(text: pd.Series) -> pd.Series:
    """Python's own reading of list literals, items as str() shows them; anything else is null."""

    def one(x):
        try:
            value = ast.literal_eval(x) if x is not None else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None
        return [str(v) for v in value] if isinstance(value, list) else None

    return text.map(one)


def unescaped(text: Column) -> Column:
    """The common escapes of a literal; a double backslash is one, whatever follows."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: reduce(lambda t, e: F.replace(t, F.lit("\\" + e[0]), F.lit(e[1])), ESCAPES.items(), p)), "\\")


def plain_list(text: Column) -> Column:
    """array<string> of the lists that LITERAL matches as a whole, items as str() shows them; others are null."""
    joined = lambda item: F.array_join(F.transform(F.regexp_extract_all(item, F.lit(f"({QUOTED})"), 1), lambda q: unescaped(F.substring(q, F.lit(2), F.length(q) - 2))), "")
    items = F.transform(F.regexp_extract_all(text, F.lit(f"({ITEM})"), 1), lambda x: F.when(x.rlike("^['\"]"), joined(x)).otherwise(x))
    # Three quotes in a row may open a long string, in which quotes mean something else.
    return F.when(text.rlike(LITERAL) & ~text.contains("'''") & ~text.contains('"""'), items)


def parse_list(text: Column) -> Column:
    """A text that is one list literal, and nothing else, as array<string> of its items as str() shows them; else null. Python
    reads only those that begin like a list and that plain_list can't decide."""
    quick = plain_list(text)
    rest = F.when(quick.isNull() & text.rlike(r"^[ \t\n\r\f]*+[\[(#]"), text)
    return F.coalesce(quick, F.when(rest.isNotNull(), literal_list(rest)))


def parse_list_builtin(text: Column) -> Column:
    """The same without Python; lists with numbers other than whole ones, nested values or uncommon escapes are null."""
    return plain_list(text)


def json_items(text: Column) -> Column:
    """The items of a JSON list as text, null ones left out; null if the text is no such list."""
    items = F.try_variant_get(whole_json(text), "$", "array<variant>")
    return F.transform(F.filter(items, lambda v: ~F.is_variant_null(v)), lambda v: F.try_variant_get(v, "$", "string"))


def parse_tags_either(text: Column, parse=parse_list) -> Column:
    """struct<tags, ok>: a JSON list, else a list literal; null and None leave, and what is left makes it ok."""
    literal = F.filter(parse(text), lambda x: x != "None")
    got = F.coalesce(json_items(text), literal, array_of([]))
    return F.struct(got.alias("tags"), (F.size(got) > 0).alias("ok"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++|\s++\z", "")


def unfence(text: Column) -> Column:
    """Stripped, and without a code fence: its first line (if it has others) and its closing marks."""
    t = stripped(text)
    return F.when(t.startswith("```"), stripped(F.regexp_replace(F.regexp_replace(t, r"^[^\n]*+\n", ""), r"```\z", ""))).otherwise(t)


def parse_model_output(text: Column, parse=parse_list) -> Column:
    """struct<tags, ok>: the empty list is a valid answer; what is no list is not, and gives no tags."""
    got = parse(unfence(text))
    return F.struct(F.coalesce(normalize_tags(got), array_of([])).alias("tags"), got.isNotNull().alias("ok"))


def parse_structured_output(text: Column, allowed: Column) -> Column:
    """struct<tags, ok> of a JSON object, and nothing else, with a list `tags`; a tag outside `allowed` voids the answer, and so
    do null and nested values, which are no tags of any taxonomy."""
    show = lambda v: F.when(F.is_variant_null(v), "None").otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("[]")))
    got = F.transform(F.try_variant_get(whole_json(text), "$.tags", "array<variant>"), show)
    tags = normalize_tags(got)
    ok = got.isNotNull() & (F.size(F.array_except(tags, allowed)) == 0)
    return F.struct(F.when(ok, tags).otherwise(array_of([])).alias("tags"), F.coalesce(ok, F.lit(False)).alias("ok"))


def over(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def compare_tags(expected: Column, generated: Column) -> Column:
    """struct of correct, missing and extra tags, precision, recall, F1 (0 where undefined) and exact_match."""
    correct, n = F.array_sort(F.array_intersect(expected, generated)), F.size
    p, r = over(n(F.array_intersect(expected, generated)), n(generated)), over(n(F.array_intersect(expected, generated)), n(expected))
    return F.struct(
        correct.alias("correct"),
        F.array_sort(F.array_except(expected, generated)).alias("missing"),
        F.array_sort(F.array_except(generated, expected)).alias("extra"),
        p.alias("precision"),
        r.alias("recall"),
        over(2 * n(F.array_intersect(expected, generated)), n(expected) + n(generated)).alias("f1"),
        (F.array_sort(expected) == F.array_sort(generated)).alias("exact_match"),
    )


def majority_vote(voters: list[Column], labels: Column, least: int = 2) -> Column:
    """Labels with at least so many votes, in the order of `labels`; other tags are ignored."""
    votes = lambda t: sum((F.coalesce(F.array_contains(v, t), F.lit(False)).cast("int") for v in voters), F.lit(0))
    return F.filter(labels, lambda t: votes(t) >= least)


def project_tags(tags: Column, keep: Column) -> Column:
    """Tags that are in `keep`, in their own order."""
    return F.filter(tags, lambda t: F.array_contains(keep, t))


def n_outside(tags: Column, labels: Column) -> Column:
    return F.size(F.array_except(tags, labels))

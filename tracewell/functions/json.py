"""JSON texts as VARIANT: strict parsing, and checks compiled from a JSON Schema document."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = r'"(?:[^"\\]|\\.)*+"'
SCALAR = rf"(?s)^[ \t\r\n]*+(?:{STRING}|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null)[ \t\r\n]*+\z"


def one_value(text: Column) -> Column:
    """Whether nothing but white space surrounds the first JSON value of a text. The parsers end at that value's end, so it is
    told from the brackets outside of strings: they close once, at the end."""
    bare = F.regexp_replace(text, f"(?s){STRING}", '""')
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))

    def step(state, mark):
        depth = state["depth"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (state["closed"] + F.when((mark != "") & (depth == 0), 1).otherwise(0)).alias("closed"))

    end = F.aggregate(marks, start, step)
    return F.when(text.rlike(r"^[ \t\r\n]*+[\[{]"), bare.rlike(r"[\]}][ \t\r\n]*+\z") & (end["depth"] == 0) & (end["closed"] == 1)).otherwise(text.rlike(SCALAR))


def whole_json(text: Column) -> Column:
    """A text that is one JSON value as VARIANT, else null. Objects that repeat a key, and NaN, aren't JSON here."""
    return F.when(one_value(text), F.try_parse_json(text))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def kind(value: Column) -> Column:
    """JSON Schema's type of a VARIANT: string, integer, number, boolean, null, array or object. 1.0 is an integer."""
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
        .when((name == "BIGINT") | (number == F.floor(number)), "integer").otherwise("number")
    )


def failures(value: Column, schema: dict | bool, path: Column, root: dict | None = None, seen: tuple = ()) -> Column:
    """Paths and rules that a VARIANT breaks, as array<string>, in the order of the rules; empty if it fits the schema.

    Rules: type, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern,
    required, properties, additionalProperties, minProperties, maxProperties, items, minItems, maxItems, uniqueItems,
    allOf, anyOf, oneOf, not, and $ref to the document's own definitions. A rule that isn't among these is an error,
    and so is a definition that contains itself: a plan has a fixed depth."""
    none = F.array().cast("array<string>")
    if schema is True or schema == {}:
        return none
    if schema is False:
        return F.array(F.concat(path, F.lit(": not allowed")))
    root = schema if root is None else root
    if "$ref" in schema:
        name = schema["$ref"]
        if name in seen or not name.startswith("#/"):
            raise ValueError(f"{name}: only references to definitions that don't contain themselves")
        target = reduce(lambda d, k: d[k.replace("~1", "/").replace("~0", "~")], name[2:].split("/"), root)
        return failures(value, target, path, root, (*seen, name))
    unknown = set(schema) - KNOWN
    if unknown:
        raise ValueError(f"no such rule: {sorted(unknown)}")

    below = lambda v, s, p: failures(v, s, p, root, seen)

    def checks(v: Column) -> Column:
        return let(kind(v), lambda k: F.concat(none, *rules(v, k)))

    def rules(v: Column, k: Column) -> list[Column]:
        out: list[Column] = []
        told = lambda what: F.concat(path, F.lit(f": {what}"))
        must = lambda ok, what: out.append(F.when(~F.coalesce(ok, F.lit(False)), F.array(told(what))).otherwise(none))
        only = lambda names, ok: ~k.isin(*names) | F.coalesce(ok, F.lit(False))
        same = lambda w: F.coalesce(canonical(v) == F.lit(canonical_text(w)), F.lit(False))
        if "type" in schema:
            types = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            must(k.isin(*types, *(["integer"] if "number" in types else [])), f"not {' or '.join(types)}")
        if "enum" in schema:
            must(reduce(lambda a, b: a | b, map(same, schema["enum"]), F.lit(False)), "not one of the values")
        if "const" in schema:
            must(same(schema["const"]), "not the value")
        number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        numbers = {"minimum": lambda x: number >= x, "maximum": lambda x: number <= x, "exclusiveMinimum": lambda x: number > x, "exclusiveMaximum": lambda x: number < x, "multipleOf": lambda x: number / x == F.round(number / x)}
        texts = {"minLength": lambda x: F.char_length(text) >= x, "maxLength": lambda x: F.char_length(text) <= x, "pattern": lambda x: text.rlike(x)}
        for rule, test in numbers.items():
            if rule in schema:
                must(only(("integer", "number"), test(schema[rule])), f"breaks {rule}")
        for rule, test in texts.items():
            if rule in schema:
                must(only(("string",), test(schema[rule])), f"breaks {rule}")
        if OBJECT_RULES & set(schema):
            out.append(F.when(k == "object", let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: of_object(m))).otherwise(none))
        if ARRAY_RULES & set(schema):
            out.append(F.when(k == "array", let(F.try_variant_get(v, "$", "array<variant>"), lambda a: of_array(a))).otherwise(none))
        for s in schema.get("allOf", []):
            out.append(below(v, s, path))
        fits = lambda s: (F.size(below(v, s, path)) == 0).cast("int")
        for rule, test in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
            if rule in schema:
                must(test(reduce(lambda a, b: a + b, map(fits, schema[rule]), F.lit(0))), f"breaks {rule}")
        if "not" in schema:
            must(fits(schema["not"]) == 0, "breaks not")
        return out or [none]

    def of_object(m: Column) -> Column:
        parts = [none]
        for name in schema.get("required", []):
            parts.append(F.when(~F.map_contains_key(m, name), F.array(F.concat(path, F.lit(f".{name}: missing")))).otherwise(none))
        for name, s in schema.get("properties", {}).items():
            parts.append(F.when(F.map_contains_key(m, name), below(m[name], s, F.concat(path, F.lit(f".{name}")))).otherwise(none))
        if schema.get("additionalProperties", True) is not True:
            more = F.array_except(F.map_keys(m), F.array(*map(F.lit, schema.get("properties", {}))) if schema.get("properties") else F.array().cast("array<string>"))
            parts.append(F.flatten(F.transform(F.array_sort(more), lambda n: below(F.element_at(m, n), schema["additionalProperties"], F.concat(path, F.lit("."), n)))))
        for rule, test in (("minProperties", lambda n, x: n >= x), ("maxProperties", lambda n, x: n <= x)):
            if rule in schema:
                parts.append(F.when(~test(F.size(m), schema[rule]), F.array(F.concat(path, F.lit(f": breaks {rule}")))).otherwise(none))
        return F.concat(*parts)

    def of_array(a: Column) -> Column:
        parts = [none]
        tests = {"minItems": lambda x: F.size(a) >= x, "maxItems": lambda x: F.size(a) <= x, "uniqueItems": lambda x: F.size(F.array_distinct(F.transform(a, canonical))) == F.size(a) if x else F.lit(True)}
        for rule, test in tests.items():
            if rule in schema:
                parts.append(F.when(~test(schema[rule]), F.array(F.concat(path, F.lit(f": breaks {rule}")))).otherwise(none))
        if "items" in schema:
            parts.append(F.flatten(F.transform(a, lambda x, i: below(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        return F.concat(*parts)

    return let(value, checks)


OBJECT_RULES = {"required", "properties", "additionalProperties", "minProperties", "maxProperties"}
ARRAY_RULES = {"items", "minItems", "maxItems", "uniqueItems"}
KNOWN = OBJECT_RULES | ARRAY_RULES | set("type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern allOf anyOf oneOf not".split())
#: Rules that say nothing about a value.
KNOWN |= set("$schema $id $defs definitions title description default examples format $comment".split())


def canonical(value: Column) -> Column:
    """A text that two equal JSON values share: VARIANT sorts keys and drops white space; whole numbers lose their fraction."""
    number = F.try_variant_get(value, "$", "double")
    numeric = ~F.schema_of_variant(value).rlike("^(STRING|BOOLEAN|VOID|ARRAY|OBJECT)")
    return F.when(numeric & (number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("long").cast("string")).otherwise(F.to_json(value))


def canonical_text(value: object) -> str:
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def schema_failure(text: Column, schema: dict) -> Column:
    """Why a text isn't JSON of the schema, null if it is: 'missing text' (null), 'invalid JSON' (blank, anything beside one
    value), or the first rule that it breaks with its place, such as `$.tags[1]: not string`."""
    value = whole_json(text)
    return F.when(text.isNull(), "missing text").otherwise(let(value, lambda v: F.when(v.isNull(), "invalid JSON").otherwise(F.get(failures(v, schema, F.lit("$")), F.lit(0)))))

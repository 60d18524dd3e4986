"""List literals against Python's own reading, JSON against json.loads, and rules of JSON Schema one by one."""

import ast
import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from tracewell.functions import json as js
from tracewell.functions import labels as lb

LITERALS = [
    "['a'] trailing", "['a']", "[]", "[ ]", "[,]", "['a',]", "[True, None]", '["a" "b"]', "['a', \"b'c\"]", "['a\\'b', 'c\\\\n', 'd\\n']", "[1, -2, 0, 1.5, -0]", "[['a'], {'b': 1}]", "('a',)", "(['a'])", "#x\n['a']",
    "['''a''b''']", "[r'a\\n']", "['\\x41', '\\u00e9']", "['a'\n,\t'b' ]", "\n['a']\n", " ['a']", "[a]", "['a'", "['a']]", "['a'], ['b']", "[01]", "[1_000]", "", "x", "['a' 1]", "[None, 'None']", "['á ß']",
    "['a\x0b']", "[\x0b'a']", "['a'] # c", "[b'a']", "['a\\", "[true]", "[1,,2]", "['" + "a', '" * 20_000 + "']", '[""]', "[''  'x']", "['a\r\nb']", "['a']['b']", "['a'] + ['b']", "{'a'}", "null",
]


def test_list_literals(spark):
    rnd = random.Random(1)
    parts = ["[", "]", "'", '"', ",", "a", " ", "\\", "1", "None", "n", "'b'", '"c"', "(", ")", "-"]
    cases = LITERALS + ["[" + "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 7))) + "]" for _ in range(1500)]

    def read(text):
        try:
            value = ast.literal_eval(text)
        except (SyntaxError, ValueError, TypeError):
            return None
        return [str(v) for v in value] if isinstance(value, list) else None

    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", lb.parse_list(F.col("t")), lb.plain_list(F.col("t"))).collect()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text, got, builtin in rows:
            assert got == read(text), text[:100]
            assert builtin is None or builtin == got
    assert sum(builtin is not None for _, _, builtin in rows) > 50


def test_model_output(spark):
    cases = {
        "```\n['A ']\n```": (["a"], True), " ['b', 'a', 'a'] \n": (["a", "b"], True), "['a'] because": ([], False), "```['a']```": ([], False), "[]": ([], True), "[None]": (["none"], True), "{}": ([], False), "```python\n['x']": (["x"], True),
    }
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "t string")
    got = {r["t"]: tuple(r["p"]) for r in df.select("t", lb.parse_model_output(F.col("t")).alias("p")).collect()}
    assert got == cases | {None: ([], False)}


JSONS = ['{"tags":["b2b"]} thanks', '{"tags":["b2b"]}', '{"tags":[null]}', ' {"tags":["b2b"]}\n', '{"tags":["b2b"]},{"tags":[]}', '{"tags":["}"]}', "[1] 2", '"a" b', '"a"', "5", "5 6", "{}{}", '{"a":"\\\\"}', '{"a":"\\""} ', "nul", "null", "true", "", "  ", "[1", '{"a":1}]', "-1.5e3", "01", "1.", '["\\u00e9", {"b":[[]]}]', "[1,]", "{'a':1}", '[[1],[2]] ]', '"' + 'x"' * 3]


def test_whole_json(spark):
    def valid(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(c,) for c in JSONS], "t string").select("t", js.whole_json(F.col("t")).isNotNull()).collect()
    assert {t: ok for t, ok in rows} == {t: valid(t) for t in JSONS}


NESTED = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "required": ["b"], "properties": {"b": {"$ref": "#/$defs/name"}}}}}, "$defs": {"name": {"type": ["string", "null"], "pattern": "^x"}}}
RULES = [
    ({"type": "string"}, ['"a"'], {"1": "$: not string", "null": "$: not string", "{}": "$: not string"}),
    ({"type": "integer"}, ["1", "1.0", "-3", "1e2"], {"1.5": "$: not integer", '"1"': "$: not integer", "true": "$: not integer"}),
    ({"type": ["number", "null"]}, ["1", "1.5", "null"], {"false": "$: not number or null"}),
    ({"enum": ["a", 1, None, {"x": [1]}]}, ['"a"', "1", "1.0", "null", '{"x": [1]}'], {'"b"': "$: not one of the values", '{"x": [2]}': "$: not one of the values"}),
    ({"const": 2.5}, ["2.5"], {"2": "$: not the value"}),
    ({"minimum": 1, "exclusiveMaximum": 3}, ["1", "2.9", '"text"'], {"0": "$: breaks minimum", "3": "$: breaks exclusiveMaximum"}),
    ({"multipleOf": 0.5}, ["1", "1.5"], {"1.2": "$: breaks multipleOf"}),
    ({"minLength": 2, "maxLength": 3, "pattern": "b"}, ['"ab"', "5"], {'"b"': "$: breaks minLength", '"abcd"': "$: breaks maxLength", '"aa"': "$: breaks pattern"}),
    ({"required": ["a"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}, ['{"a":"x"}', "5"], {"{}": "$.a: missing", '{"a":5}': "$.a: not string", '{"a":"x","b":1}': "$.b: not allowed", '{"a":null}': "$.a: not string"}),
    ({"additionalProperties": {"type": "integer"}, "minProperties": 1, "maxProperties": 2}, ['{"a":1}'], {'{"a":"x"}': "$.a: not integer", "{}": "$: breaks minProperties", '{"a":1,"b":2,"c":3}': "$: breaks maxProperties"}),
    ({"items": {"type": "string"}, "minItems": 1, "uniqueItems": True}, ['["a"]', "{}"], {"[]": "$: breaks minItems", '["a",5]': "$[1]: not string", '["a","a"]': "$: breaks uniqueItems"}),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"a"', "6"], {"4": "$: breaks anyOf"}),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, ["0", "4"], {"2": "$: breaks oneOf"}),
    ({"not": {"type": "null"}, "allOf": [{"maximum": 2}]}, ["1"], {"null": "$: breaks not", "3": "$: breaks maximum"}),
    (NESTED, ['{"a":[{"b":"x"},{"b":null}]}', "{}"], {'{"a":[{"b":"x"},{}]}': "$.a[1].b: missing", '{"a":[{"b":5}]}': "$.a[0].b: not string or null", '{"a":[{"b":"y"}]}': "$.a[0].b: breaks pattern", '{"a":{}}': "$.a: not array"}),
    (True, ["1"], {}), ({"not": {}}, [], {"1": "$: breaks not"}),
]


@pytest.mark.parametrize("k", range(len(RULES)))
def test_schema_rules(spark, k):
    schema, good, bad = RULES[k]
    want = dict.fromkeys(good) | bad | {"": "invalid JSON", "1 2": "invalid JSON", None: "missing text"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", js.schema_failure(F.col("t"), schema)).collect()} == want


def test_schemas_that_are_refused():
    for schema in ({"typ": "string"}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "http://elsewhere"}):
        with pytest.raises(ValueError):
            js.failures(F.col("x"), schema, F.lit("$"))

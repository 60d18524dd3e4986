"""Literal cases of the operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import company as co
from tracewell.functions import labels as lb
from tracewell.functions import numbers
from tracewell.functions import text as tx
from tracewell.operators import conversations as cv
from tracewell.operators import datasets as ds
from tracewell.operators import intervals as iv
from tracewell.operators import runs, scoring
from tracewell.operators.latency_model import fit_latency_regressor
from tracewell.sources import tables as io


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_interval_join_and_phases(spark):
    requests = spark.createDataFrame([("exp-1", "request-1", 10.0, 14.0, 11.0, 13.0), ("exp-1", "later", 13.5, 20.0, None, None), ("exp-1", "open", 1.0, None, None, None)], "experiment_id string, request_uid string, start_s double, end_s double, first_s double, last_s double")
    times = [9.9, 10.0, 10.9, 11.0, 13.0, 13.1, 14.0, 14.1, 20.1]
    samples = spark.createDataFrame([("exp-1", k, t, "cpu_ratio", 1.0, "gauge") for k, t in enumerate(times)], "experiment_id string, sample_id int, timestamp_s double, metric string, value double, kind string")
    for width in (1.0, 3600.0):
        got = {r["timestamp_s"]: (r["request_uid"], r["observed_phase"]) for r in iv.interval_join(samples, requests, width).collect()}
        assert got[9.9] == got[20.1] == (None, "outside_request")
        assert [got[t] for t in (10.9, 11.0, 13.0, 13.1, 14.0)] == [("request-1", p) for p in ("prefill_observed", "decode_observed", "decode_observed", "response_close", "response_close")]
        assert got[14.1] == ("later", "request_without_first_content")


def test_interval_join_of_repeated_and_null_ids(spark):
    requests = spark.createDataFrame([("e", "r", 0.0, 10.0, 1.0, 9.0), ("e", "s", 495.0, 499.0, None, None), (None, "n", 0.0, 9e9, None, None)], "experiment_id string, request_uid string, start_s double, end_s double, first_s double, last_s double")
    rows = [("e", 1, 5.0), ("e", 1, 500.0), ("e", None, 5.0), ("e", None, 600.0), ("e", 1, 5.0), (None, 2, 5.0), ("e", 3, None), ("f", 1, 5.0)]
    samples = spark.createDataFrame([(*r, "x") for r in rows], "experiment_id string, sample_id int, timestamp_s double, r string").repartition(3)
    for width in (None, 2.0, 3600.0):
        got = iv.interval_join(samples, requests, width).collect()
        assert sorted((str(r["sample_id"]), str(r["timestamp_s"]), str(r["request_uid"])) for r in got) == sorted((str(i), str(t), "r" if e == "e" and t == 5.0 else "None") for e, i, t in rows)
        assert {r["observed_phase"] for r in got} == {"decode_observed", "outside_request"} and got[0].asDict()["r"] == "x"
    assert iv.interval_join(samples, requests.limit(0)).count() == len(rows)
    assert iv.interval_join(samples.limit(0), requests).collect() == []


def test_phase_metrics(spark):
    rows = [("r", 1, 10.5, "cpu", 0.2, "gauge"), ("r", 2, 11.5, "cpu", 0.6, "gauge"), ("r", 3, 11.0, "disk", 100.0, "counter"), ("r", 4, 13.0, "disk", 300.0, "counter"), (None, 5, 1.0, "cpu", 9.0, "gauge")]
    df = spark.createDataFrame(rows, "request_uid string, sample_id int, timestamp_s double, metric string, value double, kind string")
    got = {r["metric"]: r for r in iv.phase_metrics(df, ["request_uid", "metric"]).collect()}
    assert (got["cpu"]["mean"], got["cpu"]["rate_mean"], got["cpu"]["max"]) == (pytest.approx(0.4), None, 0.6)
    assert (got["disk"]["mean"], got["disk"]["delta"], got["disk"]["rate_mean"]) == (None, 200.0, 100.0)


def test_numbers(spark):
    text = spark.createDataFrame([("1.5",), (" 2 ",), ("NaN",), ("inf",), ("x",), (None,)], "t string")
    assert [r[0] for r in text.select(numbers.to_number(F.col("t"))).collect()] == [1.5, 2.0, None, None, None, None]
    bands = spark.createDataFrame([(511,), (512,), (2077,), (16384,), (None,)], "n int")
    assert [r[0] for r in bands.select(numbers.context_band(F.col("n"))).collect()] == ["[0, 512)", "[512, 1024)", "[2048, 4096)", "[16384, +∞)", None]
    assert one(spark, numbers.usage_cost(F.lit(1000), F.lit(200), F.lit(100)))[0] == pytest.approx(0.000081)


def test_labels(spark):
    tags = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, lb.compare_tags(lb.normalize_tags(tags("b2b", "produto")), lb.normalize_tags(tags("B2B ", "Serviço", "b2b"))))[0]
    assert (got["f1"], got["exact_match"], got["missing"], got["extra"]) == (0.5, False, ["produto"], ["serviço"])
    empty = one(spark, lb.compare_tags(lb.array_of([]), lb.array_of([])))[0]
    assert (empty["f1"], empty["exact_match"]) == (0.0, True)
    cases = {"['a', \"b\"]": (["a", "b"], True), "```python\n['x']\n```": (["x"], True), "[]": ([], True), "none": ([], False), None: ([], False), "['a',]": (["a"], True), "[True, None]": (["none", "true"], True), "{'a': 1}": ([], False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: (r["p"]["tags"], r["p"]["ok"]) for r in df.select("t", lb.parse_model_output(F.col("t"), lb.parse_list).alias("p")).collect()} == cases
    assert one(spark, lb.majority_vote([tags("b", "z"), tags("a", "b", "z"), tags("a")], tags("a", "b", "c")))[0] == ["a", "b"]
    assert one(spark, lb.parse_structured_output(F.lit('{"tags":["b2b","zz"]}'), lb.array_of(lb.TAXONOMY)))[0]["ok"] is False


def test_macro_f1_counts_seen_labels(spark):
    df = spark.createDataFrame([("g", ["a"], ["a", "b"]), ("g", ["c"], []), ("none", [], []), (None, ["a"], ["a"])], "k string, expected array<string>, generated array<string>")
    got = {r["k"]: r["macro_f1"] for r in scoring.macro_f1(df, ["k"]).collect()}
    assert got == {"g": pytest.approx(1 / 3), None: 1.0}


def test_text(spark):
    assert one(spark, tx.normalize_domain(F.lit(" HTTPS://www.Site.com.br/a?b ")), tx.slug(F.lit(" São Paulo & Co! ")), tx.slug(F.lit("Ǆ ﬁn"), exact=True)) == ("site.com.br", "sao-paulo-co", "dz-fin")
    assert one(spark, tx.normalize_text(F.lit("a  b\r\n\r\n \tc\rd ")))[0] == "a b\nc\nd"
    utc = one(spark, tx.parse_utc(F.lit("20260922T101112.500000Z")), tx.parse_utc(F.lit("2026-09-22T10:11:12")), tx.parse_utc(F.lit("nope")))
    assert utc == (datetime.datetime(2026, 9, 22, 10, 11, 12, 500000), datetime.datetime(2026, 9, 22, 10, 11, 12), None)
    a = one(spark, tx.model_attributes(F.lit("fam:14b-instruct-q8_0"), F.lit(None).cast("string"), F.lit(None).cast("string")))[0]
    assert (a["parameters_b"], a["quantization"]) == (14.0, "q8_0")
    tags = one(spark, tx.run_tags(F.lit("Qwen2.5-q4_k_m"), F.lit("Ollama"), F.lit("short"), F.lit("measure"), F.lit(""), F.lit("120"), F.lit(""), F.lit("0"), F.lit("")))[0]
    assert "runtime:ollama" in tags and "quantization:q4|" in tags and "performance:ttft-fast" in tags and "context:short" in tags
    argv = F.array(*map(F.lit, ("--token", "--password", "x=S", "--api-key=9", "S")))
    assert one(spark, tx.redact_argv(argv, F.lit("S")))[0] == ["--token", "[REDACTED]", "x=[REDACTED]", "--api-key=[REDACTED]", "[REDACTED]"]
    assert one(spark, tx.canonical_any(F.lit('{"b": [1, null], "a": "é"}')))[0] == '{"a":"é","b":[1,null]}'


def test_company_envelopes(spark):
    flat = '{"cnpj":"1","payload":"{\\"company_tags\\":[],\\"mopep\\":{\\"company_tags\\":[\\"SaaS\\",\\"saas\\",\\"B2B\\"]},\\"tags\\":[\\"Technology\\"],\\"business_model\\":\\"B2B SaaS\\",\\"is_ecommerce\\":\\"nao\\"}"}'
    nested = '{"data":{"company":{"identity":{"name":"N"},"digitalPresence":{"socialMedia":{"instagram":"u"}},"businessIntelligence":{"estimated":{"segment":"Ecommerce"}},"scores":{"porte":{"category":"Micro"}}}}}'
    df = co.company_normalize(spark.createDataFrame([(1, flat), (2, nested), (3, None), (4, "{bad")], "k int, record string"))
    got = {r["k"]: r for r in df.select("k", "company", co.company_tags(F.col("company")).alias("tags")).collect()}
    assert got[1]["company"]["tags"] == ["Technology", "SaaS", "B2B"] and got[1]["company"]["is_ecommerce"] is False
    assert "business-model:b2b-saas" in got[1]["tags"] and "ecommerce:false" in got[1]["tags"]
    assert got[2]["company"]["is_ecommerce"] is True and got[2]["company"]["company_size"] == "Micro" and "channel:instagram" in got[2]["tags"]
    assert got[3]["company"]["company_id"] == got[4]["company"]["company_id"] == ""
    canvas = {r["company_id"]: r for r in co.canvas_table(df).collect()}
    assert canvas["1"]["customer_segments"].startswith("Empresas (") and canvas["1"]["evidence_coverage"] == 0.25
    assert canvas[""]["key_partners"] == co.UNKNOWN


def test_company_containers_as_text(spark):
    import json

    inner = {
        "name": "N",
        "identity": json.dumps({"description": "d", "receitaFederal": json.dumps({"mainCnae": "62"})}),
        "technologies": "['Spark', None, ' spark ', 'Flink', True]",
        "tags": '["a", null, ""]',
        "cb_tags": "lone",
        "mopep": {"x": 1},
        "scores": {"mopep": {"business_model": "B2C", "company_tags": ["no"]}, "porte": {"category": "Micro"}},
        "company_size": {},
        "employees": 0,
        "businessIntelligence": "{'employees': 7, 'competitors': ['X'], 'estimated': None}",
        "digital_presence": {"domain_details": {"hasBlog": "Sim"}, "social_media": {"twitterX": "", "twitter_x": "t"}},
    }
    rows = [(1, json.dumps({"data": json.dumps({"company": inner})})), (2, json.dumps({"domain": "o", "segment": "outer", "payload": {"segment": None, "name": "P"}})), (3, json.dumps({"company": {}, "domain": "x", "payload": "{}"}))]
    got = {r["k"]: r["company"] for r in co.company_normalize(spark.createDataFrame(rows, "k int, record string")).collect()}
    c = got[1]
    assert (c["name"], c["description"], c["main_cnae"], c["business_model"], c["company_size"], c["employees"]) == ("N", "d", "62", None, "Micro", "7")
    assert (c["technologies"], c["tags"], c["competitors"]) == (["Spark", "Flink", "true"], ["a", "lone"], ["X"])
    assert c["has_blog"] is True and c["social_media"]["twitter_x"] == "t" and c["company_id"] == "N"
    assert (got[2]["company_id"], got[2]["name"], got[2]["segment"]) == ("o", "P", None)
    assert got[3]["domain"] == "x"


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(str(k), f"t{k % 40}", ["short", "medium", "heavy"][k % 3]) for k in range(300)], "id string, h string, bucket string")
    pick = lambda d, seed: [r["id"] for r in ds.stratified_hash_sample(d, 4, seed).orderBy("position", "bucket_order").collect()]
    assert pick(df, "42") == pick(df.orderBy(F.desc("id")).repartition(7), "42") != pick(df, "43")
    assert len(pick(df, "42")) == 12
    assert [r["bucket"] for r in ds.short_buckets(df, 101).orderBy("bucket").collect()] == ["heavy", "medium", "short"]
    assert ds.group_split(df, "h").groupBy("h").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    first = [r["id"] for r in ds.hash_ranked_sample(df, 10, "s", "id").collect()]
    assert first == [r["id"] for r in ds.hash_ranked_sample(df.repartition(5), 10, "s", "id").collect()]
    ordered = scoring.row_ordinals(df.repartition(5), ["id"]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in ordered] == list(range(300)) and [r["id"] for r in ordered] == sorted(str(k) for k in range(300))


def test_golden_errors(spark):
    df = spark.createDataFrame([("a", "x", ["b2b"]), ("b", " ", ["b2b", "b2b"]), ("c", "x", ["zz", ""]), ("c", "x", []), (None, "x", None), ("ok", "x", [])], "id string, text string, tags array<string>")
    got = sorted((r["id"] or "", tuple(r["reasons"])) for r in ds.golden_errors(df, lb.TAXONOMY).collect())
    assert got == sorted([("b", ("blank text", "duplicate tag")), ("c", ("duplicate id", "empty tag", "unknown tag")), ("c", ("duplicate id",)), ("", ("blank id", "tags are no list"))])


def test_alias_by_group(spark):
    df = spark.createDataFrame([("a", "ok", None, 2.0), ("a", "completed", None, 4.0), ("b", "ok", 7.0, 1.0), ("b", "ok", None, 3.0), ("b", "weird", 1.0, 1.0)], "k string, status string, time_to_first_token_ms double, time_to_first_token_seconds double")
    got = {r["k"]: r for r in runs.experiment_summary(df, ["k"]).collect()}
    assert (got["a"]["ttft_ms_mean"], got["a"]["ttft_ms_source"], got["a"]["ok"]) == (3000.0, "time_to_first_token_seconds", 2)
    assert (got["b"]["ttft_ms_mean"], got["b"]["ttft_ms_n"], got["b"]["unknown"], got["b"]["decode_tokens_s_n"]) == (7.0, 1, 1, 0)


def test_summaries_and_tables(spark, tmp_path):
    for folder, text in (("run-1/csv", "runtime,model\nollama,q4\n"), ("run-2", "model,extra\nm,1\n")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "summary.csv").write_text(text)
    got = {r["experiment_id"]: r for r in io.read_summaries(spark, str(tmp_path)).collect()}
    assert (got["run-1"]["runtime"], got["run-1"]["extra"], got["run-2"]["extra"]) == ("ollama", "", "1")
    assert io.read_summaries(spark, str(tmp_path)).count() == 2
    for k, text in enumerate(['\ufeffa,"b ""q"""\n"x\ny",1\n\n,2\n', "a,a,extra\n1,2\n", "only,head\n", ""]):
        (tmp_path / f"odd/run-{k}").mkdir(parents=True)
        (tmp_path / f"odd/run-{k}/summary.csv").write_text(text)
    odd = io.read_summaries(spark, str(tmp_path / "odd"))
    assert odd.columns == ["source_file", "experiment_id", "a", 'b "q"', "extra", "head", "only"]
    assert sorted(tuple(r)[1:] for r in odd.collect()) == [("run-0", "", "2", "", "", ""), ("run-0", "x\ny", "1", "", "", ""), ("run-1", "2", "", "", "", "")]
    with pytest.raises(Exception):
        io.read_summaries(spark, str(tmp_path / "none")).collect()
    (tmp_path / "r/json").mkdir(parents=True)
    (tmp_path / "r/json/manifest.json").write_text("{bad")
    (tmp_path / "r/json/dataset-manifest.json").write_text('{\n  "a": 1\n}')
    assert {(r["run"], r["kind"], r["error"]) for r in io.read_manifests(spark, str(tmp_path / "r")).collect()} == {("r", "manifest", "invalid JSON"), ("r", "dataset-manifest", None)}
    (tmp_path / "x.json").write_text('{"records": [{"cnpj": "1"}, {"cnpj": "2"}]}')
    assert io.read_company_export(spark, str(tmp_path / "x.json")).count() == 2
    (tmp_path / "y.json").write_text('[\n  {"cnpj": "1"},\n  {"cnpj": "2"}\n]')
    assert [r["record"] for r in io.read_company_export(spark, str(tmp_path / "y.json")).collect()] == ['{"cnpj":"1"}', '{"cnpj":"2"}']
    df = spark.createDataFrame([(1, ["é", "b"], "s")], "id int, tags array<string>, split string")
    io.write_table(df, str(tmp_path / "out"), parquet=True)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out/csv")).first()["tags"] == '["é","b"]'
    io.write_by_split(df, str(tmp_path / "split"))
    io.write_lines(io.message_lines(df, ["id", "tags"]), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == '{"id":1,"tags":["é","b"]}'
    assert io.read_jsonl(spark, str(tmp_path / "lines")).first()["reasons"][0] == "blank request_id"


def test_redact_json(spark):
    def hidden(text, secret=None):
        return spark.createDataFrame([(text, secret)], "d string, s string").select(tx.redact_json("d", "s")).first()[0]

    assert hidden('{"a": {"Auth-Token": [1]}, "b": ["--token", "--token", "token"]}') == '{"a":{"Auth-Token":"[REDACTED]"},"b":["--token","[REDACTED]","token"]}'
    assert hidden('["x=S", ["password", {"q": 1}, 2.5, null]]', "S") == '["x=[REDACTED]",["password","[REDACTED]",2.5,null]]'
    assert (hidden("{oops"), hidden(None), hidden("7"), hidden('"é"'), hidden('"token=1"')) == (None, None, "7", '"é"', '"token=1"')
    assert hidden('["--token", "token=S", "by S", {"S": "S", "secret": null}]', "S") == '["--token","[REDACTED]","by [REDACTED]",{"S":"[REDACTED]","secret":"[REDACTED]"}]'
    deep = '{"a":' * 300 + '["token","x"]' + "}" * 300
    assert hidden(deep) == deep.replace('"x"', '"[REDACTED]"')


def test_run_inventory(spark):
    rows = [("a", "manifest", "{bad", "invalid JSON"), ("b", "dataset-manifest", '{"status": "complete"}', None), ("b", "manifest", '{"run": {"status": "FAILED"}}', None)]
    found = spark.createDataFrame([], "run string, reasons array<string>")
    got = {r["run"]: r for r in runs.run_inventory(spark.createDataFrame(rows, "run string, kind string, document string, error string"), found).collect()}
    assert (got["a"]["status"], got["a"]["reasons"]) == ("unknown", ["declared manifest is missing", "manifest is no JSON"])
    assert (got["b"]["status"], got["b"]["integrity_ok"], got["b"]["included"], got["b"]["exclusion_reasons"]) == ("failed", True, False, '["status=failed"]')
    assert got["a"]["comparison_id"] != got["b"]["comparison_id"] and len(got["b"]["identity_missing"]) == len(runs.CONTROLS)


def test_latency_model(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).cast("string").alias("runtime"), (F.col("id") % 17).alias("tokens"), ((F.col("id") % 17) * 2.0 + (F.col("id") % 3) * 50).alias("y"))
    _, scores = fit_latency_regressor(df, "y", ["runtime", "absent"], ["tokens"], "id", trees=20)
    rows = scores.collect()
    assert {r["model"] for r in rows} == {"random_forest", "boosted_trees"} and sum(r["best"] for r in rows) == 1
    assert max(r["r2"] for r in rows) > 0.9
    with pytest.raises(ValueError):
        fit_latency_regressor(df.limit(5), "y", ["runtime"], ["tokens"], "id")


def test_prompts_of_a_long_conversation(spark, tmp_path):
    from tracewell.plans import QUERIES

    rows = [(1, 0, "system", "rule")] + [(1, k, "user" if k % 2 else "assistant", "ab") for k in range(1, 1206)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: (r["n"], r["chars"]) for r in QUERIES["w9_conversation_prompts"](spark, str(tmp_path)).where("form = 'replay'").collect()}
    assert got == {k: (k + 1, 4 + 2 * k) for k in range(1, 1206, 2)}
    last = lambda **a: cv.conversation_prompts(turns, **a).where("turn = 1205").first()["messages"]
    assert len(last()) == 1206 and len(last(most=3)) == 5


def test_sample_digests_gather_no_lists(spark):
    import hashlib

    rows = [(f"m{k % 2}" if k % 5 else None, f"{k:05}", f"line {k}", f"2024-01-{k % 28 + 1:02}") for k in range(25_000)]
    got = {r["run_id"]: (r["n"], r["created"], r["sha"]) for r in runs.sample_digests(spark.createDataFrame(rows, "run_id string, example_id string, line string, day string")).collect()}
    parts = {m: [r for r in rows if r[0] == m] for m in ("m0", "m1", None)}
    assert got == {m: (len(p), min(r[3] for r in p), hashlib.sha256("\n".join(r[2] for r in p).encode()).hexdigest()) for m, p in parts.items()}


def test_percentiles_equal_the_built_in(spark):
    import random

    from tracewell.operators.percentiles import percentiles, with_percentiles

    rnd = random.Random(8)
    values = [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, 5.0, 5.0, float("nan"), float("inf"), None]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(values) if rnd.random() < 0.2 else rnd.gauss(0, 10) ** 3) for _ in range(2000)] + [("one", 7.0), ("none", None)] + [("flat", 3.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    points = [0.0, 0.25, 0.5, 0.95, 1.0]
    fin = numbers.finite(F.col("v"))
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile(fin, F.array(*map(F.lit, points))).alias("p")).collect()}
    got = {r["k"]: r["p"] for r in percentiles(df, ["k"], {"x": F.col("v")}, points).collect()}
    assert set(got) == {"a", "b", None, "one", "flat"}
    for k, p in got.items():
        assert p == pytest.approx(want[k], rel=1e-12), k
    wide = {r["k"]: (r["x_n"], r["x_p50"]) for r in with_percentiles(df.select("k").distinct(), df, ["k"], {"x": F.col("v")}, (0.5,)).collect()}
    assert wide["none"] == (0, None) and wide["flat"] == (50, 3.0) and set(wide) == {r[0] for r in rows}

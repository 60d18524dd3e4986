"""Chat formatting: spans of several templates, rewriting ones, escapes."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import chat, queries
from tracewell.llm.shared import table


@given(st.text(alphabet="<|\\>ab\n", max_size=30))
def test_escape_round_trip(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), st.text(alphabet="<|im_end>\\a \n", max_size=12)), max_size=6))
def test_spans(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    out, spans, rewrites = chat.locate(messages, chat.marked)
    assert out == chat.marked(messages) and not rewrites
    assert "".join(out[s["start"] : s["end"]] for s in spans) == out
    assert [chat.unescape(out[s["text_start"] : s["text_end"]]) for s in spans] == [t for _, t in turns]


def test_rewriting_templates_are_found():
    def last_only(messages):
        return "".join(("> " if k < len(messages) - 1 else "* ") + m["text"] + "\n" for k, m in enumerate(messages))

    def dropping(messages):
        return "".join(m["text"] + "|" for m in messages[-2:])

    messages = [{"role": "user", "text": t} for t in ("one", "two", "three")]
    for template in (last_only, dropping):
        out, spans, rewrites = chat.locate(messages, template)
        assert rewrites and out == template(messages)
        assert spans[-1]["text_start"] == -1
    upper = lambda ms: "".join(f"[{m['text']}]" for m in ms)
    assert not chat.locate(messages, upper)[2]


def test_long_conversations_in_windows():
    """Windows give what whole prefixes give; a template that they don't fit is rendered by prefixes."""
    messages = [{"role": "user" if k % 2 else "assistant", "text": f"t{k} <|x|>" * (k % 3)} for k in range(150)]
    numbered = lambda ms: "BEGIN" + "".join(f"({m['role']}: {m['text']})" + ("" if k else " first ") for k, m in enumerate(ms))
    for template in (chat.marked, numbered):
        assert chat.locate(messages, template) == chat.locate(messages, template, window=0)
    assert chat.by_windows(messages, chat.marked, 16)
    counted = lambda ms: "".join(f"{k}:{m['text']};" for k, m in enumerate(ms))
    closing = lambda ms: "".join(m["text"] for m in ms) + "."
    long_ago = lambda ms: "".join(m["text"] + ("!" if k >= 40 and ms[k - 40]["text"] else "") for k, m in enumerate(ms))
    for template in (counted, closing, long_ago):
        assert chat.by_windows(messages, template, 16) is None
        assert chat.locate(messages, template) == chat.by_prefixes(messages, template)


def test_work_grows_with_turns():
    seen = [0]

    def template(messages):
        seen[0] += len(messages)
        return chat.marked(messages)

    work = []
    for n in (1000, 4000):
        seen[0] = 0
        chat.locate([{"role": "user", "text": str(k)} for k in range(n)], template)
        work.append(seen[0])
    assert work[1] < 5 * work[0]


def test_edges(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>", "x"), (1, 0, "user", "a", "x"), (2, 0, None, None, None), (None, 0, "user", "n", "x"), (3, None, "assistant", "late", "x"), (3, 0, "user", "y" * 70_000, "x"), (3, 0, "user", "y" * 70_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).withColumn("loss", chat.trained_text(F.col("formatted"), F.col("turns"))).collect()}
    assert got[1]["formatted"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<\\|im_end|><|im_end|>\n"
    assert {k: (len(r["turns"]), r["loss"], r["rewrites"]) for k, r in got.items()} == {1: (2, "b<|im_end|>", False), 2: (1, "", False), None: (1, "", False), 3: (3, "late", False)}
    assert chat.format_conversations(df.limit(0)).collect() == []
    named = chat.format_conversations(spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "user", "y")], "conv_id string, turn long, role string, text string"))
    assert {r["conv_id"] for r in named.collect()} == {"a", "b"}


def test_query(spark, sf_dir):
    convs = {-1: [(0, "user", queries.NOTE), (1, "assistant", queries.NOTE)]}
    for r in table(spark, sf_dir, "conversations").collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for k, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        text = chat.marked([{"role": r, "text": t} for _, r, t in turns])
        want[k] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(text))
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op9_chat_format(spark, sf_dir).collect()} == want


def test_length_switches_nothing(spark):
    """A template that rewrites history at one number of turns only is told so in conversations of any length."""

    def once(messages):
        return "".join(m["text"] + ";" for m in messages) + ("!" if len(messages) == 43 else "")

    rows = [(n, k, "user", f"t{k}") for n in (42, 43, 64, 65, 150) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df, once).collect()}
    assert {n: r["rewrites"] for n, r in got.items()} == {42: False, 43: False, 64: True, 65: True, 150: True}
    assert {tuple(r["turns"][:43]) for n, r in got.items() if n >= 43} == {tuple(got[43]["turns"])}
    calls = []
    chat.locate([{"role": "user", "text": "x"}] * 20, lambda ms: calls.append(len(ms)) or chat.marked(ms), 4)
    assert calls.count(20) == 1  # windows, where asked for, are for short ones too

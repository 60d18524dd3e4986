"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of messages to text. Successive prefixes of a conversation are rendered; where the
output for k messages begins with that for k - 1, what follows is the span of turn k. Where it doesn't, the template rewrites
history, and the conversation is marked. A caller may ask for windows, checked against whole prefixes, instead. Inside a span, the place of the text is found by rendering the same prefix with two
probe texts that share no character: what the outputs share at either end stands around the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[dict]], str]
#: Control strings of the template begin with these two characters; in texts, a backslash is put between them, one more
#: than stands there.
OPEN = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
PROBES = ("\ue000", "\ue001")


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text) if "<" in text else text  # most texts have none, and are rendered often


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def marked(messages: list[dict]) -> str:
    """The template of this module: turns between control strings."""
    return "".join(f"<|im_start|>{escape(m['role'])}\n{escape(m['text'])}<|im_end|>\n" for m in messages)


def shared_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def inner_text(one: str, two: str, after: str) -> tuple[int, int] | None:
    """Start and end of a turn's text in `after`, from the outputs with two probes in its place; None where they disagree."""
    head = shared_prefix(one, two)
    tail = shared_prefix(one[head:][::-1], two[head:][::-1])
    end = len(after) - tail
    return (head, end) if head <= end and after[:head] == one[:head] and after[end:] == one[len(one) - tail :] else None


def by_prefixes(messages: list[dict], template: Template) -> tuple[str, list[dict], bool]:
    """locate() on all prefixes as they are; its work grows with the square of their number."""
    before, spans, rewrites = template([]) if messages else "", [], False
    for k, m in enumerate(messages):
        after = template(messages[: k + 1])
        grown = after.startswith(before)
        rewrites |= not grown
        start = len(before) if grown else shared_prefix(before, after)
        found = None if rewrites else inner_text(*(template([*messages[:k], {**m, "text": p}]) for p in PROBES), after)
        if found and found[0] < start:
            found = None
        spans.append({"start": start, "end": len(after), "text_start": found[0] if found else -1, "text_end": found[1] if found else -1})
        before = after
    return before, spans, rewrites


def by_windows(messages: list[dict], template: Template, window: int) -> tuple[str, list[dict], bool] | None:
    """locate() with the last `window` messages in place of each prefix, or None unless that is proven as far as outputs can.

    What a turn adds must be the same after the whole window and after its later half; and the turns' parts, put together,
    must be the whole output of the prefixes of 1, 2, 4, ... turns and of all. The work grows with the number of turns."""
    parts, spans, at, check = [template([])], [], len(template([])), 1
    for k, m in enumerate(messages):
        added = []
        for context in (messages[max(0, k - window) : k], messages[max(0, k - window // 2) : k]):
            before, after = template(context), template([*context, m])
            if not after.startswith(before):
                return None
            added.append(after[len(before) :])
            if len(added) == 1:
                found, shift = inner_text(*(template([*context, {**m, "text": p}]) for p in PROBES), after), at - len(before)
                if found and found[0] < len(before):
                    found = None
        if k > window and added[0] != added[1]:
            return None
        parts.append(added[0])
        spans.append({"start": at, "end": at + len(added[0]), "text_start": found[0] + shift if found else -1, "text_end": found[1] + shift if found else -1})
        at += len(added[0])
        if k + 1 in (check, len(messages)):
            if template(messages[: k + 1]) != "".join(parts):
                return None
            check *= 2
    return "".join(parts), spans, False


def locate(messages: list[dict], template: Template, window: int = 16) -> tuple[str, list[dict], bool]:
    """(output, spans, rewrites): for each message the start and end of its turn and of its text, in code points.

    rewrites: some output doesn't begin with the one before. Then a turn's span begins where the two first differ, earlier
    spans may be out of date, and no text is located (text_start and text_end are -1) from there on.

    window=0 renders every prefix, whose work grows with the square of their number. Else each turn is rendered after the `window`
    messages before it, in conversations of any length alike, which by_windows() checks; a template that fails the checks is rendered
    prefix by prefix after all. (One that rewrites history only at numbers of turns that aren't checked isn't told so.)"""
    return (by_windows(messages, template, window) if window else None) or by_prefixes(messages, template)


ROW = "formatted string, turns array<struct<role string, start long, end long, text_start long, text_end long>>, rewrites boolean"


def format_conversations(df: DataFrame, template: Template = marked, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", window: int = 0) -> DataFrame:
    """id_col, formatted string, turns (role and spans of each turn in formatted), rewrites boolean, one row for each id.

    Rows of an id, of any type that can be ordered, are ordered by turn, equal turns by role and text, null first; repeated rows are
    repeated turns. A null text or role counts as empty; a null id is one conversation. An empty table gives an empty one; other
    columns aren't read.

    One shuffle by id sorts each task's rows, which are then read as a stream with one conversation in memory: its output
    is one text, which needs it whole. Every prefix of every conversation is rendered, so work grows with the square of its turns;
    a window (see locate) makes that linear, and proves less of a template."""
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.null(), pa.string(), pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end"))])), pa.bool_()]
        done: list[list] = []

        def close(conv, messages):
            text, spans, rewrites = locate(messages, template, window)
            done.append([conv, text, [{"role": m["role"], **s} for m, s in zip(messages, spans, strict=True)], rewrites])

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "turns", "rewrites"])

        held, current = [], None
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if held and conv != current:
                    close(current, held)
                    held = []
                    if len(done) >= 500:
                        yield out()
                current = conv
                held.append({"role": role, "text": text})
        if held:
            close(current, held)
        if done:
            yield out()

    return rows.mapInArrow(run, f"conv_id {df.schema[id_col].dataType.simpleString()}, {ROW}").withColumnRenamed("conv_id", id_col)


def trained_text(formatted, turns, role: str = "assistant"):
    """Column: the located texts of one role's turns, read back from the output and unescaped, one after another."""
    cut = F.transform(F.filter(turns, lambda t: (t["role"] == role) & (t["text_start"] >= 0)), lambda t: F.substring(formatted, (t["text_start"] + 1).cast("int"), (t["text_end"] - t["text_start"]).cast("int")))
    return F.array_join(F.transform(cut, unescaped), "")


def unescaped(text):
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")

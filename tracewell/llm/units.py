"""Exact tokenization of many texts by a dictionary of their space-delimited units.

Both public BPE files split a text before merging, and both always split where a single space stands between two
characters that are no white space. So a text is cut there (in Arrow, without Python objects), each distinct unit of
a batch is encoded once, and a text's ids are gathered from its units' ids. Texts in which a space touches other
white space are cut only at the places that are safe.

Distinct units of Latin letters and ASCII signs are joined and merged in one call of a byte-pair engine loaded with
the file's own merges; the ids' byte lengths tell where each unit ends. All other units, and those that could hold a
special token, go through the tokenizers library, as all do where the file's merges can't be expressed as ranks.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any of the regular expression engines at play, for RE2.
WHITE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ADJACENT = f" {WHITE}|{WHITE} "
SAFE_CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
#: Units of characters whose class all the engines agree on; none begins with white space, so they can be joined.
PLAIN = r"^[!-~\x{a1}-\x{24f}][\n\t -~\x{a1}-\x{24f}]*$"
LETTERS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
SIGNS = r"!-/:-@\[-`{-~"
#: The same for a tokenizer that drops white space, and its pre-tokens there, but for contractions.
WORDS = rf"^[\n\t0-9{LETTERS}{SIGNS}]*[0-9{LETTERS}{SIGNS}][\n\t0-9{LETTERS}{SIGNS}]*$"
CONTRACTION = rf"'[{LETTERS}]"
PRETOKEN = rf"[\n\t]*([{LETTERS}]+|[0-9]|[{SIGNS}]+)[\n\t]*"
OPAQUE = "\x02"  # begins a key that is no pre-token but a stretch of text; pre-tokens hold no control characters
END = "\x01"  # stands for the end of a word in the engine; no unit that goes there holds it


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, and the byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: The steps before merging of the two kinds of file for which cuts at a single space are known to be safe.
SPACED = {"normalizer": None, "steps": [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}]}
DROPPED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "steps": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ],
}


def known_kind(spec: dict) -> str:
    """spaced or dropped if the file normalizes and splits exactly as those do, and adds no token that takes in white space
    or parts of words; else whole."""
    pre = spec.get("pre_tokenizer") or {}
    steps = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in pre.get("pretokenizers", [pre]) if x]
    plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) and not re.search(r"\s", x["content"]) for x in spec.get("added_tokens") or [])
    for kind, known in (("spaced", SPACED), ("dropped", DROPPED)):
        if plain and spec["model"].get("type") == "BPE" and spec.get("normalizer") == known["normalizer"] and steps == known["steps"]:
            return kind
    return "whole"


def byte_char(char: str) -> str:
    return next(c for c, b in byte_alphabet().items() if b == ord(char))


class UnitEncoder:
    """Ids of whole texts as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them.

    Nulls count as empty texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: spaced: a unit keeps the space before it. dropped: white space is no part of any token. whole: no cut is known to be safe.
        self.kind = known_kind(spec)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.marks = "|".join(sorted({re.escape(x[:2]) for x in self.special})) or "$^"
        self.vocabulary = pa.array([self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())])
        self.id_type = "<u2" if len(self.vocabulary) <= 1 << 16 else "<u4"
        self.engine = self._engine(spec) if self.kind != "whole" else None

    def _engine(self, spec: dict):
        """A byte-pair engine whose ranks are the file's ids, or None if ids don't follow the order of merges."""
        import tiktoken
        from public_tokenizers import PATTERN

        of, vocab = byte_alphabet(), spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        special = set(self.special)

        def as_bytes(token: str) -> bytes:
            end = bool(suffix) and token.endswith(suffix)
            return bytes(of[c] for c in (token[: -len(suffix)] if end else token)) + END.encode() * end

        ranks = {as_bytes(t): i for t, i in vocab.items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        places = [vocab.get(a + b, -1) for a, b in pairs]
        if places != sorted(set(places)) or len(ranks) != len(vocab) - len(special & set(vocab)) or (places and places[0] < 256 * (1 + bool(suffix))):
            return None
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.token_bytes[k] = len(token)
        return tiktoken.Encoding("file", pat_str=PATTERN if self.kind == "spaced" else f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def by_library(self, units: list[str]) -> pa.ListArray:
        ids = []
        for at in range(0, len(units), 4096):
            ids += [e.ids for e in self.library.encode_batch_fast(units[at : at + 4096], add_special_tokens=False)]
        return pa.array(ids, pa.list_(pa.int32()))

    def by_engine(self, units: pa.Array) -> pa.ListArray:
        """Units, each with its ends marked or a space before it, in one call."""
        sizes = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = pa.concat_arrays([units]).buffers()[2].to_pybytes()[: sizes.sum()].decode()
        ids = self.engine.encode_to_numpy(joined, disallowed_special=()).astype(np.int32)
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 1
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))

    def table(self, keys: pa.Array) -> pa.ListArray:
        """Ids of each distinct unit."""
        before = " " if self.kind == "spaced" else ""
        if self.engine is None:
            return self.by_library([before + k for k in keys.to_pylist()])
        if before:
            plain = pc.and_not(pc.match_substring_regex(keys, PLAIN), pc.match_substring_regex(keys, self.marks))
            joined = pc.binary_join_element_wise(before, keys.filter(plain), "")
        else:
            plain = pc.and_not(pc.match_substring_regex(keys, WORDS), pc.match_substring_regex(keys, f"{CONTRACTION}|{self.marks}"))
            joined = pc.replace_substring_regex(pc.utf8_lower(keys.filter(plain)), PRETOKEN, rf"\1{END}")
        lists = [self.by_engine(joined)] if len(joined) else []
        if len(joined) == len(keys):
            return lists[0] if lists else self.by_library([])
        lists.append(self.by_library([before + k for k in keys.filter(pc.invert(plain)).to_pylist()]))
        return pa.concat_arrays(lists).take(pa.array(order(plain.to_numpy(zero_copy_only=False))))

    def cut(self, texts: pa.Array) -> pa.ListArray:
        if self.kind == "whole":
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        lists = pc.split_pattern(texts, " ")
        if self.kind == "dropped":
            return lists
        odd = pc.match_substring_regex(texts, ADJACENT)
        if not pc.any(odd).as_py():
            return lists
        careful = pa.array([SAFE_CUT.split(x) for x in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        even = pc.invert(odd)
        return pa.concat_arrays([lists.filter(even), careful]).take(pa.array(order(even.to_numpy(zero_copy_only=False))))

    def units(self, texts: pa.Array):
        """(first unit of each text and the end, each unit's row in the table, ids of each distinct unit)."""
        lists = self.cut(texts)
        first = np.asarray(lists.offsets).astype(np.int64)
        first = first - first[0]
        values = lists.flatten()
        coded = values.dictionary_encode()
        row, table = coded.indices.to_numpy(zero_copy_only=False), self.table(coded.dictionary)
        if self.kind == "spaced":  # no space before the first unit of a text
            row = row.copy()
            row[first[:-1]] = len(table) + np.arange(len(texts))
            table = pa.concat_arrays([table, self.by_library(values.take(pa.array(first[:-1])).to_pylist())])
        return first, row, table

    def pretokens(self, units: pa.Array, before: str) -> pa.ListArray:
        """The pre-tokens of each distinct unit with `before` in front, as keys of piece_sizes. A unit that may hold a special
        token, and any text of a file without safe cuts, is one key of its own."""
        if self.kind == "whole":
            return pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1), pa.int32()), pc.binary_join_element_wise(OPAQUE, units, ""))
        simple = pc.match_substring_regex(units, "^[a-z]+$")  # one pre-token of letters in either kind of file
        first = (byte_char(" ") if before else "") if self.kind == "spaced" else ""
        one = pc.binary_join_element_wise(first, units.filter(simple), "")
        rest, split, normal = units.filter(pc.invert(simple)).to_pylist(), self.library.pre_tokenizer.pre_tokenize_str, self.library.normalizer
        found = [[OPAQUE + before + x] if any(s in x for s in self.special) else [p for p, _ in split(normal.normalize_str(x) if normal else before + x)] for x in rest]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1), pa.int32()), one), pa.array(found, pa.list_(pa.string()))]
        return pa.concat_arrays(lists).take(pa.array(order(simple.to_numpy(zero_copy_only=False))))

    def frequencies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(ends, piece, times, pieces): text k has the pre-tokens pieces[piece[j]] times[j] times for each j from ends[k] to
        ends[k + 1]; pieces are distinct."""
        lists = self.cut(texts)
        first = np.asarray(lists.offsets).astype(np.int64)
        first = first - first[0]
        values = lists.flatten()
        coded = values.dictionary_encode()
        row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        table = self.pretokens(coded.dictionary, " " if self.kind == "spaced" else "")
        if self.kind == "spaced" and len(texts):  # no space before the first unit of a text
            row[first[:-1]] = len(table) + np.arange(len(texts))
            table = pa.concat_arrays([table, self.pretokens(values.take(pa.array(first[:-1])), "")])
        inner = table.flatten().dictionary_encode()
        start, n = np.asarray(table.offsets).astype(np.int64), len(inner.dictionary)
        key, times = counted(np.repeat(np.arange(len(texts)), np.diff(first)) * len(table) + row)
        owner, unit = np.divmod(key, max(1, len(table)))
        each = np.diff(start)[unit]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[unit] - start[0], each)
        piece = inner.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, times = counted(np.repeat(owner, each) * max(1, n) + piece[at], np.repeat(times, each))
        owner, piece = np.divmod(key, max(1, n))
        return np.searchsorted(owner, np.arange(len(texts) + 1)), piece, times, inner.dictionary

    def piece_sizes(self, pieces: list[str]) -> list[int]:
        """Number of tokens of each key of pretokens()."""
        merged = self.library.model.tokenize
        return [len(self.library.encode(p[1:], add_special_tokens=False)) if p[:1] == OPAQUE else len(merged(p)) for p in pieces]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; no ids are made beyond those of the distinct units."""
        if not len(texts):
            return np.zeros(0, np.int64)
        first, row, table = self.units(texts)
        sizes = np.diff(np.asarray(table.offsets)).astype(np.int64)
        return np.add.reduceat(sizes[row], first[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text k has ids[offsets[k]:offsets[k + 1]]."""
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        first, row, table = self.units(texts)
        return gather(table, row, first)


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in ascending order, how often each occurs or the sum of its times)."""
    if times is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys)
        keys, times = keys[by], times[by]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys))) if times is None else np.add.reduceat(times, starts) if len(keys) else times


def order(front: np.ndarray) -> np.ndarray:
    """Where each row is once those of `front` have been moved before all others."""
    return np.where(front, np.cumsum(front) - 1, front.sum() + np.cumsum(~front) - 1)


def gather(table: pa.ListArray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table one after another, and where each group of rows, from first[k] to first[k + 1], begins."""
    sizes = np.diff(np.asarray(table.offsets)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes[row])])
    return ends[first], table.take(pa.array(row)).flatten().to_numpy()


_ENCODERS: dict = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]

"""Token counts, BPE and token stores against the library itself."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, queries, token_store
from tracewell.llm.shared import table, tokenizer_path
from tracewell.llm.token_count import count_tokens
from tracewell.llm.units import UnitEncoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, n_tokens int, id string, ids string, start int"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def odd_texts():
    rnd = random.Random(5)
    parts = [*"abc XYZ  \n\t'sdtre.,!?0129ßéÀüΣσςİıДжя漢字́  \x1c\x85\xa0​ 😀<|>\x01\xad", "<|endoftext|>", "<|startoftext|>", "'ll", " \n", "\n ", "don't", " word"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    return [*made, "", " ", "  ", "\n", "a  b", "a   b", " a", "a ", "x" * 20_000, "日本" * 3000, " ".join(["word"] * 30_000)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_library(name):
    texts, coder = odd_texts(), UnitEncoder(tokenizer_path(name))
    want = [e.ids for e in library(name).encode_batch_fast(texts, add_special_tokens=False)]
    assert coder.engine is not None
    off, ids = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want
    assert coder.count(pa.array(texts)).tolist() == list(map(len, want))
    assert coder.count(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("name", [BYTE, WORD])
@pytest.mark.parametrize("mean", [1, 16, 1024])
def test_chunks_equal_library(name, mean):
    texts = odd_texts()
    coder = UnitEncoder(tokenizer_path(name))
    off, ids = bpe.ChunkEncoder(coder, mean).encode(pa.array(texts)[3:])
    lib = library(name)
    want = [e.ids for e in lib.encode_batch_fast(texts[3:], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want
    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
    assert bpe.decode_ids(coder, lists).to_pylist() == [lib.decode(w, skip_special_tokens=False) for w in want]
    assert bpe.ChunkEncoder(coder, mean).encode(pa.array([], pa.string()))[0].tolist() == [0]


def test_chunk_cuts_follow_content():
    rnd = np.random.default_rng(1)
    data, head = rnd.integers(32, 127, 40_000).astype(np.uint8), rnd.integers(32, 127, 777).astype(np.uint8)
    plain, moved = bpe.chunk_ends(data, 256), bpe.chunk_ends(np.concatenate([head, data]), 256)
    assert len(plain) > 50
    assert set(plain + 777) >= {c for c in moved if c > 777 + bpe.WINDOW}
    assert set(moved) >= set(plain + 777)


def rows(spark):
    return spark.createDataFrame([(1, "one two", 9, "x", "y", 0), (2, None, 9, None, None, None), (2, "", 9, "x", "y", 0), (None, "null id", None, "x", "y", 0), (3, " b" * 9000, 9, "x", "y", 0), (1, "one two", 9, "x", "y", 0)], SCHEMA)


def test_count_edges(spark):
    got = sorted(map(tuple, count_tokens(rows(spark), tokenizer_path(BYTE)).collect()), key=str)
    n = {t: len(library(BYTE).encode(t).ids) for t in ("one two", "null id", " b" * 9000)}
    assert got == sorted([(1, 7, n["one two"])] * 2 + [(2, 0, 0)] * 2 + [(None, 7, n["null id"]), (3, 18000, n[" b" * 9000])], key=str)
    assert count_tokens(rows(spark).limit(0), tokenizer_path(BYTE)).collect() == []


def changed_file(tmp_path, name, **steps):
    spec = json.load(open(tokenizer_path(name), encoding="utf-8"))
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(spec | steps), encoding="utf-8")
    return str(path)


def test_files_of_other_kinds_are_not_cut(tmp_path):
    from tokenizers import Tokenizer

    for path in (changed_file(tmp_path, WORD, normalizer=None), changed_file(tmp_path, BYTE, normalizer={"type": "NFD"})):
        coder, lib = UnitEncoder(path), Tokenizer.from_file(path)
        assert coder.kind == "whole"
        texts = ["Hello WORLD and a Word", "", "déjà vu", "x  y"]
        want = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        off, ids = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want


@pytest.mark.parametrize("name", [BYTE, WORD, None])
def test_count_of_odd_texts(spark, tmp_path, name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name) if name else changed_file(tmp_path, WORD, normalizer=None)
    texts = odd_texts()
    lib = Tokenizer.from_file(path)
    want = [(k, len(t.encode()), len(e.ids)) for k, (t, e) in enumerate(zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False), strict=True))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, block string").repartition(3)
    assert sorted(map(tuple, count_tokens(df, path).collect())) == want


def test_each_key_is_worked_on_once(spark):
    from tracewell.llm import distinct

    def ask(batches):
        for batch in batches:
            for block, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, asked = distinct.bundles(pa.array([f"{k}" for k in range(n)], pa.string()), 5)
                assert sorted(place) == list(range(n))
                for b, d in [(-1, b"own"), *asked]:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([b], pa.int32()), pa.array([d], pa.binary())], ["block", "bucket", "data"])

    asked = spark.createDataFrame([(1, 40), (2, 60), (3, 0)], "block long, n long").repartition(3).mapInArrow(ask, "block long, bucket int, data binary")
    seen = spark.sparkContext.accumulator(0)

    def work(keys):
        seen.add(len(keys))
        return [k + b"!" for k in keys]

    rows = distinct.answer(asked, 5, work).collect()
    assert seen.value == 60
    got = {b: [x for r in rows if r["block"] == b and r["bucket"] >= 0 for x in distinct.unpack(bytes(r["data"])).to_pylist()] for b in (1, 2, 3)}
    assert {b: sorted(x) for b, x in got.items()} == {b: sorted(f"{k}!".encode() for k in range(n)) for b, n in ((1, 40), (2, 60), (3, 0))}
    assert [bytes(r["data"]) for r in rows if r["bucket"] < 0] == [b"own"] * 3


@pytest.mark.parametrize("name", [BYTE, WORD, None])
def test_codec_of_odd_texts(spark, tmp_path, name):
    """Over blocks in several tasks, with chunks that they share; a file without safe cuts too."""
    from tokenizers import Tokenizer

    path = tokenizer_path(name) if name else changed_file(tmp_path, WORD, normalizer=None)
    texts = [t + "".join(odd_texts()[3:9]) for t in odd_texts()[:300]] + odd_texts()[-6:]
    lib = Tokenizer.from_file(path)
    want = [(k, e.ids, lib.decode(e.ids, skip_special_tokens=False)) for k, e in enumerate(lib.encode_batch_fast(texts, add_special_tokens=False))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, block string").repartition(3)
    assert sorted(map(tuple, bpe.encode_documents(df, path, mean_chunk=64).collect())) == want


def test_joins_that_do_not_agree_are_refused():
    units = UnitEncoder(tokenizer_path(BYTE))
    counts, which, distinct = bpe.cut_texts(pa.array(["one two three four " * 50]), 16)
    chunks = [bpe.Encoded(x, units.id_type) for x in bpe.encode_chunks(units, distinct.cast(pa.binary()).to_pylist())]
    for c in chunks:
        c.last_ids = c.last_ids + 1
    with pytest.raises(ValueError):
        bpe.join_chunks(units, counts, which, chunks)


def test_codec_edges(spark):
    got = bpe.encode_documents(rows(spark), tokenizer_path(WORD)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 2, 3]
    assert [r["decoded"] for r in got if r["doc_id"] == 2] == ["", ""]
    assert got[1]["ids"] == library(WORD).encode("one two", add_special_tokens=False).ids
    assert bpe.encode_documents(rows(spark).limit(0), tokenizer_path(WORD)).collect() == []


def test_grammar_round_trip():
    rnd = np.random.default_rng(2)
    for ids in (np.zeros(0, int), np.array([7]), np.zeros(5000, int), rnd.integers(0, 30, 20_000), np.tile(rnd.integers(0, 50_000, 97), 300), np.full(333, 50_256)):
        ids = ids.astype(np.int32)
        ends = np.array([0, len(ids) // 3, len(ids) // 2, len(ids), len(ids)])
        shard = token_store.Shard(token_store.write_shard([1, None, 5, -7, 9], ends, ids, 50_257))
        assert shard.docs == [1, None, 5, -7, 9]
        assert (shard.ids() == ids).all()
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            assert (shard.document(k) == ids[a:b]).all()
    assert len(token_store.write_shard([1], np.array([29_100]), np.tile(np.arange(97), 300), 50_257)) < 29_100 / 4
    with pytest.raises(ValueError):
        token_store.Shard(b"????" + bytes(40))


def most_often(symbols):
    """The largest number of non-overlapping occurrences of any pair."""
    last, n = {}, {}
    for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if last.get(pair, -2) < k - 1 or pair[0] != pair[1]:
            last[pair] = k
            n[pair] = n.get(pair, 0) + 1
    return max(n.values(), default=0)


def test_grammar_goes_on_to_its_end():
    rnd = np.random.default_rng(3)
    cases = [np.zeros(1 << 19, int), np.tile(rnd.integers(0, 50_000, 20_000), 11), rnd.integers(0, 4, 30_000), rnd.integers(0, 300, 5000), np.repeat(rnd.integers(0, 3, 900), rnd.integers(1, 9, 900)), np.array([1, 1, 1, 2, 1, 1, 1])]
    for ids in cases:
        rules, symbols = token_store.compress(ids, 50_257)
        assert most_often(symbols.tolist()) < 2
        assert len({*map(tuple, rules.tolist())}) == len(rules)
        ends = np.array([len(ids)])
        assert (token_store.Shard(token_store.write_shard([1], ends, ids, 50_257)).ids() == ids).all()
    rules, symbols = token_store.compress(cases[0], 50_257)
    assert (len(rules), len(symbols)) == (18, 2)
    rules, symbols = token_store.compress(cases[1], 50_257)
    assert len(symbols) <= 4
    assert len(token_store.compress(cases[2], 50_257, rounds=1)[0]) <= 16
    _, symbols = token_store.compress(cases[3], 50_257, least=5)
    assert most_often(symbols.tolist()) < 5


def test_a_document_is_read_without_the_shard():
    ids = np.tile(np.random.default_rng(4).integers(0, 50_000, 4096), 64)
    ends = np.arange(100, len(ids) + 1, 100)
    shard = token_store.Shard(token_store.write_shard(list(range(len(ends))), ends, ids, 50_257))
    reads = 0

    class Counted(np.ndarray):
        def __getitem__(self, k):
            nonlocal reads
            reads += 1
            return super().__getitem__(k)

    shard.length, shard._symbols = shard.length.view(Counted), tuple(x.view(Counted) for x in shard._symbols)
    for k in (0, 7, 1000, len(ends) - 1):
        reads = 0
        assert (shard.document(k) == ids[ends[k] - 100 : ends[k]]).all()
        assert reads < 600


def test_store_with_a_hot_id(spark):
    texts = [f"text number {k} of one id" for k in range(300)]
    df = spark.createDataFrame([(None if k % 3 else 5, t) for k, t in enumerate(texts)] + [(9, "last")], "doc_id long, text string").repartition(4)
    out = token_store.new_store(spark)
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # as partitions of many rows aren't put together
    spark.conf.set(key, "false")
    try:
        token_store.write_tokens(df, tokenizer_path(BYTE), out, shard_ids=64)
    finally:
        spark.conf.unset(key)
    assert spark.read.parquet(out).select("part").distinct().count() > 2
    got = token_store.read_tokens(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 200 + [5] * 100 + [9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_store_edges(spark):
    out = token_store.new_store(spark)
    token_store.write_tokens(rows(spark), tokenizer_path(BYTE), out, shard_ids=8)
    got = sorted(map(tuple, token_store.read_tokens(spark, out).collect()), key=lambda r: r[1])
    texts = [(None, "null id"), (1, "one two"), (1, "one two"), (2, ""), (2, ""), (3, " b" * 9000)]
    start, want = 0, []
    for doc, text in texts:
        ids = [*library(BYTE).encode(text).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = token_store.new_store(spark)
    token_store.write_tokens(rows(spark).limit(0), tokenizer_path(BYTE), empty)
    assert token_store.read_tokens(spark, empty).collect() == []


def test_queries(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    byte = {k: library(BYTE).encode(t).ids for k, t in docs.items()}
    got = {r["doc_id"]: r for r in queries.op1_token_count(spark, sf_dir).collect()}
    assert {k: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for k, r in got.items()} == {k: (len(docs[k].encode()), len(i), len(i) > 512) for k, i in byte.items()}
    lib = library(WORD)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_bpe_codec(spark, sf_dir).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, t in docs.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[k] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    start, want = 0, {}
    for k in sorted(docs):
        ids = np.array([*byte[k], 0], "<u4")
        want[k] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op5_token_store(spark, sf_dir).orderBy(F.rand()).collect()} == want

"""Near-duplicates and nearest vectors against brute force."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from tracewell.llm import queries, simhash, topk
from tracewell.llm.shared import table
from pyspark.sql import functions as F


def brute_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, distance=2):
    """{node: smallest id} over {id: fingerprint}."""
    ids, root = sorted(fps), {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}


def test_fingerprint():
    for t in ("", " \n", "One", "one TWO", "Ça A É b", "a b c", "a b c d e  f\tg\n\x0bh i", "x\xa0y z w", "w " * 5000):
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    fps = {k: brute_fingerprint(t) for k, t in docs.items()}
    want = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, sf_dir).collect()}
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in docs}
    assert len(set(want.values())) < len(want)


def near_set(seed=4):
    """Fingerprints with chains, a ball of near ones and singles, by id."""
    rnd = random.Random(seed)
    base = rnd.getrandbits(64)
    out = [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)] + [rnd.getrandbits(64) for _ in range(60)]
    x = rnd.getrandbits(64)
    for b in range(0, 40, 2):
        x ^= 3 << b
        out.append(x)
    rnd.shuffle(out)
    return {k: v for k, v in enumerate(dict.fromkeys(out))}


def test_links_in_crowded_buckets(spark):
    fps = near_set()
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in fps.items()}
    df = spark.createDataFrame([(v,) for v in signed.values()], "__fp long")
    want = brute_components(fps)
    name = {v: k for k, v in signed.items()}
    for most in (4, 10_000):
        found = simhash.links(df, most=most).collect()
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in found)
        roots = {name[r["node"]]: name[r["root"]] for r in simhash.components(spark.createDataFrame(found)).collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
        assert {g for g in groups(want) if len(g) > 1} == groups(roots)


def test_links_at_other_distances(spark):
    rnd = random.Random(6)
    base = rnd.getrandbits(64)
    fps = {k: v for k, v in enumerate({base ^ sum(1 << b for b in rnd.sample(range(14), rnd.choice((2, 3)))) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(20)})}
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in fps.items()}
    df = spark.createDataFrame([(v,) for v in signed.values()], "__fp long")
    name = {v: k for k, v in signed.items()}
    for distance, most in ((1, 4), (3, 8)):
        edges = {(r["a"], r["b"]) for r in simhash.links(df, distance, 5, most=most).collect()}
        near = {(min(x, y), max(x, y)) for x in signed.values() for y in signed.values() if x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= distance}
        assert edges <= near and near
        root = {k: k for k in fps}
        for a, b in edges:
            x, y = sorted((root[name[a]], root[name[b]]))
            root = {k: x if v == y else v for k, v in root.items()}
        want = brute_components(fps, distance)
        groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
        assert groups(root) == groups(want)


def test_duplicate_edges(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(5, text, "x", 0), (3, text.upper(), "x", 0), (None, text, "y", 1), (7, None, None, 1), (8, "", "x", None), (9, " \n", "x", 2), (5, text, "x", 0), (11, "something else " * 3000, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fingerprint int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 7), (11, 11)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 11]
    twice = df.where("doc_id = 11").union(df.where("doc_id = 11"))
    assert simhash.keep_one(twice).count() == 1
    assert simhash.near_duplicates(df.limit(0)).collect() == [] == simhash.keep_one(df.limit(0)).collect()


def test_keep_one_without_unique_ids(spark):
    long = "a quite different and much longer text about rivers and hills, number {} of several that share no id at all"
    rows = [(None, long.format(k) * k, k) for k in range(1, 7)] + [(None, "Copied words stand here", 8), (None, "copied words stand HERE", 9)]
    rows += [(4, "one text of the id four", 1), (4, "another that is like no other of them", 2), (1, "one text of the id FOUR", 3), (4, "another that is like no other of them", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    want = brute_components({k: brute_fingerprint(t) for k, (_, t, _) in enumerate(rows)})
    kept = simhash.keep_one(df).collect()
    place = {(r[0], r[1]): k for k, r in enumerate(rows)}
    assert len(kept) == len(set(want.values())) == len({want[place[r["doc_id"], r["text"]]] for r in kept})
    assert sorted(r["text"] for r in kept if r["doc_id"] is not None) == ["another that is like no other of them", "one text of the id FOUR"]


def brute_top(rows, k, scale=64):
    ok = [(i, np.floor(np.float64(np.array(v, np.float32)) * scale).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % 20 == 0:
            scored = sorted((-sum((v * w).tolist()), i) for i, w in ok if i != q and len(v) == len(w))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.choice([-1.5, -0.3, 0.2, 0.9], 5)]) for i in range(130)]
    rows += [(140, [1e14, -2e13, 0.0, 1.0, 3e12]), (160, [1.0, 2.0]), (161, [2.0, 2.0]), (162, []), (180, []), (200, None), (220, [1.0, None]), (221, [float("nan")] * 5), (240, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    for tile in (16, 4096):
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 7, tile=tile, fan_in=2).collect()))
        assert got == brute_top(rows, 7)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(df, F.lit(False)).collect() == []


def test_products_beyond_64_bits(spark):
    from fractions import Fraction

    rnd = np.random.default_rng(9)
    values = [1e300, -1e300, 1.7e308, 3e9, -3e9, 2.5, -0.3, 0.0, 1e17, 7e15, 1.0]
    rows = [(i, [float(x) for x in rnd.choice(values, 3)]) for i in range(60)] + [(60, [3e9, 1.0, 0.0]), (61, [3e9, 1.0, 0.0]), (62, [1e300, 1.0, 0.0]), (63, [1e300, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [(lambda y: y.numerator // y.denominator)(Fraction(x) * 64) for x in v] for i, v in rows}
    long = (1 << 63) - 1
    want = []
    for q in ints:
        if q % 20 == 0:
            scored = sorted((-min(long, max(-long, sum(x * y for x, y in zip(ints[q], v, strict=True)))), i) for i, v in ints.items() if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:9])]
    for tile in (16, 4096):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 9, tile=tile, fan_in=2).collect())) == sorted(want)


def test_top_k_of_a_repeated_id(spark):
    rnd = np.random.default_rng(5)
    rows = [(20, [2.0, 2.0, float(x)]) for x in rnd.random(40)] + [(i, [float(x) for x in rnd.random(3)]) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for tile in (16, 4096):
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 20, 7, tile=tile, fan_in=2).collect()))
        assert got == sorted(x for x in brute_top(rows, 7) if x[0] == 20) and len(got) == 280

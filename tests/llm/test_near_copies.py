"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np

import corpus_pipeline
from tracewell.llm import near_copies, simhash


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_roots(texts):
    sets, root = [brute_sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def planted(seed=7):
    """Texts, near copies of them, a chain whose ends are far apart, and a large group around one text."""
    rnd = random.Random(seed)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    swap = lambda t, n: [*t[:-n], *new(n)]
    out = []
    for n in (1, 2, 5, 10, 18, 30):
        for _ in range(5):
            out += [t := new(150), swap(t, n)]
    link = new(120)
    for k in range(0, 60, 6):
        link = [*link[:k], *new(6), *link[k + 6 :]]
        out.append(link)
    base = new(100)
    for _ in range(60):
        k, t = rnd.randrange(5, 90), list(base)
        t[k : k + rnd.choice((1, 6))] = new(2)
        out.append(t)
    out += [["Just", "four", "short", "words"], ["just", "FOUR", "short", "words"], [], []]
    return [" ".join(t) for t in out]


def test_stage_leaves_no_near_copies(spark):
    texts = planted()
    roots = brute_roots(texts)
    df = spark.createDataFrame(list(enumerate(texts)) + [(len(texts), None)], "doc_id long, text string")
    kept = corpus_pipeline.keep_distinct(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))
    assert corpus_pipeline.keep_distinct(spark, df.limit(0), "").collect() == []


def test_no_link_of_a_bucket_is_lost(spark):
    """Sets around a centre, far from it, linked to each other or over a chain, of several sizes, all in one bucket."""
    rnd = random.Random(11)

    def changed(x, drop, add):
        return frozenset(rnd.sample(sorted(x), len(x) - drop)) | {rnd.randrange(1 << 40) for _ in range(add)}

    for trial in range(3):
        base = frozenset(rnd.randrange(1 << 40) for _ in range(90))
        sets = [base] + [changed(base, rnd.randrange(40), rnd.randrange(40)) for _ in range(40)]
        for far in [changed(base, 20, 15), changed(base, 30, 0), changed(base, 0, 40)]:
            sets += [far, *(changed(far, rnd.randrange(9), rnd.randrange(9)) for _ in range(8))]
        x = changed(base, 15, 5)
        for _ in range(10):
            sets.append(x := changed(x, 5, 5))
        sets = sorted({*sets}, key=sorted)
        nodes = {k - 30: v for k, v in enumerate(sets)}
        root = {k: k for k in nodes}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a in nodes:
            for b in nodes:
                if a < b and 5 * len(nodes[a] & nodes[b]) >= 4 * len(nodes[a] | nodes[b]):
                    i, j = sorted((find(a), find(b)))
                    root[j] = i
        met = spark.createDataFrame([(trial, k, len(nodes)) for k in nodes], "bucket long, node long, n long")
        table = spark.createDataFrame([(k, sorted(v)) for k, v in nodes.items()], "node long, found array<long>")
        got = {r["node"]: r["root"] for r in near_copies.joined(met, table).collect()}
        assert {k: got.get(k, k) for k in nodes} == {k: find(k) for k in nodes}
        assert 3 < len({find(k) for k in nodes}) < len(nodes) - 20


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Sets of one bucket with a passage in common that the centre lacks, or with the same loss, and few of them similar: what is compared
    grows with the links, not with the square of the bucket."""
    rnd, compared = random.Random(13), []
    new = lambda n: {rnd.randrange(1 << 40) for _ in range(n)}
    similar = near_copies.similar

    def counted(pairs, sets):
        compared.append(pairs.count())
        return similar(pairs, sets)

    monkeypatch.setattr(near_copies, "similar", counted)
    base, passage = new(100), new(60)
    lost = set(sorted(base)[:40])
    sets = [x for _ in range(40) for x in (passage | new(40), base - lost | new(15))]
    copies = [sets[0] | new(5), sets[1] | new(3)]
    nodes = dict(enumerate([*sets, *copies, base]))  # of equal scores the last node is the centre
    met = spark.createDataFrame([(0, k, len(nodes)) for k in nodes], "bucket long, node long, n long")
    table = spark.createDataFrame([(k, sorted(v)) for k, v in nodes.items()], "node long, found array<long>")
    got = {(r["node"], r["root"]) for r in near_copies.joined(met, table).collect() if r["node"] != r["root"]}
    assert got == {(80, 0), (81, 1)}
    assert sum(compared) <= len(nodes)


def test_bands_meet_at_the_least_similarity():
    rnd, met, n = np.random.default_rng(3), 0, 2000
    for _ in range(n):  # 160 of 200 shingles in common
        h = rnd.integers(0, 1 << 63, 200, np.uint64)
        met += bool({*near_copies.bands(h[:180])} & {*near_copies.bands(h[20:])})
    assert met >= 0.998 * n


def test_stage_joins_what_fingerprints_link(spark):
    """Texts of a repeated line with other words after it: near by fingerprint, far by shingles, also over a chain of both links."""
    rnd = random.Random(5)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    line, other = "one two three four five six seven".split() * 300, new(200)
    texts = [" ".join(t) for t in ([*line, *new(30)], [*line, *new(30)], other, [*other[:-3], *new(3)], new(150))]
    bits = lambda a, b: (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count()
    assert bits(0, 1) <= 2 < bits(2, 3) and brute_roots(texts) == [0, 1, 2, 2, 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_distinct(spark, df, "").collect()) == [0, 2, 4]

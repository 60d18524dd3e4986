"""Language and quality models: exact sums on small cases, held-out accuracy on the tables."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import language, quality, queries
from tracewell.llm.shared import table, tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
COUNTS = {"en": {"the": 9, "and": 5, "water": 2, "house": 3}, "de": {"der": 9, "und": 5, "wasser": 2, "haus": 3}}


def model_of(counts, steps=3):
    pieces, languages = language.vocabulary(PIECES), sorted(counts)
    return language.Model(languages, pieces, np.stack([language.fit(list(counts[k]), list(counts[k].values()), pieces, steps) for k in languages], 1), 1e-5)


def brute_word(word, model, c):
    """Sum over all segmentations, in exact fractions, by recursion."""
    index = {int(h): k for k, h in enumerate(model.pieces.hashes)}

    def piece(s):
        return Fraction(float(model.weights[index[h], c])) if (h := int(language.code_hash(language.as_codes([s], len(s)))[0, -1])) in index else 0

    rest = [Fraction(0)] * len(word) + [Fraction(1)]
    for at in range(len(word) - 1, -1, -1):
        rest[at] = Fraction(model.unknown) * rest[at + 1]
        for end in range(at + 1, min(len(word), at + 40) + 1):
            rest[at] += piece(("" if at else language.MARK) + word[at:end]) * rest[end]
    return math.log(rest[0].numerator) - math.log(rest[0].denominator)


def test_forward_sums_all_segmentations():
    model = model_of(COUNTS)
    words = ["the", "haus", "thewater", "q", "漢字", "", "undhouse", "wasser" * 24, "andthe" * 5 + "xq", "hausderwasserund" * 40, "a" * 31, "b" * 32, "c" * 33]
    got = language.word_scores(words, model)
    for k, w in enumerate(words):
        for c in range(2):
            assert abs(got[k, c] - (brute_word(w, model, c) if w else 0)) < 1e-7 * max(1, len(w)), w
    assert np.isfinite(language.word_scores(["x" * 5000, "漢" * 200], model)).all()


def test_no_piece_of_letters_is_left_out():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    letters = {p for k in range(sp.get_piece_size()) if (p := sp.id_to_piece(k).lower()).removeprefix(language.MARK).isalpha()}
    found = language.vocabulary(PIECES)
    assert len(found.hashes) == found.size == len(letters) and max(found.lengths) == max(map(len, letters)) > 13


def test_expected_uses_of_long_words():
    """Each letter of a word lies in one piece, so the letters of all expected pieces and of the unknown add up to its length;
    a piece's expected uses are the derivative of the log probability by the logarithm of its weight."""
    model = model_of(COUNTS)
    for word in ("water", "thewaterandhouse" * 3, "und" * 30):
        found = language.Forward(language.edges([word], len(word), model.pieces), 1, model.pieces, model.weights[:, :1], model.unknown)
        uses = np.zeros(len(model.pieces.hashes))
        found.expected(np.ones(1), uses)
        for k in np.argsort(-uses)[:5]:
            moved = model.weights.copy()
            moved[k] *= 1 + 1e-6
            more = language.word_scores([word], language.Model(model.languages, model.pieces, moved, model.unknown))[0, 0]
            slope = (more - language.word_scores([word], model)[0, 0]) / 1e-6
            assert abs(slope - uses[k]) < 1e-3 * max(1, uses[k])


def test_expectation_raises_likelihood():
    total = [sum(n * language.word_scores([w], model_of({"en": COUNTS["en"]}, s))[0, 0] for w, n in COUNTS["en"].items()) for s in (1, 2, 4)]
    assert total[0] < total[1] < total[2]


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [("en", f"word{k} the house")for k in range(50)] + [("en", "the same text")] * 500 + [("de", "das haus"), ("xx", "123"), (None, "none"), ("de", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language.train(df, PIECES, documents=10)
    assert model.languages == ["de", "en", "xx"]
    assert np.allclose(model.weights.sum(0)[:2], 1)


def test_language_edges(spark):
    model = model_of(COUNTS)
    rows = [(1, "Und das Haus, der Wasser!", "en", 1), (2, "the house and the water", None, 2), (3, None, "de", 3), (4, "", "de", 3), (5, "123 !?", "de", 3), (None, "THE AND", "x", 1), (7, "der und " * 20_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["p"]["lang"], r["p"]["score"]) for r in df.select("doc_id", language.predict(F.col("text"), model).alias("p")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", None: "en", 7: "de"}
    assert all(0 <= s <= 1 for _, s in got.values())
    assert df.limit(0).select(language.predict(F.col("text"), model)).collect() == []
    none = language.train(df.where("lang = 'zz'"), PIECES)
    assert {r[0]["lang"] for r in df.select(language.predict(F.col("text"), none)).collect()} == {"und"}


def test_language_held_out(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    got = [r for r in queries.op2_language_id(spark, sf_dir).collect()]
    assert len(got) == len(lang)
    tested = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(tested) > 20
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.97 * len(tested)


def test_describe_is_per_text():
    texts = ["", "a", "Aa Aa Aa", "été 12!!", " \n ", "word word other", "zz" * 50_000, "x y"]
    whole = quality.describe(pa.array(texts))
    assert whole.shape == (len(texts), quality.FEATURES)
    for k, t in enumerate(texts):
        assert np.allclose(quality.describe(pa.array([t]))[0], whole[k], atol=1e-6), t
    assert np.allclose(quality.describe(pa.array(["zzz", *texts]).slice(1)), whole, atol=1e-6)


def test_score_is_the_vote_of_neighbours():
    rnd = np.random.default_rng(0)
    x, y = rnd.normal(size=(300, 6)).astype(np.float32), (rnd.random(300) < 0.5).astype(float)
    model = quality.Model(np.zeros(6, np.float32), np.eye(6, dtype=np.float32), quality.unit(x), y, 9, 3.0)
    q = rnd.normal(size=(40, 6)).astype(np.float32)
    for row, got in zip(q, model.score(q), strict=True):
        cosine = quality.unit(x) @ (row / np.linalg.norm(row))
        near = np.argsort(-cosine)[:9]
        w = np.maximum(cosine[near], 1e-6) ** 3.0
        assert abs((w * y[near]).sum() / w.sum() - got) < 1e-4


def test_quality_edges(spark):
    rows = [(1, "good plain words here", "x", 1), (2, None, None, None), (3, "", "x", 1), (None, "other words", "x", 1), (1, "good plain words here", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = df.select("doc_id", quality.predict(F.col("text"), model).alias("s")).collect()
    assert len(got) == 5 and all(0 <= r["s"] <= 1 for r in got)
    none = quality.train(df, labels.limit(0))
    assert {r[0] for r in df.select(quality.predict(F.col("text"), none)).collect()} == {0.5}
    assert df.limit(0).select(quality.predict(F.col("text"), model)).collect() == []


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    got = [r for r in queries.op10_quality(spark, sf_dir).collect()]
    tested = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(tested) > 40
    assert sum(p == y for p, y in tested) >= 0.93 * len(tested)
    assert sum(p == y for p, y in tested if y == 1) >= 0.98 * sum(y == 1 for _, y in tested)


def test_all_ties_vote():
    vectors = np.array([[1, 0], [1, 0], [1, 0], [0, 1]], np.float32)
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        model = quality.Model(np.zeros(2, np.float32), np.eye(2, dtype=np.float32), vectors[order], np.array([1.0, 0.0, 0.0, 1.0])[order], 1, 4.0)
        assert np.allclose(model.score(np.array([[5, 0]], np.float32)), 1 / 3)


def test_quality_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {k} of one id") for k in range(300)] + [(2, "the same")] * 300 + [(k, f"other text {k}") for k in range(3, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 400 + [(2, 0)] * 400 + [(2, 1)] + [(k, k % 2) for k in range(3, 60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=40)
    assert len(model.labels) == 40 and set(model.labels) == {0.0, 1.0}
    whole = quality.train(docs, labels, sample=10_000)
    assert len(whole.labels) == 300 + 2 + 57


def test_slices_hold_few_rows():
    """Many short texts are described a few hundred at a time."""
    from tracewell.llm.shared import by_bytes

    texts = pa.array(["ab", "", "c" * 50] * 500)
    cuts = list(by_bytes(texts, 1000, 100))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and (cuts[0][0], cuts[-1][1]) == (0, 1500)
    assert max(b - a for a, b in cuts) <= 100
    assert np.allclose(np.concatenate([quality.describe(texts[a:b]) for a, b in cuts]), quality.describe(texts))

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from souk.llm import language
from souk.llm.queries import held_out, language_model
from souk.llm.rawtext import Lookup
from tests.llm import cases

PIECES = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"abab", b" ab"]


def model():
    hashes = language._hashes(PIECES)
    order = np.argsort(hashes)
    chances = np.random.default_rng(0).random((8, 2))
    return [PIECES[i] for i in order], language.Model(["x", "y"], hashes[order], np.vstack([chances / chances.sum(0), np.zeros(2)]), 4)


def test_forward_sums_all_segmentations():
    pieces, m = model()
    for word in ("a", "abab", "abbaabab", "ab" * 9 + "a"):
        raw, total, uses = b" " + word.encode(), np.zeros(2), np.zeros((9, 2))

        def cut(at, chance, used, raw=raw, total=total, uses=uses):
            if at == len(raw):
                total += chance
                for k in used:
                    uses[k] += chance
            for k, piece in enumerate(pieces):
                if raw.startswith(piece, at):
                    cut(at + len(piece), chance * m.chances[k], [*used, k])

        cut(0, np.ones(2), [])
        assert np.allclose(np.log(total), language.likelihoods([word], m)[0])
        found = np.zeros((9, 2))
        for _, lattice in language._lattices([word], Lookup(m.pieces), m.longest):
            lattice.expected(m.chances, np.ones((1, 2)), found)
        assert np.allclose(found, uses / total)
    assert np.isfinite(language.likelihoods(["ab" * 5000], m)).all()


def test_long_words_in_the_fit():
    """Expected uses cover each byte of a word once, however often the sums were rescaled."""
    pieces, m = model()
    for n in (15, 16, 17, 40, 400, 5_000):
        word = "ab" * (n // 2) + "b" * (n % 2)
        uses = np.zeros((9, 2))
        for _, lattice in language._lattices([word], Lookup(m.pieces), m.longest):
            lattice.expected(m.chances, np.ones((1, 2)), uses)
        assert np.allclose(np.array([len(p) for p in pieces] + [0]) @ uses, len(word) + 1)


def test_whole_vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces, longest = language.vocabulary(path)
    with open(path, "rb") as f:
        assert len(pieces) == sum(1 for line in f if line.strip())
    assert longest > 16


def test_estimation_raises_the_likelihood():
    _, m = model()
    counts = {"x": Counter({"ab": 5, "abab": 3, "ba": 1}), "y": Counter({"bb": 4, "aa": 2})}

    def total(rounds):
        fitted = language.fit(counts, m.pieces, m.longest, rounds, 1e-9)
        return [sum(n * language.likelihoods([w], fitted)[0][k] for w, n in counts[name].items()) for k, name in enumerate(("x", "y"))]

    steps = [total(r) for r in range(1, 5)]
    assert all(b[k] >= a[k] - 1e-6 for a, b in zip(steps, steps[1:], strict=False) for k in (0, 1))


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = language.predict(docs, language_model(docs)).join(docs.where(held_out()), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in found if r.lang]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_edge_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m = language_model(docs)
    rows = [(None, None), (None, ""), (1, "12 ² ½ !?"), (2, "a" * 100_000), (2, "the that and"), (2, "the that and"), (3, "中文")]
    df = cases.clash(spark.createDataFrame(rows, "doc_id long, text string"), "lang_pred", "score", "_text", "_id")
    found = language.predict(df, m).collect()
    assert [r.lang_pred == "und" for r in found] == [True] * 3 + [False] * 4
    assert [r.score for r in found][:3] == [0.0] * 3
    kept = language.accepted(df.withColumn("lang", F.lit(None).cast("string")), m)
    assert kept.columns == [*df.columns, "lang"]
    assert kept.count() <= 4 and kept.where("lang is null").isEmpty()
    assert language.predict(df.limit(0), m).collect() == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    m = language.learn(docs, language.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    assert m.languages == []
    assert {(r.lang_pred, r.score) for r in language.predict(docs, m).collect()} == {("und", 0.0)}


def test_prediction_reads_the_text_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m = language_model(docs)
    shuffled = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert cases.ordered(language.predict(docs, m).collect()) == cases.ordered(language.predict(shuffled, m).collect())

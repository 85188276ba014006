"""Language ID and quality: definitions on small inputs, and held-out accuracy."""

import itertools
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm import language_id, quality, sampling

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.01"


def test_held_out_is_crc32(spark):
    got = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").select("doc_id", sampling.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_forward_sums_all_segmentations():
    vocabulary = {x: n for n, x in enumerate(["▁", "▁a", "a", "ab", "b", "▁ab", "ba", "aba"])}
    lattice = language_id.Lattice(vocabulary)
    p = language_id._table(np.arange(1.0, 17.0).reshape(8, 2))

    def brute(word):
        s, total = "▁" + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *(n + 1 for n, c in enumerate(cuts) if c), len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:])]
            rows = [vocabulary.get(x, 8 if len(x) == 1 else 9) for x in parts]
            total += np.prod(p[rows], axis=0)
        return total

    for words in (["a", "b", "z"], ["abab", "bbaa", "xaby"], ["ababa", "aaaaa"]):
        edges = lattice.edges(words)
        assert np.allclose(np.exp(language_id.forward(edges, p)), [brute(w) for w in words], rtol=1e-9)
        lang, piece, uses = language_id.expected(edges, p, np.zeros(len(words), dtype=int), np.ones(len(words)))
        assert uses.sum() > 0 and (lang == 0).all() and (piece < 8).all()


def test_long_words_are_summed_whole():
    """Words beyond floating point's range, against the same sum in logs, letter by letter."""
    lattice, model_pieces = language_id._lattice(PIECES), language_id.pieces(PIECES)
    rng = np.random.default_rng(2)
    p = language_id._table(rng.random((len(model_pieces), 2)))
    for word in ("the" * 400, "ж" * 300, "straßenbahnhaltestellenüberdachung"):
        s, total = "▁" + word, np.full((len(word) + 2, 2), -np.inf)
        total[0] = 0
        for end in range(1, len(s) + 1):
            for start in range(max(0, end - lattice.longest), end):
                row = model_pieces.get(s[start:end], lattice.size if end - start == 1 else None)
                if row is not None:
                    total[end] = np.logaddexp(total[end], total[start] + np.log(p[row]))
        assert np.allclose(language_id.forward(lattice.edges([word]), p)[0], total[-1], rtol=1e-9)


def test_language_edges(spark):
    rows = [(1, "the house is red", "en"), (2, "la maison est rouge", "fr"), (3, None, "en"), (4, "123 !!", "fr"), (5, "the red", None), (6, "x" * 100_000, None), (7, "", None)] * 2
    rows += [(i, "the house and the garden", "en") for i in range(10, 30)] + [(i, "la maison et le jardin", "fr") for i in range(30, 50)]
    docs = spark.createDataFrame([(t, i, lang, 1.0) for i, t, lang in rows], "text string, doc_id long, lang string, score double")
    got = language_id.identify(docs, PIECES).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[7].lang_pred == "und" and by[3].score == 0
    assert by[1].lang_pred == by[5].lang_pred == "en" and by[2].lang_pred == "fr" and 0.5 < by[1].score <= 1
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), PIECES)
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.identify(docs.limit(0), PIECES).count() == 0


def test_sum_of_squares_equals_pairs():
    m = quality.Machine(0.3)
    rng = np.random.default_rng(1)
    m.linear = rng.normal(size=quality.SIZE).astype(np.float32)
    m.factors = rng.normal(size=m.factors.shape).astype(np.float32)
    index, weight = rng.choice(quality.SIZE, 9, replace=False), rng.random(9)
    value, _ = m.raw(index, weight, np.array([0, 4, 9]))
    for got, part in zip(value, (slice(0, 4), slice(4, 9))):
        i, x = index[part], weight[part]
        want = 0.3 + (m.linear[i] * x).sum() + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got - want) < 1e-3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", 0), (3, "a " * 60_000, 5), (3, "a " * 60_000, 5), (None, "b", 1)], "doc_id long, text string, n_chars long").withColumn("score", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, none)).collect()} == {0.5}
    m = quality.Machine(0.1)
    got = quality.score(docs, m).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(docs.limit(0), m).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = language_id.identify(docs, PIECES).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert known.filter("lang = lang_pred").count() >= 0.97 * known.count()
    scores = quality.score(docs, quality.learn(docs, labels)).filter(sampling.held_out("doc_id")).join(labels, "doc_id").toPandas()
    good, bad = scores[scores.quality == 1].score.to_numpy(), scores[scores.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9

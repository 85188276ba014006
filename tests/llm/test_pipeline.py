"""The pipeline's stages against brute force on a small table."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_ngram_join import brute as groups_of
from tests.llm.test_substring_dedup import brute as kept_of


def test_stages(spark, tmp_path):
    r = random.Random(9)
    english, french = [f"the{x}" for x in "abcdefgh"] + ["the", "and", "house", "garden", "of"], ["la", "maison", "et", "le", "jardin", "rouge", "dans", "une", "été"]
    say = lambda words, n: " ".join(r.choices(words, k=n))
    passage, leak = say(english, 60), say(english, 30)
    rows = [(i, say(*((english, r.randint(40, 120)) if i % 2 else (french, r.randint(40, 120)))), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(60, None, "en"), (61, "12 34 !!", "fr"), (62, "", None), (63, rows[3][1], "en"), (64, rows[3][1].upper(), "en"), (65, rows[5][1] + " end", None)]
    rows += [(66 + k, f"{say(english, 90)} {passage} {say(english, 30)}", "en") for k in range(4)] + [(80, f"{say(english, 40)} {leak} {say(english, 40)}", "en")]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.known_language(spark, docs, folder)
    assert kept.columns == docs.columns
    rows = sorted((i, t) for i, t, _ in rows if i not in (60, 61, 62))
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == rows

    kept = P.first_of_near_copies(spark, kept, folder)
    groups = groups_of(rows, 5, 80, True)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    assert kept.columns == docs.columns and sorted((x.doc_id, x.text) for x in kept.collect()) == rows and not {63, 64, 65} & {i for i, _ in rows}

    kept = P.without_repeats(spark, kept, folder)
    by, gone = dict(rows), 0
    for i, _, removed, text in kept_of(rows, 50):
        by[i] = text if removed else by[i]
        gone += removed
    assert gone >= 150 and kept.columns == docs.columns
    assert sorted((x.doc_id, x.text, x.n_chars) for x in kept.collect()) == sorted((i, t, len(t)) for i, t in by.items())

    kept = P.without_leaks(spark, kept, folder)
    del by[80]
    assert kept.columns == docs.columns and sorted((x.doc_id, x.text) for x in kept.collect()) == sorted(by.items())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t).ids for i, t in by.items()}
    assert {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in P.token_ids(spark, kept, folder).collect()} == want
    assert {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in P.run(spark, folder).collect()} == want


CLASHING = ["row", "id", "kept_text", "n_removed", "score", "lang_pred", "out", "removed", "component_id", "n_tokens", "item_id", "key"]


def test_edges(spark, tmp_path):
    """Null ids, texts and languages, repeated rows, a very long text, columns named as the stages' own, and empty tables."""
    r = random.Random(11)
    english, french = [f"the{x}" for x in "abcdefgh"] + ["the", "and", "house", "garden", "of"], ["la", "maison", "et", "le", "jardin", "rouge", "dans", "une", "été"]
    say = lambda words, n: " ".join(r.choices(words, k=n))
    rows = [(i, say(english if i % 2 else french, 60), "en" if i % 2 else "fr") for i in range(40)]
    long = say(english, 120_000)
    rows += [(50, long, "en"), (51, None, None), (None, say(french, 70), "fr"), (52, say(english, 80), None)]
    rows += [rows[7], rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, lang, None, None, *CLASHING) for i, t, lang in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").limit(0).write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        got = kept.collect()
        assert sorted(map(str, (x.doc_id for x in got))) == sorted(str(i) for i, t, _ in rows if t is not None), name
        assert all(tuple(x[c] for c in CLASHING) == tuple(CLASHING) for x in got), name
        assert {x.doc_id: x.text for x in got}[52] == rows[43][1]
        none = stage(spark, docs.limit(0), folder)
        assert none.columns == docs.columns and none.count() == 0, name
        docs = kept
    ids = P.token_ids(spark, docs, folder).collect()
    assert len(ids) == len(rows) - 1 and max(x.n_tokens for x in ids) >= 120_000
    assert P.token_ids(spark, docs.limit(0), folder).count() == 0

"""The Jaccard join against all pairs."""

import random

import pytest

from llm import ngram_join


def brute(rows, n, percent, lower):
    sets = {}
    for i, t in rows:
        w = ((t or "").encode().lower() if lower else (t or "").encode()).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("frequent, small, percent", [(48, 48, 85), (2, 0, 60)])
def test_against_all_pairs(spark, monkeypatch, frequent, small, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    r = random.Random(frequent)
    vocabulary = [f"w{n}" for n in range(400)] + ["É", "ü"]
    passage = r.choices(vocabulary, k=40)
    rows = [(0, None), (1, " \n"), (2, "A b c"), (3, "a B c"), (4, "a b"), (5, "x " * 30), (6, "x " * 50)]
    texts = [r.choices(vocabulary, k=r.choice([3, 12, 60, 150])) for _ in range(12)]
    for i in range(7, 150):
        words = list(r.choice(texts))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.5:
            words = passage + words
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(t, i, 5) for i, t in rows], "text string, doc_id long, size int").repartition(3)
    for n, lower in (((4, True),) if percent == 85 else ((5, False),)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similarity_classes(docs, n, percent, lower).collect()}
        assert got == brute(rows, n, percent, lower)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted([tuple(x) for x in ngram_join.similarity_classes(docs).collect()], key=str)
    assert got == sorted([(1, 0, 1, 1), (None, 2, None, 3), (2, 2, 2, 3), (2, 2, 2, 3)], key=str)
    assert ngram_join.similarity_classes(docs.limit(0)).count() == 0


def test_sets_and_texts_are_not_sent_again(spark, monkeypatch):
    """Before, all sets were shuffled to tell the representatives, all postings to count them, and a hub's set went with each of its pairs."""
    tables, write = {}, ngram_join.staged

    def kept(df, name):
        tables.setdefault(name, []).append((df.columns, (out := write(df, name)).count()))
        return out

    monkeypatch.setattr(ngram_join, "staged", kept)
    monkeypatch.setattr(ngram_join, "dropped", lambda *tables: None)
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 4)
    r = random.Random(5)
    text = [f"w{n}" for n in range(300)]
    rows = [(i, " ".join(f"o{r.random()}" for _ in range(80))) for i in range(400)]
    rows += [(1000 + i, " ".join(text[:7 * i % 290] + ["x", str(i)] + text[7 * i % 290 :])) for i in range(30)]
    rows += [(2000, rows[3][1]), (2001, rows[405][1])]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.similarity_classes(docs, 4, 85, True).collect()}
    assert got == brute(rows, 4, 85, True)
    (_, picked), = tables["representatives"]
    assert 0 < picked < 100  # of 430
    assert "postings" not in tables and "sets" in tables and len(tables["sets"]) == 1
    (columns, n), = [x for x in tables["sides"] if x[1] > 4][:1]
    assert "deal" in columns and n >= 29

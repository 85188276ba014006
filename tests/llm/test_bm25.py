"""BM25 search against scoring every row."""

import math
import random
from collections import Counter

import numpy as np

from llm import bm25


def brute(rows, queries, top):
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    df = Counter(w for _, ws in texts for w in set(ws))
    n, average = len(texts), sum(len(ws) for _, ws in texts) / len(texts)
    out = []
    for q, t in queries:
        terms, scored = set((t or "").encode().lower().split()), []
        for i, ws in texts:
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w in terms if w in tf)
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_BYTES", 4_000)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 300)
    monkeypatch.setattr(bm25, "FIRST_ROWS", 20)
    monkeypatch.setattr(bm25, "TASK_ROWS", 10)
    monkeypatch.setattr(bm25, "WAVE", 3)
    r = random.Random(6)
    common, rare = [f"c{n}" for n in range(12)], [f"Rare{n}" for n in range(300)]
    rows = [(0, None), (1, " "), (2, "nobody has this"), (3, "c1 " * 3000)]
    rows += [(i, " ".join(r.choices(common, k=r.randint(1, 30)) + r.choices(rare, k=r.randint(0, 12)))) for i in range(4, 260)]
    rows += [(300 + k, rows[20][1]) for k in range(15)]
    docs = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, rank int").repartition(3)
    queries = [x for x in rows if x[0] % 10 == 0]
    got = sorted((x.query_id, x.rank, x.doc_id, x.score) for x in bm25.search(docs, docs.filter("doc_id % 10 = 0"), top=5).collect())
    want = brute(rows, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
    assert bm25.search(docs.limit(0), docs).count() == bm25.search(docs, docs.limit(0)).count() == 0


def test_skips_rows_below_the_threshold():
    r = np.random.default_rng(3)
    n, terms = 4000, 60
    row, at = np.nonzero(r.random((n, terms)) < np.geomspace(0.6, 0.002, terms))
    tf, words = r.integers(1, 4, len(row)), r.integers(20, 400, n)
    idf = np.linspace(0.5, 6, terms)
    shard, every = bm25.Shard(row, at, tf, words, idf, words.mean()), np.zeros((n, terms))
    every[row, at] = idf[at] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words[row] / words.mean()))
    for query in ([*range(terms)], [0, 1, 2], [59], [10, 30, 50]):
        full = np.round(every[:, query].sum(axis=1), 6)
        want = np.flatnonzero(full >= max(np.sort(full)[-10], 1e-9))
        rows, scores = shard.search(np.array(query), 10)
        assert set(rows) == set(want) and np.allclose(scores, full[rows], atol=2e-6)
        floor = np.sort(full)[-3]
        rows, scores = shard.search(np.array(query), 10, floor)
        assert set(rows) == set(np.flatnonzero((full >= floor) & (full > 0)))
    assert shard.scored < shard.seen / 4


def test_texts_are_cut_once_for_all_blocks_of_queries(spark, monkeypatch):
    """Several blocks of queries and several rounds read the table of terms, not the texts."""
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 100)
    monkeypatch.setattr(bm25, "FIRST_ROWS", 20)
    plans, staged = [], bm25.staged

    def seen(df, name):
        plans.append((name, "text#" in df._jdf.queryExecution().optimizedPlan().toString()))
        return staged(df, name)

    monkeypatch.setattr(bm25, "staged", seen)
    docs = spark.range(120).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 20), n -> concat('w', (id * n) % 37))) as text")
    docs = staged(docs, "texts")
    got = bm25.search(docs, docs.filter("doc_id % 5 = 0"), top=3)
    assert [n for n, read in plans if read] == ["query-terms", "index"] and sum(n == "best" for n, _ in plans) > 4
    assert got.groupBy("query_id").count().filter("count = 3").count() == 24

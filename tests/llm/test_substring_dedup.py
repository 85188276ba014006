"""Substring dedup against a direct reading of its definition."""

import random

from llm import substring_dedup
from llm.staging import sieved
from llm.substring_dedup import remove_repeats


def brute(rows, width):
    owner, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - width + 1):
            if i is not None:
                k = tuple(w[p : p + width])
                owner[k] = min(owner.get(k, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and owner[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(out, key=str)


def test_against_definition(spark):
    r = random.Random(3)
    words = ["a", "b", "ç", "dd"] + [f"w{n}" for n in range(60)]
    passage = [[r.choice(words) for _ in range(30)] for _ in range(4)]
    rows = [(None, "a " * 40), (1, None), (2, ""), (3, " \n\t "), (900, "a " * 60), (901, "a " * 30), (2000, " x " * 15)]
    for i in range(4, 80):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts += r.choice(passage)[r.randint(0, 8) :] if r.random() < 0.6 else r.choices(words, k=r.randint(0, 30))
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [rows[-1], (1000, rows[-2][1])]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, n_words string")
    for width in (10, 7, 2):
        got = [(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in remove_repeats(docs, width).collect()]
        assert sorted(got, key=str) == brute(rows, width)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_equal_stretches_are_not_taken_apart(spark, monkeypatch):
    """Before, every window of every copy was a row of its own."""
    sizes, write = {}, substring_dedup.staged

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "staged", counted)
    r = random.Random(7)
    passage = [f"p{n}" for n in range(2000)]
    own = lambda: [f"o{r.random()}" for _ in range(80)]
    rows = [(i, " ".join(own() + passage + own())) for i in range(8)] + [(3, " ".join(passage + passage)), (9, " ".join(passage[500:900]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in remove_repeats(docs).collect()]
    assert sorted(got, key=str) == brute(rows, 50)
    assert 0 < sizes["windows"] < 1000  # of more than 18,000


def test_sieve_lets_all_partners_through(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(1).getrandbits(63) for _ in range(500))]
    table = spark.createDataFrame([(k,) for k in keys], "k long")
    docs = spark.createDataFrame([(k,) for k in keys] + [(k ^ 1 << 40 ^ 77,) for k in keys] + [(None,)], "k long")
    out = sieved(docs, docs["k"], table)
    assert out.columns == ["k", "maybe"] and out.count() == len(keys) * 2 + 1
    assert {x.k for x in out.filter("maybe").collect()} >= set(keys) and out.filter("not maybe").count() > len(keys) // 2
    assert sieved(docs, docs["k"], table.limit(0)).filter("maybe").count() == 0

"""Decontamination against an unbanded alignment of every item with every document."""

import random

import numpy as np

from llm import decontamination as D


def distance(item: bytes, text: bytes) -> int:
    """Least edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def edited(r, s, n):
    s = list(s)
    for _ in range(n if len(s) > n else 0):
        p, kind = r.randrange(len(s)), r.randrange(3)
        if kind == 0:
            s[p] = r.choice("abcxyz")
        elif kind == 1:
            del s[p]
        else:
            s.insert(p, r.choice("abc "))
    return "".join(s)


def test_against_full_alignment():
    r = random.Random(8)
    syllables = ["the", "on", "er", "ß", "ing ", " of", "a", " "]
    say = lambda n: "".join(r.choices(syllables, k=n))
    items = [say(k) for k in (1, 2, 4, 9, 20, 40, 60)]
    known = D.Items(list(range(len(items))), [D.plain(t) for t in items], q=4, share=0.1)
    texts = [say(r.randint(0, 30)) + (edited(r, r.choice(items), r.randint(0, 7)) if r.random() < 0.7 else "") + say(r.randint(0, 10)) for _ in range(60)]
    data = [t.encode() for t in texts]
    b, off, _ = D.normal(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    got = {(t, known.ids[i]): (a, z, e) for t, i, a, z, e in known.find(b, off)}
    for t in range(len(texts)):
        text = b[off[t] : off[t + 1]].tobytes()
        for n, item in enumerate(known.texts):
            best = distance(item, text)
            assert ((t, known.ids[n]) in got) == (best <= known.edits[n])
            if (t, known.ids[n]) in got:
                a, z, e = got[t, known.ids[n]]
                assert e == best and off[t] <= a <= z <= off[t + 1]
                assert distance(item, b[a:z].tobytes()) == e


def test_frames(spark):
    passage = "The quick brown fox jumps over the lazy dog and then it sleeps for a very long while."
    rows = [(1, f"xx {passage} yy"), (2, passage.upper().replace(" ", "\n ")), (3, passage.replace("fox", "fux").replace("lazy", "lazzy")), (4, "nothing here"), (5, None), (6, ""), (7, "z " * 60_000 + passage), (7, "z " * 60_000 + passage), (None, passage)]
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, item_id int")
    items = spark.createDataFrame([(10, passage), (11, None), (12, " "), (13, passage), (14, "something else that is long enough to have some grams")], "item_id long, text string")
    got = D.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_edits) for r in got if r.doc_id) == sorted((i, k, 2 if i == 3 else 0) for i in (1, 2, 3, 7, 7) for k in (10, 13))
    one = next(r for r in got if r.doc_id == 1)
    assert rows[0][1].encode()[one.begin : one.end].decode() == passage
    assert D.contaminated(docs, items.limit(0)).count() == D.contaminated(docs.limit(0), items).count() == 0


def test_parts(spark, monkeypatch):
    items = spark.createDataFrame([(n, f"item number {n} has a text of its own, {'abcdefghij'[n]} indeed") for n in range(10)], "item_id long, text string")
    docs = items.select(items.item_id.alias("doc_id"), "text")
    want = sorted(map(tuple, D.contaminated(docs, items).collect()))
    monkeypatch.setattr(D, "PART_BYTES", 100)
    assert sorted(map(tuple, D.contaminated(docs, items).collect())) == want


def test_replaced_words_are_found():
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(400)]
    items = [" ".join(r.choices(words, k=r.randint(16, 50))) for _ in range(60)]
    known = D.Items(list(range(60)), [D.plain(t) for t in items], words=2)
    for replaced, least in ((1, 1.0), (2, 0.95)):
        texts = []
        for item in items:
            cut = item.split()
            for k in r.sample(range(len(cut)), replaced):
                cut[k] = r.choice(words)
            texts.append(" ".join(r.choices(words, k=80)) + " " + " ".join(cut) + " " + " ".join(r.choices(words, k=80)))
        data = [t.encode() for t in texts]
        b, off, _ = D.normal(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        found = {(t, i) for t, i, *_ in known.find(b, off)}
        assert len({(n, n) for n in range(60)} & found) >= least * 60 and not {(t, i) for t, i in found if t != i}


def test_items_of_one_text_split_by_row(spark, monkeypatch):
    text = "this very text stands in every row of the table that is compared"
    items = spark.createDataFrame([(7, text)] * 9, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text)], "doc_id long, text string")
    monkeypatch.setattr(D, "PART_BYTES", 2 * len(text))
    assert [tuple(r)[:2] for r in D.contaminated(docs, items).collect()] == [(1, 7)] * 9

"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from llm import importance as I

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[k : k + m]) for m in range(1, longest + 1) for k in range(len(words) - m + 1)]


def expected(rows, target, percent, least, longest, buckets, seed):
    s, t = Counter(), Counter()
    for count, texts in ((s, [x for _, x in rows]), (t, target)):
        count.update(zlib.crc32(g.encode()) % buckets for x in texts for g in grams(x, longest))
    big_s, big_t = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for key, text in rows:
        f = grams(text, longest)
        weight = sum(gain(zlib.crc32(g.encode()) % buckets) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(grams(text, 1))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0]))
    rank = {}
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        rank.setdefault(r[0], []).append(n)
    return sorted((*r[:4], rank.get(r[0], [None])[0]) for r in out)


def test_hashes():
    r = random.Random(1)
    items = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(70), 500] * 2]
    data, size = np.frombuffer(b"".join(items), np.uint8), np.array([len(x) for x in items])
    starts = np.cumsum(size) - size
    assert I.xxh64(data, starts, size).tolist() == [xxhash.xxh64_intdigest(x) for x in items]
    assert I.crc32(data, starts, size).tolist() == [zlib.crc32(x) for x in items]


def test_equal_keys_of_unequal_bytes_take_separate_slots():
    data = np.frombuffer(b"aaabbbaaacccbbb", np.uint8)
    slot, holder = I.intern(data, np.arange(0, 15, 3), np.full(5, 3), np.full(5, 7, np.uint64))
    assert slot[0] == slot[2] and slot[1] == slot[4] and len(set(slot)) == len(holder) == 3


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("limit", [16, 100, 1 << 19])
def test_slices_of_long_texts_count_each_feature_once(longest, limit):
    texts = ["Ab c-d é a b", None, "", "x" * 100 + " y " * 40, "Zz " * 300, "ü" * 50 + "!" + "hello World 9" * 20]
    found, per, words = Counter(), np.zeros(len(texts), int), np.zeros(len(texts), int)
    for lo, hi, data, off, carried in I._slices(pa.array(texts), longest, limit):
        f = I.features(data, off, longest, 1000, carried)
        assert (np.bincount(f.slot, minlength=len(f.count)) == f.count).all()
        found.update(f.bucket[f.slot].tolist())
        per[lo:hi] += np.bincount(f.text, minlength=hi - lo)
        words[lo:hi] += f.words
        words[lo] -= carried
    assert found == Counter(zlib.crc32(g.encode()) % 1000 for t in texts for g in grams(t, longest))
    assert per.tolist() == [len(grams(t, longest)) for t in texts] and words.tolist() == [len(grams(t, 1)) for t in texts]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, longest):
    r = random.Random(3)
    say = lambda n: " ".join(r.choices(["the", "Of", "größe", "a1", "x", "rare-word", "END."], k=n))
    rows = [(k, say(r.randint(0, 40))) for k in range(120)] + [(200, None), (201, ""), (202, "... !"), (203, "w " * 50_000), (3, say(30))]
    target = [say(10), None, "the of the größe " * 20]
    docs = spark.createDataFrame([(t, k, 1) for k, t in rows], "text string, doc_id long, item_id int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.resample(docs, wanted, 40, 10, longest=longest, buckets=50, seed=7)
    got = sorted((tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=lambda x: x[:4])
    want = expected(rows, target, 40, 10, longest, 50, 7)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    one = lambda rows: {x[0]: x[4] for x in rows if x[0] != 3}
    assert one(got) == one(want)
    assert sorted(x[4] for x in got if x[4]) == list(range(1, 1 + 40 * sum(len(grams(t, 1)) >= 10 for _, t in rows) // 100))


def test_ties_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in (5, 5, 5, 9)] + [(None, "one two")], "doc_id long, text string")
    got = I.resample(docs, docs, 100, 1).orderBy("rank").collect()
    assert [x.rank for x in got] == [1, 2, 3, 4, 5] and len({x.score for x in got if x.doc_id == 5}) == 1
    assert I.resample(docs.limit(0), docs, 50).count() == 0
    assert all(x.weight <= 0 for x in I.resample(docs, docs.limit(0), 50).collect())

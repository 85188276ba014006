"""Product codes against all distances."""

import hashlib

import numpy as np
import pytest

from llm import vector_codes as V


def nearest(x, books):
    far = ((x.reshape(len(x), books.shape[0], 1, books.shape[2]) - books[None]) ** 2).sum(-1)
    return far.argmin(2), far.min(2)


def means(x, own, books):
    new = books.copy()
    cut = x.reshape(len(x), books.shape[0], books.shape[2])
    for j in range(books.shape[0]):
        for e in range(books.shape[1]):
            if len(mine := cut[own[:, j] == e, j]):
                new[j, e] = mine.sum(0) // len(mine)
    return new


@pytest.mark.parametrize("scale", [4, 40, 10**6, 10**8])
@pytest.mark.parametrize("k, b", [(64, 8), (64, 1), (5, 3), (2, 1), (1, 3), (64, 63)])
def test_bounds_never_change_an_assignment(scale, k, b):
    r = np.random.default_rng(k + b)
    x = r.integers(-scale, scale, (300, 12))
    x[::7] = x[3]
    books = np.ascontiguousarray(x[:k].reshape(k, 4, 3).transpose(1, 0, 2))
    lists, dist = V.first_lists(x, books, b)
    for _ in range(4):
        own, far = nearest(x, books)
        assert (lists.own == own).all() and (dist == far).all()
        new = means(x, own, books)
        moves = V._roots(((new - books) ** 2).sum(axis=2), V.MARGIN) + V.MARGIN
        books = new
        lists, dist, depths = V.moved_lists(x, books, moves, V.Lists.unpacked(lists.packed(), 4))
        lists = V.adapted(lists, depths, k)


def expected(rows, parts, entries, rounds):
    kept = [(i, label, np.floor(256 * np.array(v, dtype=float)).astype(int)) for i, label, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for *_, v in kept])
    head = np.argsort([i for i, *_ in kept], kind="stable")[:entries]
    books = np.ascontiguousarray(x[head].reshape(len(head), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = means(x, nearest(x, books)[0], books)
    own, far = nearest(x, books)
    error = far.sum(1)
    by = {}
    for (_, label, _), e in zip(kept, error.tolist()):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((i, label, bytes(o.astype(np.uint8)).hex(), e, by[label], digest) for (i, label, _), o, e in zip(kept, own, error.tolist())), key=str)


@pytest.mark.parametrize("n, rounds", [(300, 2), (300, 4), (5, 2), (1, 1)])
def test_compress(spark, n, rounds):
    r = np.random.default_rng(n)
    rows = [(int(i), [None, 1, 2][i % 3], [float(c) for c in np.round(r.normal(0, 0.3, 8), 3)]) for i in r.permutation(n)]
    rows += [(1000, 1, None), (1001, 1, [0.1] * 7 + [None]), (1002, 1, [float("nan")] + [0.0] * 7), (1003, 2, [float("inf")] * 8)]
    if n > 100:
        rows += [rows[0], (2000, None, rows[1][2])]
    df = spark.createDataFrame([(v, i, label, "x") for i, label, v in rows], "embedding array<double>, vec_id long, label int, code string")
    got, books = V.compress(df, parts=4, entries=16, rounds=rounds, b=2)
    assert books.shape == (4, min(n, 16), 2)
    assert sorted((tuple(x) for x in got.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == expected(rows, 4, 16, rounds)


def test_empty_and_uneven(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty, _ = V.compress(spark.createDataFrame([], schema), parts=4)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "label", "code"]
    rows = spark.createDataFrame([(1, [0.0] * 8, 1), (2, [1.0] * 4, 1), (3, [2.0] * 8, None)], schema)
    assert sorted(r.vec_id for r in V.compress(rows, parts=4)[0].collect()) == [1, 3]
    with pytest.raises(ValueError):
        V.compress(rows, parts=3)

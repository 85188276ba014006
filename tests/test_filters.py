"""The filter language, row formats and access rules on small tables."""

import pytest
from pyspark.sql import functions as F

from terrafold.operators import filters

ROWS = [("r1", "alice", "ma", 34.0), ("r2", "bob", "tx", 7.0), ("r3", "maria", "or", 34.5), ("r4", "", None, 0.0)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id string, name string, state string, age double")


@pytest.mark.parametrize(
    "text, want",
    [
        ("", "r1 r2 r3 r4"),
        ("ma", "r1 r3"),
        ("state: ma", "r1"),
        ("state: or", "r3"),
        ("age: > 10", "r1 r3"),
        ("age: = 34", "r1"),
        ("age: != 34", "r2 r3 r4"),
        ("name: != bob", "r1 r3"),
        ("not ma", "r2 r4"),
        ("state: tx or ma", "r1 r2 r3"),
        ("state: (tx or ma)", "r1 r2"),
        ("age: > 3 name", ""),
        ("nul", "r4"),
        ("NAME: Alice and state: MA", "r1"),
        ("missing: x", ""),
        ("'ma' ) (", "r1 r3"),
        ("(state: tx) or (age: >= 34.5)", "r2 r3"),
        ("not not bob", "r2"),
    ],
)
def test_filter(people, text, want):
    got = filters.filter_rows(people, text, types={"id": "skip"})
    assert sorted(r.id for r in got.collect()) == want.split()


def test_strict_null(people):
    assert filters.filter_rows(people, "nul", types={"id": "skip"}, strict=True).count() == 0


@pytest.mark.parametrize("text", ["ma", "state: ma", "a and b or not c", "age: > 10 or x", "state: (tx or ma)", "'and' b", "(a or b) c: (d)"])
def test_shown_tree_parses_to_itself(text):
    tree = filters.parse(text)
    assert filters.parse(str(tree)) == tree


def test_tree_operations():
    tree = filters.parse("state: ma and age: > 3")
    clause = filters.parse("age: > 3")
    assert filters.contains_clause(tree, clause) and filters.add_clause(tree, clause) == tree
    assert filters.remove_clause(tree, clause) == filters.parse("state: ma")
    assert filters.remove_clause(filters.parse("x"), filters.parse("x")) is None


def test_filter_is_pushed_as_one_filter(people):
    plan = filters.filter_rows(people, "age: > 10 and state: ma")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_detail(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0), (None, 1.0)], "a double, b double")
    for text, want in (("=a / b", [0.5, 0, 0]), ("=a / (b - b)", [0, 0, 0]), ("=2 * (a + b) / -b", [-3.0, 0, 0]), ("=a + nothing", [0, 0, 0]), ("=a; drop", [0, 0, 0]), ("=a > 2 ? b : a * 2", [2.0, 0, 0]), ("=(a) ? a : 7", [1.0, 3.0, 7.0]), ("=!b || a == 1 ? 1 : 2", [1.0, 1.0, 2.0]), ("=a > 1", [0, 0, 0]), ("=a ? 1", [0, 0, 0]), ("='x'", None)):
        if want is not None:
            assert [r[0] for r in df.select(filters.detail(text, df.columns)).collect()] == want
    assert [r.Total for r in filters.row_total(df, ["a", "b"]).collect()] == [3.0, 3.0, 1.0]


def test_sessions_and_access(spark):
    rows = [("me", "x", False, "2024-01-09"), ("me", None, False, "2023-01-01"), ("me", None, True, "2024-01-09"), ("you", None, False, "2023-01-01")]
    s = spark.createDataFrame(rows, "createdBy string, published string, deleted boolean, modifyTime string").withColumn("modifyTime", F.to_timestamp("modifyTime"))
    modes = filters.session_mode("me", F.to_timestamp(F.lit("2024-01-10")))
    assert {m: s.filter(c).count() for m, c in modes.items()} == {"public": 1, "shared": 1, "trash": 1, "recent": 1, "owned": 2}
    odd = spark.createDataFrame([("me", None, None, None), (None, "", True, None)], "createdBy string, published string, deleted boolean, modifyTime timestamp")
    assert {m: odd.filter(c).count() for m, c in modes.items()} == {"public": 1, "shared": 1, "trash": 0, "recent": 1, "owned": 1}
    entries = spark.createDataFrame([(1, ["u"], 1), (1, ["u", "v"], 2), (1, ["v"], 4), (2, [], 8)], "id int, userIDs array<string>, perm int")
    assert [tuple(r) for r in filters.access_map_permission(entries, ["id"], "u").collect()] == [(1, 3)]
    assert [r[0] for r in entries.select(filters.access_permission(F.struct("userIDs", "perm"), "u")).collect()] == [1, 2, 0, 8]

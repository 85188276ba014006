"""Every registered query of the engine against its SQL."""

import os

import pytest

from terrafold.plans import edit_queries, queries, shape_queries  # noqa: F401  (they register themselves)
from terrafold.plans.registry import ORACLES, QUERIES, query
from tests.against_sql import connect, rows_of, sql_rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(DATA)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    columns, rows = rows_of(QUERIES[name](spark, DATA))
    if name in ORACLES:
        known_columns, known = sql_rows(tables, ORACLES[name])
        assert columns == known_columns
        assert rows == known and rows
    else:
        assert rows


def test_interior_sharing_by_brute_force(spark):
    from collections import defaultdict

    from terrafold.plans.queries import order_boxes

    inner, ends = defaultdict(set), defaultdict(set)
    for r in order_boxes(spark, DATA).collect():
        pts = [tuple(p) for p in r.g[0][0]]
        for k, p in enumerate(pts):
            (ends if k in (0, len(pts) - 1) else inner)[p].add(r.id)
    want = {(p, len(a), len(ends[p] - a)) for p, a in inner.items() if len(a) >= 2 or ends[p] - a}
    got = {((r.x, r.y), r.n_interior, r.n_endpoint) for r in QUERIES["interior_sharing"](spark, DATA).collect()}
    assert got == want


def test_whole_joins_meet_boxes_of_every_id(spark):
    shape = lambda r: (*r.g[0][0][0], *r.g[0][0][2])
    from terrafold.plans.queries import customer_points, nation_boxes, order_boxes

    box = {}
    for k, x1, y1, x2, y2 in [(r.id, *shape(r)) for r in order_boxes(spark, DATA).collect()]:
        box[k] = (min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2))
    covered = {r.id for r in customer_points(spark, DATA).collect() if any(x1 < r.x < x2 and y1 < r.y < y2 for x1, y1, x2, y2 in box.values())}
    assert {r.id for r in QUERIES["assign_smallest"](spark, DATA).collect()} == covered
    met = set()
    for n, x1, y1, x2, y2 in [(r.id, *shape(r)) for r in nation_boxes(spark, DATA).collect()]:
        left, bottom, right, top = min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)
        met |= {(n, k) for k, (a, b, c, d) in box.items() if a < right and c > left and b < top and d > bottom}
    assert {(r.a, r.b) for r in QUERIES["spatial_overlap_join"](spark, DATA).collect()} == met
    assert {(r.a, r.b) for r in QUERIES["intersection_areas"](spark, DATA).collect()} == met


def test_splice_of_short_and_null_texts(spark, tmp_path):
    texts = ["", "ab", "abc", "abcde", "abcdefgh", "abcdefghij", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.edited, r.n_before, r.n_after) for r in QUERIES["edits_splice"](spark, str(tmp_path)).collect()}
    assert got == {k: (t[:3] + "<cut>" + t[8:], len(t), len(t[:3] + t[8:]) + 5) if t is not None else (None, None, None) for k, t in enumerate(texts)}


def test_grid_grows_with_its_table(spark):
    from terrafold.plans.queries import customer_cells

    small, large = (customer_cells(spark, d) for d in (DATA, "/root/testdata/sf0.01"))
    assert large.count() > 5 * small.count() > 5 * 25


def test_names_are_taken_once():
    with pytest.raises(ValueError):
        query()(QUERIES["topology_arcs"])


def test_simplification_where_a_northward_grid_would_reach_the_pole(spark, tmp_path):
    spark.range(1438 * 64, 1441 * 64).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    x, y = (lambda k: k % 64), (lambda k: k // 64)
    want = {f"c{k}": 5 + sum((x(k) + y(k) + n) % 3 == 0 for n in (0, 1, 1, 2)) for k in range(1438 * 64, 1441 * 64)}
    assert {r.id: r.n_points for r in QUERIES["shared_simplification"](spark, str(tmp_path)).collect()} == want

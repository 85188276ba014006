"""Topology, dissolving, simplification, clipping and adaptive cells on small inputs with known results."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import clipping, shapes, spatial, staging, topology

SCHEMA = f"id string, g {G.GEOMETRY}"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in g], *rest) for i, g, *rest in rows], schema)


def plain(g):
    return [[[(q.x, q.y) for q in r] for r in p] for p in g]


def test_island_in_a_hole_shares_its_arc(spark):
    """An island's ring and the hole that it fills are one arc, whatever point they begin with and whichever way they run."""
    island = box(2, 2, 1, 1)
    hole = [island[k] for k in (2, 1, 0, 3, 2)]
    rows = [("sea", [[box(0, 0, 6, 6), hole]]), ("isle", [[island]]), ("east", [[box(6, 0, 2, 6)], [box(20, 0, 1, 1)]])]
    df = frame(spark, rows)
    arcs, uses = topology.topology(df)
    assert sorted(r.n_uses for r in arcs.collect()) == [1, 1, 1, 2, 2] and uses.count() == 7
    again = {r.id: plain(r.g) for r in topology.rebuilt(arcs, uses).collect()}
    assert again == {i: [[[(float(x), float(y)) for x, y in r] for r in p] for p in g] for i, g in rows}
    assert topology.rebuilt(*topology.topology(df.limit(0))).count() == 0


def test_splice_keeps_the_last_of_an_id(spark):
    a = frame(spark, [("x", [[box(0, 0, 1, 1)]]), ("y", [[box(1, 0, 1, 1)]])])
    b = frame(spark, [("x", [[box(5, 5, 2, 2)]])])
    arcs, uses = topology.splice(("a", topology.topology(a), None), ("b", topology.topology(b), None))
    again = {r.id: plain(r.g) for r in topology.rebuilt(arcs, uses).collect()}
    assert again["x"] == [[[(float(x), float(y)) for x, y in box(5, 5, 2, 2)]]] and set(again) == {"x", "y"}
    assert {r.tag for r in uses.collect()} == {"a", "b"} and arcs.count() == uses.count()


def test_dissolve_pieces_holes_and_islands(spark):
    cells = [(x, y) for x in range(9) for y in range(9)]
    group = lambda x, y: "a" if max(abs(x - 4), abs(y - 4)) in (4, 3, 0) else "b"  # noqa: E731  a frame two wide, with an island in it
    rows = [(f"{x},{y}", [[box(x, y, 1, 1)]], group(x, y)) for x, y in cells if (x, y) != (8, 8)] + [("far", [[box(8, 8, 1, 1)[::-1]]], "c"), ("tip", [[box(9, 9, 1, 1)]], "c")]
    got = {r.k: plain(r.g) for r in topology.dissolved(frame(spark, rows, SCHEMA + ", k string"), "k").collect()}
    area = lambda p: clipping.ring_area(np.array(p[0])) - sum(clipping.ring_area(np.array(h)) for h in p[1:])
    assert sorted((area(p), len(p)) for p in got["a"]) == [(1.0, 1), (55.0, 2)]
    assert sorted((area(p), len(p)) for p in got["b"]) == [(24.0, 2)]
    assert sorted((area(p), len(p)) for p in got["c"]) == [(1.0, 1), (1.0, 1)]  # two pieces that touch in a vertex
    again = topology.dissolved(frame(spark, rows, SCHEMA + ", k string").limit(0), "k")
    assert again.count() == 0


def test_long_ring_is_stitched(spark):
    rows = [(str(k), [[box(k, 0, 1, 1)]], 1) for k in range(300)]
    (r,) = topology.dissolved(frame(spark, rows, SCHEMA + ", k int"), "k").collect()
    assert len(r.g) == 1 and len(r.g[0][0]) == 603


def test_weights_and_crossings():
    line = np.array([(0, 0), (1, 1e-7), (2, 0), (3, 0.5), (4, 0)], dtype=float)
    w = topology.weights(line)
    assert w[0] == w[-1] == math.inf and w[1] < 1e-10 < min(w[2], w[3]) and np.allclose(topology.weights(line[::-1])[::-1][1:-1], w[1:-1], rtol=1e-6)
    assert topology.crosses(np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], dtype=float)) and not topology.crosses(np.array(box(0, 0, 1, 1), dtype=float))
    r = random.Random(1)
    for _ in range(50):
        ring = np.array([(r.random(), r.random()) for _ in range(7)])
        ring = np.concatenate([ring, ring[:1]])
        side = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
        e = list(zip(ring[:-1], ring[1:]))
        known = any(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for k, (a, b) in enumerate(e) for c, d in e[k + 1 :])
        assert topology.crosses(ring) == known


def test_simplification_keeps_shapes(spark):
    """A sliver of flat bumps loses its area without them: it keeps all points, and its neighbour keeps them too."""
    thin = [(0, 0), (0.01, 1e-7), (0.02, 0), (0.01, -1e-7), (0, 0)]
    upper = [(0, 0), (0.01, 1e-7), (0.02, 0), (0.02, 0.02), (0.01, 0.02 + 1e-7), (0, 0.02), (0, 0)]
    got = {r.id: r.n for r in topology.simplified(frame(spark, [("thin", [[thin]]), ("upper", [[upper]])])).select("id", F.size(G.points(F.col("g"))).alias("n")).collect()}
    assert got == {"thin": 5, "upper": 6}
    alone = topology.simplified(frame(spark, [("upper", [[upper]])])).select(F.size(G.points(F.col("g"))).alias("n")).first()
    assert alone.n == 5
    inner = frame(spark, [("u", [[upper]], 0.01, 0.02 + 5e-8)], SCHEMA + ", x double, y double")
    assert topology.simplified(inner, inner=("x", "y")).select(F.size(G.points(F.col("g"))).alias("n")).first().n == 7


def star(r, n):
    x, y = r.uniform(0, 3), r.uniform(0, 3)
    p = [(x + s * math.cos(t), y + s * math.sin(t)) for t, s in ((2 * math.pi * k / n, r.uniform(0.3, 2)) for k in range(n))]
    return np.array([*p, p[0]])


def test_clipping_agrees_with_areas_and_cells():
    r = random.Random(5)
    area = lambda g: sum(clipping.ring_area(x) * (1 if k == 0 else -1) for p in g for k, x in enumerate(p))
    column = lambda gs: pa.array([[[[{"x": float(x), "y": float(y)} for x, y in q] for q in p] for p in g] for g in gs])
    one, two = [[[star(r, 8)]] for _ in range(60)], [[[star(r, 8)]] for _ in range(60)]
    a, b = clipping.edges(column(one)), clipping.edges(column(two))
    clipping._centred(a, b)
    shared, _ = clipping.shared_areas(a, b)
    for g, h, s in zip(one, two, shared):
        assert abs(area(clipping.combined(g, h, "intersection")) - s) < 1e-8
        assert abs(area(clipping.combined(g, h, "union")) - (area(g) + area(h) - s)) < 1e-8
        assert abs(area(clipping.combined(g, h, "difference")) - (area(g) - s)) < 1e-8
    at = np.array([(x + 0.5, y + 0.5) for x in range(10) for y in range(10)])

    def boxes():
        x, y, w, h = r.randrange(5), r.randrange(5), r.randrange(1, 5), r.randrange(1, 5)
        rings = [np.array(box(x, y, w, h), dtype=float)]
        return [[*rings, np.array(box(x + 1, y + 1, 1, 1)[::-1], dtype=float)]] if w > 2 and h > 2 else [rings]

    for _ in range(150):  # borders that run together, corners that touch, holes
        g, h = boxes(), boxes()
        p, q = (clipping.inside([x for y in s for x in y], at) for s in (g, h))
        for op, want in (("intersection", p & q), ("union", p | q), ("difference", p & ~q)):
            made = clipping.combined(g, h, op)
            assert area(made) == want.sum()
            assert (clipping.inside([x for y in made for x in y], at) == want).all()


def test_long_rings_and_empty_geometries(spark):
    r = random.Random(2)
    ring = star(r, 2000)
    make = lambda x: [[[{"x": float(a), "y": float(b)} for a, b in x]]]
    rows = spark.createDataFrame([(1, make(ring), make(ring)), (2, None, make(ring)), (3, [], make(ring))], f"k int, ga {G.GEOMETRY}, gb {G.GEOMETRY}")
    got = {x.k: x for x in clipping.with_shared_areas(rows).collect()}
    assert abs(got[1].shared - clipping.ring_area(ring)) < 1e-9 and got[2].shared == got[3].shared == 0.0
    assert {x.k: len(x.g) for x in clipping.with_combined(rows, "difference").collect()} == {1: 0, 2: 0, 3: 0}


def test_nesting(spark):
    rings = [box(3, 3, 1, 1), box(0, 0, 10, 10), box(1, 1, 7, 7), box(2, 2, 4, 4), box(20, 0, 2, 2)]
    (r,) = clipping.clean_holes(frame(spark, [("f", [[x] for x in rings])])).collect()
    sides = sorted(tuple(sorted({(q.x, q.y) for q in x})[0][0] for x in p) for p in r.g)
    assert sides == [(0.0, 1.0), (2.0, 3.0), (20.0,)]
    many = [[box(4 * k, 0, 3, 3)] for k in range(12)] + [[box(4 * k + 1, 1, 1, 1)] for k in range(12)]
    (r,) = clipping.clean_holes(frame(spark, [("f", many)])).collect()
    assert len(r.g) == 12 and all(len(p) == 2 for p in r.g)


def test_farthest_points():
    r = np.random.default_rng(4)
    for n in (3, 4, 7, 40):
        for _ in range(20):
            h = shapes.hull(r.normal(0, 1, (n, 2)))
            far = np.hypot(*(h[:, None] - h[None]).transpose(2, 0, 1)).max()
            assert abs(shapes.farthest(h) - far) < 1e-12
    t = np.linspace(0, 2 * math.pi, 100_000, endpoint=False)
    assert abs(shapes.farthest(np.stack([np.cos(t), np.sin(t)], axis=1)) - 2) < 1e-9
    assert shapes.farthest(np.array([(0.0, 0.0), (3.0, 4.0)])) == 5.0


def test_crowded_cells(spark):
    """A third of all points in one place, another in one small box: leaves hold few points, joins find the same rows as one grid."""
    r = random.Random(7)
    points = [(k, *((0.123, 0.456) if k % 3 == 0 else (r.uniform(0, 0.01), r.uniform(0, 0.01)) if k % 3 == 1 else (r.uniform(0, 50), r.uniform(0, 50)))) for k in range(3000)]
    p = spark.createDataFrame([*points, (9000, None, 1.0), (9001, 900.0, 1.0)], "id int, x double, y double")
    boxes = [(f"b{k}", [[box(r.uniform(0, 40), r.uniform(0, 40), r.uniform(0.1, 9), r.uniform(0.1, 9))]]) for k in range(40)] + [("all", [[box(-1, -1, 60, 60)]])]
    f = frame(spark, boxes).withColumnRenamed("id", "district")
    pairs = lambda df: sorted((x.p, x.f) for x in df.collect())
    got = pairs(spatial.points_within(p, f, limit=20, depth=16))
    assert got == pairs(spatial.points_in(p.filter("x is not null"), f, 5.0)) and len(got) > 3000
    leaves = spatial.adaptive_cells(p.filter("x < 60"), 20, 16)
    sizes = leaves.of_points(p.filter("x < 60")).groupBy("level", "cx", "cy").agg(F.count("*").alias("n"), F.countDistinct("x").alias("d")).collect()
    assert all(s.n <= 20 or s.d == 1 or s.level == 16 for s in sizes) and max(s.level for s in sizes) == 16
    one = frame(spark, boxes[:20])
    met = {(x.a, x.b) for x in clipping.overlaps(one, one, "id", "id", limit=3).collect()}
    corner = {i: (*map(min, zip(*g[0][0])), *map(max, zip(*g[0][0]))) for i, g in boxes[:20]}
    assert met == {(i, j) for i, a in corner.items() for j, b in corner.items() if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]}


def test_labels_and_circles(spark):
    rows = [("given", [[box(0, 0, 2, 2)]], {"INTPTLON": "0.5", "INTPTLAT": "0.25"}), ("outside", [[box(0, 0, 2, 2)]], {"INTPTLON": "5", "INTPTLAT": "5"}), ("none", [[box(0, 0, 2, 2)]], {}), ("own", [[box(0, 0, 2, 2)]], {"labelx": "9", "labely": "8"})]
    got = {r.id: (r.x, r.y) for r in shapes.with_label(frame(spark, rows, SCHEMA + ", properties map<string,string>")).collect()}
    assert got == {"given": (0.5, 0.25), "outside": (1.0, 1.0), "none": (1.0, 1.0), "own": (9.0, 8.0)}
    r = spark.range(1).select(shapes.circle_polygon(F.lit(1.0), F.lit(2.0), F.lit(3.0), 9).alias("c"), shapes.circle_polygon(F.lit(1.0), F.lit(2.0), F.lit(0.0)).alias("n")).first()
    ring = r.c[0][0]
    assert r.n is None and len(ring) == 37 and ring[0] == ring[-1] and all(abs(math.hypot(q.x - 1, q.y - 2) - 3) < 1e-9 for q in ring)


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        staging.shared_dir(Session())
    t = staging.staged(spark.range(3), "t")
    assert t.count() == 3
    staging.dropped(t)
    with pytest.raises(Exception, match="(?i)not exist|not_found"):
        spark.read.parquet(t.staged_path)


def test_label_points_of_a_batch(spark):
    """Every kind of shape in one batch, whose search is one array."""
    ell, holed = [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]], [box(0, 0, 4, 4), box(1.5, 1.5, 1, 1)]
    rows = [("box", [[box(0, 0, 6, 2)]]), ("ell", [ell]), ("holed", [holed]), ("two", [[box(0, 0, 1, 1)], [box(5, 5, 3, 3)]]), ("empty", [])]
    got = {r.id: (r.x, r.y, r.distance) for r in shapes.labelled(frame(spark, rows)).collect()}
    assert set(got) == {"box", "ell", "holed", "two"} and got["box"] == (1.0, 1.0, 1.0) and got["two"] == (6.5, 6.5, 1.5)
    for name, rings, least in (("ell", ell, 0.5), ("holed", holed, 0.75)):
        x, y, far = got[name]
        assert clipping.inside([np.array(r, dtype=float) for r in rings], np.array([[x, y]])).all() and far >= least
    labelled = shapes.with_label(frame(spark, [(*r, {}) for r in rows], SCHEMA + ", properties map<string,string>"))
    assert {r.id: r.x for r in labelled.collect()} == {**{k: round(v[0], 6) for k, v in got.items()}, "empty": None}


def test_properties_of_labels_are_taken_once(spark):
    """An expression that gives the properties is in the plan once, and the rows without a point are searched where they are."""
    text = F.concat(F.lit("0."), F.col("k").cast("string"))
    rows = spark.range(1, 9).select(F.col("id").alias("k"), F.col("id")).select("id", G.box_polygon(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("g"), F.create_map(F.lit("INTPTLON"), text, F.lit("INTPTLAT"), text).alias("properties"))
    out = shapes.with_label(rows).filter("x < 0.55")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map(INTPTLON") == 1 and "Join" not in plan
    assert [r.id for r in out.orderBy("id").collect()] == [1, 2, 3, 4, 5]


def test_equal_points_and_features_meet_once(spark, monkeypatch):
    """Many points in few places, and copies of few geometries: pairs are those of places and geometries, rows those of all points."""
    p = spark.range(2000).select("id", (F.col("id") % 3 * 2 + 0.5).alias("x"), F.lit(0.5).alias("y")).unionByName(spark.createDataFrame([(9000, None, 1.0)], "id long, x double, y double"))
    f = spark.range(2000).select(F.concat(F.lit("f"), F.col("id") + 1000).alias("district"), G.box_polygon(F.lit(0.0), F.lit(1.0), 1.0 + F.col("id") % 4, F.lit(0.0)).alias("g"))
    sizes, met = [], spatial.points_in
    monkeypatch.setattr(spatial, "points_in", lambda points, features, *rest, **named: sizes.append((points.count(), features.count())) or met(points, features, *rest, **named))
    got = spatial.assign_smallest(p, f, 1.0, area="area").collect()
    assert sizes == [(3, 4)] and len(got) == 1334
    assert {(r.id % 3, r.district) for r in got} == {(0, "f1000"), (1, "f1002")} and all(r.area > 0 for r in got)
    assert {(r.id, r.district) for r in spatial.assign_smallest(p, f).collect()} == {(r.id, r.district) for r in got}


def test_operations_of_a_batch_are_cut_once(spark):
    """Several operations of one pass over a batch in which every row differs, some with several pieces, common borders or nothing."""
    r = random.Random(9)
    square = lambda n: [[box(3 * k, 2 * (k % 2), 2, 2)] for k in range(n)]
    rows = [(k, square(k % 4), [[box(r.choice([0, 1, 2]), r.choice([-1, 0, 1, 2]), 1 + k % 5, 2)]] if k % 7 else []) for k in range(300)]
    made = frame(spark, [(str(k), g, k) for k, g, _ in rows], SCHEMA + ", k int").join(frame(spark, [(str(k), h) for k, _, h in rows]).withColumnRenamed("g", "gb"), "id").withColumnRenamed("g", "ga").repartition(1)
    got = clipping.with_combined(made, {"shared": "intersection", "both": "union", "rest": "difference"})
    area = lambda c: F.round(G.area_flat(F.col(c)), 9)
    flat = {x.k: (x[1], x[2], x[3], x.n) for x in got.select("k", area("shared"), area("both"), area("rest"), F.size("shared").alias("n")).collect()}
    for k, g, h in rows:
        low = lambda q: (*map(min, zip(*q)), *map(max, zip(*q)))
        met = [max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1])) for a in (low(p[0]) for p in g) for b in (low(p[0]) for p in h)]
        of = lambda s: sum((b[2] - b[0]) * (b[3] - b[1]) for b in (low(p[0]) for p in s))
        assert flat[k][:3] == (sum(met), of(g) + of(h) - sum(met), of(g) - sum(met))


@pytest.mark.parametrize("name", ["clipped_shapes", "nested_rings", "label_points"])
def test_only_keys_are_dealt_out(spark, name):
    """Boxes are made after the orders are dealt to all cores; what the maps give isn't shuffled again."""
    from terrafold.plans import shape_queries  # noqa: F401
    from terrafold.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan and "Project [o_orderkey" in plan.split("Repartition")[1]


def test_batches_are_as_many_rows(spark):
    """More rows than are nested at once."""
    n = 2 * clipping.ROWS + 5
    four = F.flatten(F.array(*(G.box_polygon(-F.col("id") - k, F.lit(10.0) + k, F.lit(5.0) + k, F.lit(1.0) - k) for k in (1, 3, 0, 2))))
    got = clipping.clean_holes(spark.range(0, n, 1, 1).select("id", four.alias("g"))).select("id", G.describe(F.col("g")).alias("d"), G.area_flat(F.col("g")).alias("a")).collect()
    side = lambda i, k: (i + 5 + 2 * k) * (9 + 2 * k)
    assert len(got) == n and all((r.d.npoly, r.d.nhole) == (2, 2) and r.a == side(r.id, 3) - side(r.id, 2) + side(r.id, 1) - side(r.id, 0) for r in got)

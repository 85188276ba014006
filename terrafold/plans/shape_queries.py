"""Registered queries of topology, clipping and placing, over grids and boxes that grow with the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import clipping, shapes, spatial, topology
from terrafold.operators.staging import staged
from terrafold.plans.queries import _BOXES, _CELLS, _POINTS, customer_points, nation_boxes, order_boxes
from terrafold.plans.registry import query, table

# topology: a cell for each customer, 64 in a row, with a point in the middle of each side


def notched_cells(spark, d, scale=1.0, bump=None, east=False):
    """Cells of side ``scale``; ``bump`` gives the height of the middle of the side from (x, y), upright or not, in sides.

    With ``east`` the rows, whose number grows with the table, follow each other eastward, so that latitudes stay below 64 sides.
    """
    c = table(spark, d, "customer")
    x, y = F.col("c_custkey") % 64, F.floor(F.col("c_custkey") / 64)
    at = lambda u, v: G.point(v * scale, u * scale) if east else G.point(u * scale, v * scale)
    across = lambda u, v: at(u + 0.5, v + (bump(u, v, 0) if bump else 0))
    upright = lambda u, v: at(u + (bump(u, v, 1) if bump else 0), v + 0.5)
    ring = F.array(at(x, y), across(x, y), at(x + 1, y), upright(x + 1, y), at(x + 1, y + 1), across(x, y + 1), at(x, y + 1), upright(x, y), at(x, y))
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_nationkey", F.array(F.array(ring)).alias("g"))


_RECURSIVE = _CELLS.replace("WITH c AS", "WITH RECURSIVE c AS")


@query(_RECURSIVE + """, u AS (SELECT ax * 1000000 + ay * 2 + (bx = ax)::INT AS e, ax, ay, bx, "by", count(*) AS n FROM s GROUP BY ALL),
  p AS (SELECT px, py FROM (SELECT x AS px, y AS py FROM c UNION ALL SELECT x + 1, y FROM c UNION ALL SELECT x, y + 1 FROM c UNION ALL SELECT x + 1, y + 1 FROM c) GROUP BY ALL HAVING count(*) = 1),
  t AS (SELECT e, ax AS px, ay AS py FROM u UNION ALL SELECT e, bx, "by" FROM u),
  l AS (SELECT a.e AS a, b.e AS b FROM t a JOIN p USING (px, py) JOIN t b USING (px, py) WHERE a.e <> b.e),
  r AS (SELECT e, e AS f FROM u UNION SELECT r.e, l.b FROM r JOIN l ON l.a = r.f),
  k AS (SELECT e, min(f) AS arc FROM r GROUP BY 1),
  z AS (SELECT arc, px, py FROM t JOIN k USING (e) GROUP BY ALL HAVING count(*) = 1),
  y AS (SELECT arc, min(px * 1000000 + py) AS lo, max(px * 1000000 + py) AS hi FROM z GROUP BY 1)
  SELECT (lo // 1000000)::INT AS ax, (lo % 1000000)::INT AS ay, (hi // 1000000)::INT AS bx, (hi % 1000000)::INT AS "by", (2 * count(*) + 1)::INT AS n_points, max(n) AS n_uses
  FROM k JOIN u USING (e) JOIN y USING (arc) GROUP BY arc, lo, hi""")
def topology_arcs(spark, d):
    """Arcs by their two ends: sides of cells, put together where only one cell has the corner between them."""
    arcs, _ = topology.topology(notched_cells(spark, d))
    p, q = F.element_at("pts", 1), F.element_at("pts", -1)
    low, high = F.least(p, q), F.greatest(p, q)
    return arcs.select(*(e[c].cast("int").alias(f"{n}{c}") for n, e in (("a", low), ("b", high)) for c in "xy"), F.size("pts").alias("n_points"), "n_uses")


@query(_CELLS + """SELECT 'c' || k AS id, true AS same, 9 AS n_points, 1.0::DOUBLE AS flat FROM c""")
def topology_round_trip(spark, d):
    """Features cut into arcs and put together again, against themselves."""
    cells = notched_cells(spark, d)
    again = topology.rebuilt(*topology.topology(cells)).join(cells.select("id", F.col("g").alias("was")), "id")
    return again.select("id", (F.col("g") == F.col("was")).alias("same"), F.size(G.points(F.col("g"))).alias("n_points"), G.area_flat(F.col("g")).alias("flat"))


@query(_CELLS + """, u AS (SELECT DISTINCT ax, ay, bx, "by" FROM s WHERE k % 5 <> 1 AND NOT (k % 2 = 0 AND k % 3 = 0)) SELECT count(*) AS n_sides, (SELECT count(*) FROM c WHERE k % 5 <> 1 AND NOT (k % 2 = 0 AND k % 3 = 0)) AS n_features FROM u""")
def topology_splice(spark, d):
    """Two tagged topologies, of the even and the odd cells, as one: hidden cells' sides go, shared ones are single. Sides are counted by their middles."""
    cells = notched_cells(spark, d)
    even, odd = (cells.filter(F.col("c_custkey") % 2 == k) for k in (0, 1))
    hidden = cells.filter("c_custkey % 5 = 1").select("id")
    thirds = even.filter("c_custkey % 3 = 0").select("id").unionByName(hidden)
    arcs, uses = topology.splice(("even", topology.topology(even), thirds), ("odd", topology.topology(odd), hidden))
    middle = lambda q: (q["x"] % 1 != 0) | (q["y"] % 1 != 0)
    sides = arcs.select(F.explode(F.filter("pts", middle)).alias("q")).distinct().agg(F.count("*").alias("n_sides"))
    return sides.crossJoin(uses.agg(F.countDistinct("id").alias("n_features")))  # one row each


@query(_RECURSIVE + """, e AS (SELECT a.k, b.k AS o FROM c a JOIN c b ON a.r = b.r AND ((b.y = a.y AND abs(a.x - b.x) = 1) OR (b.x = a.x AND abs(a.y - b.y) = 1))),
  w AS (SELECT k, k AS o FROM c UNION SELECT w.k, e.o FROM w JOIN e ON e.k = w.o), p AS (SELECT k, min(o) AS piece FROM w GROUP BY 1),
  b AS (SELECT r, count(*) AS n FROM (SELECT r, ax, ay, bx, "by" FROM s GROUP BY ALL HAVING count(*) = 1) GROUP BY 1)
  SELECT c.r AS c_nationkey, count(*)::DOUBLE AS area, count(DISTINCT piece)::INT AS n_polygons, 2 * any_value(n) AS n_segments FROM c JOIN p USING (k) JOIN b ON b.r = c.r GROUP BY 1""")
def dissolved_rings(spark, d):
    """Cells dissolved by nation: area, pieces, and segments of all rings (two a side)."""
    g = F.col("g")
    segments = F.aggregate(F.flatten(g), F.lit(0).cast("bigint"), lambda n, r: n + F.size(r) - 1)
    return topology.dissolved(notched_cells(spark, d), "c_nationkey").select("c_nationkey", F.round(G.area_flat(g), 6).alias("area"), F.size(g).alias("n_polygons"), segments.alias("n_segments"))


@query(_CELLS + """, h AS (SELECT x // 8 AS bx, y // 8 AS "by", x % 8 IN (3, 4) AND y % 8 IN (3, 4) AS hole FROM c)
  SELECT bx::INT AS bx, "by"::INT AS "by", (count(*) FILTER (NOT hole))::DOUBLE AS area, (count(*) FILTER (hole) = 4)::INT AS n_holes FROM h GROUP BY ALL""")
def dissolved_holes(spark, d):
    """Blocks of 8 x 8 cells in two groups like a chessboard's, each block with a hole of 2 x 2 cells; blocks touch in their corners."""
    x, y = F.col("c_custkey") % 64, F.floor(F.col("c_custkey") / 64)
    hole = (x % 8).isin(3, 4) & (y % 8).isin(3, 4)
    cells = notched_cells(spark, d).withColumn("side", ((F.floor(x / 8) + F.floor(y / 8)) % 2)).filter(~hole)
    pieces = topology.dissolved(cells, "side").select(F.explode("g").alias("p")).select(F.array("p").alias("g"))
    low = G.bounds(F.col("g"), clip=False)
    return pieces.select(F.floor(low["left"] / 8).cast("int").alias("bx"), F.floor(low["bottom"] / 8).cast("int").alias("by"), F.round(G.area_flat(F.col("g")), 6).alias("area"), (F.size(F.get("g", F.lit(0))) - 1).alias("n_holes"))


def bumpy_cells(spark, d):
    """Cells of 1/16 degree; the middle of a third of all sides is a thousandth of a side off, that of the others next to nothing.

    Rows go east: northward, the 1,440th would reach the pole, where triangles on the sphere shrink to nothing.
    """
    return notched_cells(spark, d, 1 / 16, lambda u, v, k: F.when((u + v + k) % 3 == 0, 1e-2).otherwise(1e-6), east=True)


@query(_CELLS + """SELECT 'c' || k AS id, (5 + ((x + y) % 3 = 0)::INT + ((x + 1 + y + 1) % 3 = 0)::INT + ((x + y + 1) % 3 = 0)::INT + ((x + y + 1) % 3 = 0)::INT)::INT AS n_points FROM c""")
def shared_simplification(spark, d):
    """Points left of each cell: its corners and the middles that are off."""
    return topology.simplified(bumpy_cells(spark, d)).select("id", F.size(G.points(F.col("g"))).alias("n_points"))


@query(_CELLS + """, e AS (SELECT a.k, b.k AS o FROM c a JOIN c b ON b.y = a.y AND abs(a.x - b.x) = 1 UNION ALL SELECT a.k, b.k FROM c a JOIN c b ON b.x = a.x AND abs(a.y - b.y) = 1),
  o AS (SELECT k FROM c WHERE (SELECT count(*) FROM e WHERE e.k = c.k) < 4)
  SELECT 'c' || k AS id, 'c' || o AS neighbor FROM e UNION SELECT 'c' || k, 'OUT_OF_STATE' FROM o UNION SELECT 'OUT_OF_STATE', 'c' || k FROM o""")
def simplified_contiguity(spark, d):
    """Neighbours after simplification: cells share their sides as before."""
    return spatial.contiguity(topology.simplified(bumpy_cells(spark, d)))


# clipping


@query(f"SELECT id, round(w * h / 4, 6) AS shared, round(w * h * 1.75, 6) AS both, round(w * h * 0.75, 6) AS rest, 5 AS n_shared, 9 AS n_both, 7 AS n_rest, 1 AS n_holes, round(w * h * 0.75, 6) AS frame FROM {_BOXES}")
def clipped_shapes(spark, d):
    """A box and its copy moved by half its width and height: what they share, both together, the rest of the box; and the box without one of half its sides inside it."""
    b = order_boxes(spark, d, spread=True).select("id", "g", G.bounds(F.col("g"), False).alias("b"))
    w, h = G.bounds_width(F.col("b")), G.bounds_height(F.col("b"))
    moved = G.map_points(F.col("g"), lambda x, y: (x + w / 2, y + h / 2))
    inner = G.map_points(F.col("g"), lambda x, y: ((x + F.col("b.left") + w / 2) / 2, (y + F.col("b.bottom") + h / 2) / 2))
    area, n = (lambda g: F.round(G.area_flat(F.col(g)), 6)), (lambda g: F.size(G.points(F.col(g))))
    names = ("shared", "both", "rest")
    rows = b.select("id", F.col("g").alias("ga"), moved.alias("gb"), F.col("g").alias("gc"), inner.alias("gd"))
    made = clipping.with_combined(rows, dict(zip(names, ("intersection", "union", "difference"))))
    made = made.select("id", *(area(g).alias(g) for g in names), *(n(g).alias(f"n_{g}") for g in names), "gc", "gd")
    framed = clipping.with_combined(made, "difference", "gc", "gd")
    return framed.select("id", "shared", "n_shared", "both", "n_both", "rest", "n_rest", area("g").alias("frame"), G.describe(F.col("g"))["nhole"].alias("n_holes"))


@query(f"SELECT id, 2 AS npoly, 2 AS nhole, 20 AS npoint, round(w * h * (1 - 0.5625 + 0.25 - 0.0625), 6) AS flat FROM {_BOXES}")
def nested_rings(spark, d):
    """Four boxes inside each other, handed in as polygons of their own: two polygons with a hole each."""
    b = order_boxes(spark, d, spread=True).select("id", "g", G.bounds(F.col("g"), False).alias("b"))
    x0, y0 = G.bounds_center(F.col("b"))
    flat = F.flatten(F.array(*(G.map_points(F.col("g"), lambda x, y, k=k: (x0 + (x - x0) * k, y0 + (y - y0) * k)) for k in (0.5, 1.0, 0.25, 0.75))))
    cleaned = clipping.clean_holes(b.select("id", flat.alias("g")))
    return cleaned.select("id", G.describe(F.col("g")).alias("n"), F.round(G.area_flat(F.col("g")), 6).alias("flat")).select("id", "n.*", "flat")


# measures and placing


@query(f"""SELECT id, round(greatest(2 * 6371000.0 * asin(abs(cos(radians(y + h / 2)) * sin(radians(r)))), 2 * 6371000.0 * radians(r)) / 1000, 3) AS km, round(2 * r, 6) AS flat, round(2 * r, 6) AS farthest
  FROM (SELECT *, sqrt(w * w + h * h) / 2 AS r FROM {_BOXES})""")
def box_diameters(spark, d):
    m = shapes.diameters(order_boxes(spark, d))
    return m.select("id", F.round(F.col("metres") / 1000, 3).alias("km"), F.round("flat", 6).alias("flat"), F.round("farthest", 6).alias("farthest"))


@query(f"SELECT id, 33 AS n_points, round(w * w * 4 * sin(pi() / 16), 6) AS flat, round(x + w, 6) AS rgt FROM {_BOXES}")
def circle_polygons(spark, d):
    """A circle of half a box's width around its centre, as 32 points: its area is that of 32 triangles."""
    b = order_boxes(spark, d).select("id", G.bounds(F.col("g"), False).alias("b"))
    x, y = G.bounds_center(F.col("b"))
    g = shapes.circle_polygon(x, y, G.bounds_width(F.col("b")) / 2)
    return b.select("id", g.alias("g")).select("id", F.size(G.points(F.col("g"))).alias("n_points"), F.round(G.area_flat(F.col("g")), 6).alias("flat"), F.round(G.bounds(F.col("g"), False)["right"], 6).alias("rgt"))


_NATIONS = "(SELECT 'n' || n_nationkey AS n, -120 + 2 * (n_nationkey % 5) AS nx, 30 + 2 * (n_nationkey // 5) AS ny FROM nation)"


@query(f"""SELECT id, n AS district FROM (SELECT id, CASE WHEN id % 3 = 0 THEN -119.5 ELSE px END AS px, CASE WHEN id % 3 = 0 THEN 30.25 ELSE py END AS py FROM {_POINTS}), {_NATIONS} WHERE px > nx AND px < nx + 2 AND py > ny AND py < ny + 2""")
def crowded_points(spark, d):
    """Points in polygons where a third of all points lie in one place, with cells split at 50 points."""
    p = customer_points(spark, d)
    crowd = F.col("id") % 3 == 0
    p = p.select("id", F.when(crowd, -119.5).otherwise(F.col("x")).alias("x"), F.when(crowd, 30.25).otherwise(F.col("y")).alias("y"))
    boxes = nation_boxes(spark, d).select(F.col("id").alias("district"), "g")
    return spatial.points_within(p, boxes, limit=50).select(F.col("p").alias("id"), F.col("f").alias("district"))


_BLOCKS = f"(SELECT id, x + s / k AS px, y + s / k AS py FROM (SELECT *, least(w, h) AS s, CASE WHEN id % 3 = 1 THEN 4 ELSE 2 END AS k FROM {_BOXES}))"


@query(f"""SELECT id, n AS district, round(px, 6) AS x, round(py, 6) AS y FROM {_BLOCKS}, {_NATIONS} WHERE px > nx AND px < nx + 2 AND py > ny AND py < ny + 2""")
def blocks_to_districts(spark, d):
    """Squares placed in districts by their label points: a third have an inner point, a third one that lies outside, a third none. Points on districts' borders are left to the tests."""
    b = order_boxes(spark, d, spread=True).select("id", G.bounds(F.col("g"), False).alias("b"))
    x, y, s = F.col("b.left"), F.col("b.bottom"), F.least(G.bounds_width(F.col("b")), G.bounds_height(F.col("b")))
    text = lambda c: c.cast("string")
    k = F.col("id") % 3
    inner = F.when(k == 1, F.create_map(F.lit("INTPTLON20"), text(x + s / 4), F.lit("INTPTLAT20"), text(y + s / 4)))
    outer = F.when(k == 2, F.create_map(F.lit("INTPTLON"), text(x - 1), F.lit("INTPTLAT"), text(y)))
    squares = b.select("id", G.box_polygon(x, y + s, x + s, y).alias("g"), F.coalesce(inner, outer, F.create_map().cast("map<string,string>")).alias("properties"))
    blocks = shapes.with_label(squares)
    near = lambda v: F.abs(v - 2 * F.round(v / 2)) > 1e-5
    blocks = staged(blocks.filter(near(F.col("x")) & near(F.col("y"))).select("id", "x", "y"), "blocks")  # read several times below
    got = spatial.assign_smallest(blocks, nation_boxes(spark, d).select(F.col("id").alias("district"), "g"))
    return got.join(blocks, "id").select("id", "district", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))

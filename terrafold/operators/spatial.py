"""Spatial joins and selections on a grid, and topology by shared edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators.staging import staged

OUTSIDE = "OUT_OF_STATE"
#: Points of a cell beyond which it is split, levels of splitting, and bytes of a table that is broadcast.
LEAF_POINTS, DEPTH, BROADCAST_BYTES = 20_000, 20, 8 << 20


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def with_cells(df: DataFrame, size: float, g: str = "g") -> DataFrame:
    """A row per grid cell that a feature's box touches, with columns ``cx``, ``cy`` and ``bb``."""
    boxed = df.withColumn("bb", G.bounds(F.col(g), clip=False))
    return boxed.withColumn("cx", F.explode(_cells(F.col("bb.left"), F.col("bb.right"), size))).withColumn("cy", F.explode(_cells(F.col("bb.bottom"), F.col("bb.top"), size)))


def points_in(points: DataFrame, features: DataFrame, size: float, point_id: str = "id", feature_id: str = "district", carry: tuple[str, ...] = ()) -> DataFrame:
    """(p, f, g) and the columns of features in ``carry`` for points (id, x, y) inside features (id, g): an equi-join on grid cells, then the exact test.

    A feature is cut into its cells before the join, so a cell's points meet only the
    features near them; Spark broadcasts the features if they are small, else shuffles both sides by cell.
    """
    placed = points.select(F.col(point_id).alias("p"), "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    parts = with_cells(features.select(F.col(feature_id).alias("f"), "g", *carry), size)
    near = (F.col("x") >= F.col("bb.left")) & (F.col("x") <= F.col("bb.right")) & (F.col("y") >= F.col("bb.bottom")) & (F.col("y") <= F.col("bb.top"))
    return placed.join(parts, ["cx", "cy"]).filter(near & G.contains(F.col("g"), F.col("x"), F.col("y"))).select("p", "f", "g", *carry)


@dataclass
class Cells:
    """Square cells that are split where points are dense: a quadtree as tables.

    ``split`` (level, cx, cy) holds the cells with too many points, each of which has four halves at the next level; whatever else meets
    is a leaf. ``fine`` (fx, fy, level) says for each cell of the last level that has points how deep its leaf is.
    """

    x0: float
    y0: float
    side: float
    depth: int
    deepest: int
    split: DataFrame
    fine: DataFrame

    def index(self, c: Column, low: float) -> Column:
        """The last level's cell of a coordinate, outside ones at the edge."""
        last = (1 << self.depth) - 1
        return F.least(F.greatest(F.floor((c - low) / self.side * (last + 1)), F.lit(0)), F.lit(last)).cast("bigint")

    def of_points(self, points: DataFrame) -> DataFrame:
        """Points (x, y) with the leaf (level, cx, cy) that holds them."""
        at = points.withColumn("fx", self.index(F.col("x"), self.x0)).withColumn("fy", self.index(F.col("y"), self.y0))
        met = at.join(self.fine, ["fx", "fy"])
        up = lambda c: F.expr(f"shiftright({c}, {self.depth} - level)")
        return met.withColumn("cx", up("fx")).withColumn("cy", up("fy")).drop("fx", "fy")

    def of_boxes(self, boxes: DataFrame) -> DataFrame:
        """A row for each leaf (level, cx, cy) that a box ``bb`` touches: from the whole, split cells lead to those of their halves that the box touches."""
        x, y = (lambda c: self.index(F.col(c), self.x0)), (lambda c: self.index(F.col(c), self.y0))
        rows = boxes.withColumns({"lx": x("bb.left"), "hx": x("bb.right"), "ly": y("bb.bottom"), "hy": y("bb.top"), "level": F.lit(0), "cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")})
        halves = F.expr(f"""filter(flatten(transform(sequence(2 * cx, 2 * cx + 1), i -> transform(sequence(2 * cy, 2 * cy + 1), j -> struct(level + 1 AS level, i AS cx, j AS cy)))),
          c -> c.cx BETWEEN shiftright(lx, {self.depth} - level - 1) AND shiftright(hx, {self.depth} - level - 1) AND c.cy BETWEEN shiftright(ly, {self.depth} - level - 1) AND shiftright(hy, {self.depth} - level - 1))""")
        kept = [c for c in rows.columns if c not in ("level", "cx", "cy")]
        for _ in range(self.deepest):
            met = rows.join(self.split.withColumn("more", F.lit(True)), ["level", "cx", "cy"], "left")
            cells = F.when(F.col("more"), halves).otherwise(F.array(F.struct("level", "cx", "cy")))
            rows = met.select(*kept, F.explode(cells).alias("c")).select(*kept, "c.level", "c.cx", "c.cy")
        return rows.drop("lx", "hx", "ly", "hy")


def adaptive_cells(points: DataFrame, limit: int = LEAF_POINTS, depth: int = DEPTH) -> Cells:
    """Cells for points (x, y): those with more than ``limit`` points are split, down to ``depth`` levels.

    Points are counted once by cells of the last level, combined before the shuffle; the counts of all levels come from those counts. Without points there is one cell.
    """
    ends = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    x0, y0 = ends.x0 or 0.0, ends.y0 or 0.0
    side = max((ends.x1 or 0.0) - x0, (ends.y1 or 0.0) - y0) * (1 + 1e-9) or 1.0
    cells = Cells(x0, y0, side, depth, 0, points, points)
    counts = points.select(cells.index(F.col("x"), x0).alias("fx"), cells.index(F.col("y"), y0).alias("fy")).groupBy("fx", "fy").agg(F.count("*").alias("n"))
    counts = staged(counts, "cells")
    levels = counts.select("fx", "fy", "n", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    levels = levels.select("fx", "fy", "n", "level", up("fx").alias("cx"), up("fy").alias("cy"))
    split = staged(levels.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).select("level", "cx", "cy"), "split")
    n, deepest = split.agg(F.count("*"), F.max("level")).first()
    small = n * 20 <= BROADCAST_BYTES
    cells.deepest, cells.split = 0 if deepest is None else deepest + 1, F.broadcast(split) if small else split
    inside = levels.join(cells.split, ["level", "cx", "cy"], "left_semi").groupBy("fx", "fy").agg((F.max("level") + 1).alias("level"))
    cells.fine = counts.select("fx", "fy").join(inside, ["fx", "fy"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return cells


def points_within(points: DataFrame, features: DataFrame, point_id: str = "id", feature_id: str = "district", carry: tuple[str, ...] = (), limit: int = LEAF_POINTS, depth: int = DEPTH) -> DataFrame:
    """(p, f, g) and the columns of features in ``carry`` for points (id, x, y) inside features (id, g), by cells that are split where points are dense.

    Only ids and boxes go to the cells; a feature's geometry is joined to the points in its box. A cell that a third of the points crowds into is many cells, so
    no task holds it; rows are those of :func:`points_in`. Points without a coordinate are in nothing.
    """
    placed = points.select(F.col(point_id).alias("p"), "x", "y").filter("x is not null and y is not null")
    cells = adaptive_cells(placed, limit, depth)
    shape = features.select(F.col(feature_id).alias("f"), "g", *carry)
    boxes = shape.select("f", G.bounds(F.col("g"), clip=False).alias("bb")).filter("bb.left is not null")
    near = (F.col("x") >= F.col("bb.left")) & (F.col("x") <= F.col("bb.right")) & (F.col("y") >= F.col("bb.bottom")) & (F.col("y") <= F.col("bb.top"))
    met = cells.of_points(placed).join(cells.of_boxes(boxes), ["level", "cx", "cy"]).filter(near).select("p", "x", "y", "f")
    return met.join(shape, "f").filter(G.contains(F.col("g"), F.col("x"), F.col("y"))).select("p", "f", "g", *carry)


def assign_smallest(points: DataFrame, features: DataFrame, size: float | None = None, point_id: str = "id", feature_id: str = "district", area: str | None = None) -> DataFrame:
    """(point, feature): each point's smallest feature by area, the smaller id on ties; points outside all are left out. ``area`` names a column for the feature's area.

    With ``size`` by a grid of such cells, else by cells that are split where points are dense. Points in one place have one answer, and of features
    with one geometry only that of the smallest id can be it: places and geometries meet once, however many rows share them.
    """
    places = staged(points.filter("x is not null and y is not null").select("x", "y").distinct().withColumn("id", F.struct("x", "y")), "places")
    shape = features.filter(F.col("g").isNotNull()).groupBy("g").agg(F.min(feature_id).alias("district"))
    shape = staged(shape.withColumn("_a", G.area(F.col("g"))), "shapes")
    met = points_within(places, shape, carry=("_a",)) if size is None else points_in(places, shape, size, carry=("_a",))
    least = met.groupBy("p").agg(F.min(F.struct("_a", "f")).alias("m")).select("p.x", "p.y", "m")
    own = points.select(point_id, "x", "y").join(least, ["x", "y"]).groupBy(point_id).agg(F.min("m").alias("m"))
    return own.select(point_id, F.col("m.f").alias(feature_id), *([F.col("m._a").alias(area)] if area else []))


def select_box(features: DataFrame, left: float, top: float, right: float, bottom: float, mode: str) -> DataFrame:
    """Features by a query box: ``intersects`` (insides meet), ``overlap`` (boxes meet), ``bounds`` (box inside), ``center`` (box's centre inside)."""
    own = G.bounds(F.col("g"))
    box = F.struct(F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(right).alias("right"), F.lit(bottom).alias("bottom"))
    area = G.box_polygon(box["left"], box["top"], box["right"], box["bottom"])
    test = {"intersects": lambda: G.intersects(F.col("g"), area), "overlap": lambda: G.bounds_intersect(own, box), "bounds": lambda: G.bounds_inside(own, box), "center": lambda: G.bounds_contain(box, *G.bounds_center(own))}
    return features.filter(test[mode]())


def segments(features: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, a, b): ring segments with their ends in order."""
    rings = features.select(F.col(id_col).alias("id"), F.explode(F.flatten("g")).alias("r"))
    pairs = rings.select("id", F.explode(F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("s"))
    return pairs.select("id", "s.a", "s.b").filter("a <> b")


def contiguity(features: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, neighbor): features that share a segment; a segment of one feature borders the outside, both ways.

    Segments are grouped once; a segment belongs to a few features, so pairs come from its small set.
    """
    owners = segments(features, id_col).groupBy("a", "b").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    pairs = F.when(F.size("ids") == 1, F.array(F.struct(F.col("ids")[0].alias("u"), F.lit(OUTSIDE).alias("v")), F.struct(F.lit(OUTSIDE).alias("u"), F.col("ids")[0].alias("v")))).otherwise(
        F.flatten(F.transform("ids", lambda u: F.transform(F.filter("ids", lambda v: v != u), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    )
    return owners.select(F.explode(pairs).alias("e")).select(F.col("e.u").alias("id"), F.col("e.v").alias("neighbor")).distinct()


def dissolve_boundary(features: DataFrame, group: str) -> DataFrame:
    """(group, a, b): the segments on the outside of each group; inner segments occur twice and cancel."""
    rings = features.select(F.col(group).alias("id"), F.explode(F.flatten("g")).alias("r")).withColumn("g", F.array(F.array("r")))
    return segments(rings.select("id", "g")).groupBy("id", "a", "b").count().filter(F.col("count") % 2 == 1).select(F.col("id").alias(group), "a", "b")


def virtual_features(features: DataFrame, group: str, id_col: str = "id", values: list[str] | None = None) -> DataFrame:
    """One row per group: sums of ``values``, sorted blocks, and the groups beside it."""
    sums = [F.sum(v).alias(v) for v in values or []]
    base = features.groupBy(group).agg(*sums, F.array_sort(F.collect_set(id_col)).alias("blocks"))
    of = features.select(F.col(id_col).alias("neighbor"), F.col(group).alias("_g"))
    beside = contiguity(features, id_col).join(features.select(F.col(id_col).alias("id"), F.col(group)), "id").join(of, "neighbor", "left")
    beside = beside.withColumn("_g", F.coalesce(F.col("_g").cast("string"), F.lit(OUTSIDE))).filter(F.col("_g") != F.col(group).cast("string"))
    return base.join(beside.groupBy(group).agg(F.array_sort(F.collect_set("_g")).alias("contiguity")), group, "left")


def duplicate_segments(arcs: DataFrame) -> DataFrame:
    """(a, b, n_arcs): segments that several arcs (arc_id, pts) hold."""
    pairs = arcs.select("arc_id", F.explode(F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("s"))
    return pairs.groupBy("s.a", "s.b").agg(F.countDistinct("arc_id").alias("n_arcs")).filter("n_arcs > 1")


def interior_sharing(arcs: DataFrame) -> DataFrame:
    """(x, y, n_interior, n_endpoint): points inside two arcs or more, or inside one and an end of another."""
    at = arcs.select("arc_id", F.size("pts").alias("n"), F.posexplode("pts").alias("k", "p"))
    inner = (F.col("k") > 0) & (F.col("k") < F.col("n") - 1)
    per = at.groupBy("p.x", "p.y", "arc_id").agg(F.max(inner).alias("inner"), F.max(~inner).alias("end"))
    out = per.groupBy("x", "y").agg(F.count_if("inner").alias("n_interior"), F.count_if(F.col("end") & ~F.col("inner")).alias("n_endpoint"))
    return out.filter("n_interior >= 2 or (n_interior >= 1 and n_endpoint >= 1)")


def parts(features: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, part, g): a row per polygon, numbered from 1."""
    return features.select(id_col, F.posexplode("g").alias("part", "p")).select(id_col, (F.col("part") + 1).alias("part"), F.array("p").alias("g"))


def merged_polygons(features: DataFrame, id_col: str, order: str) -> DataFrame:
    """(id, g): polygons of rows that share an id put together in order."""
    parts = features.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(order, "g"))).alias("v"))
    return parts.select(id_col, F.flatten(F.transform("v", lambda s: s["g"])).alias("g"))

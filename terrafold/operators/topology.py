"""Topology of polygon collections: rings cut into shared arcs, features rebuilt from arcs, groups dissolved to rings,
and simplification that keeps shared borders.

A topology is two tables: ``arcs`` (arc_id, pts, n_uses) and ``uses`` (id, poly, ring, seq, arc_id, turned, shift), the
rings of the features as arcs in order, each as it is or turned round. An arc is a stretch of ring between two junctions; a vertex is a
junction if rings come to it or leave it by different neighbours. An arc that several rings run along, in
either direction, is one row, so whatever changes it changes all its sides alike.

Everything is grouping and joining by vertex, ring or arc; no collection and no group is gathered, only rings, which are values of one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import shapes, spatial
from terrafold.operators.staging import dropped, staged

POINTS = "array<struct<x:double,y:double>>"


def _vertices(features: DataFrame, id_col: str) -> DataFrame:
    """(id, poly, ring, n, k, prev, here, next): a row per ring vertex; repeated points of a ring are one, rings under two points none."""
    rings = features.select(F.col(id_col).alias("id"), F.posexplode("g").alias("poly", "p")).select("id", "poly", F.posexplode("p").alias("ring", "r"))
    fresh = F.filter(F.col("r"), lambda q, i: (i == 0) | (q != F.get(F.col("r"), i - 1)))
    rings = rings.withColumn("r", fresh)
    opened = F.when((F.size("r") > 1) & (F.element_at("r", 1) == F.element_at("r", -1)), F.slice("r", 1, F.size("r") - 1)).otherwise(F.col("r"))
    rings = rings.withColumn("r", opened).withColumn("n", F.size("r")).filter("n > 1")
    before = F.concat(F.slice("r", F.col("n"), F.lit(1)), F.slice("r", F.lit(1), F.col("n") - 1))
    after = F.concat(F.slice("r", F.lit(2), F.col("n") - 1), F.slice("r", 1, 1))
    zipped = F.arrays_zip(before.alias("prev"), F.col("r").alias("here"), after.alias("next"))
    return rings.select("id", "poly", "ring", "n", F.posexplode(zipped).alias("k", "v")).select("id", "poly", "ring", "n", "k", "v.prev", "v.here", "v.next")


def junctions(vertices: DataFrame) -> DataFrame:
    """(here): vertices whose rings don't all pass between the same two neighbours; two extremes per vertex, combined before the shuffle."""
    pair = F.struct(F.least("prev", "next").alias("a"), F.greatest("prev", "next").alias("b"))
    ends = vertices.groupBy("here").agg(F.min(pair).alias("low"), F.max(pair).alias("high"))
    return ends.filter("low <> high").select("here")


def topology(features: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The arcs and uses of features (id, g).

    A ring without junctions is one closed arc from its least vertex. An arc's id is the digest of its
    points in the lesser of their two directions; ``shift`` is the place of a ring's first arc in the ring as given.
    """
    v = _vertices(features, id_col)
    met = v.join(junctions(v).withColumn("j", F.lit(True)), "here", "left").withColumn("j", F.col("j").isNotNull())
    ring = Window.partitionBy("id", "poly", "ring")
    least = F.min_by("k", F.struct("here", "k")).over(ring)
    met = met.withColumn("cut", F.col("j") | (~F.max("j").over(ring) & (F.col("k") == least)))
    met = met.withColumn("shift", F.min(F.when(F.col("cut"), F.col("k"))).over(ring)).withColumn("at", F.pmod(F.col("k") - F.col("shift"), F.col("n")))
    met = met.withColumn("seq", F.sum(F.col("cut").cast("int")).over(ring.orderBy("at")))
    pieces = met.groupBy("id", "poly", "ring", "seq", "shift").agg(F.array_sort(F.collect_list(F.struct("at", "here", "next"))).alias("v"))
    pieces = pieces.withColumn("pts", F.concat(F.transform("v", lambda s: s["here"]), F.array(F.element_at("v", -1)["next"]))).drop("v")
    pieces = pieces.withColumn("turned", F.reverse("pts") < F.col("pts")).withColumn("pts", F.least(F.reverse("pts"), F.col("pts")))
    pieces = staged(pieces.withColumn("arc_id", F.md5(F.col("pts").cast("string"))), "arcs")
    arcs = pieces.groupBy("arc_id").agg(F.any_value("pts").alias("pts"), F.count("*").alias("n_uses"))
    uses = pieces.select("id", "poly", "ring", "seq", "arc_id", "turned", "shift")
    return arcs, uses


def rebuilt(arcs: DataFrame, uses: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, g): features from their arcs, rings closed and begun where they began (at their first arc, if an arc has lost points)."""
    way = F.when(F.col("turned"), F.reverse("pts")).otherwise(F.col("pts"))
    full = F.size("pts") if "n_pts" not in arcs.columns else F.col("n_pts")
    rows = uses.join(arcs.select("arc_id", "pts", full.alias("full")), "arc_id").select("id", "poly", "ring", "shift", F.struct("seq", way.alias("pts"), (F.size("pts") == F.col("full")).alias("whole")).alias("a"))
    rows = rows.repartition("id").groupBy("id", "poly", "ring", "shift").agg(F.array_sort(F.collect_list("a")).alias("v"))
    rows = rows.withColumn("r", F.flatten(F.transform("v", lambda a: F.slice(a["pts"], 1, F.size(a["pts"]) - 1)))).withColumn("shift", F.when(F.forall("v", lambda a: a["whole"]), F.col("shift")).otherwise(0))
    n, s = F.size("r"), F.col("shift")
    turned = F.when(s > 0, F.concat(F.slice("r", n - s + 1, s), F.slice("r", F.lit(1), n - s))).otherwise(F.col("r"))
    rings = rows.withColumn("r", turned).withColumn("r", F.concat("r", F.slice("r", 1, 1)))
    polygons = rings.groupBy("id", "poly").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda s: s["r"]).alias("p"))
    out = polygons.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("poly", "p"))), lambda s: s["p"]).alias("g"))
    return out.withColumnRenamed("id", id_col)


def splice(*parts: tuple[str, tuple[DataFrame, DataFrame], DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """One topology of tagged ones: (tag, (arcs, uses), hidden ids or None). Hidden features go, and the arcs that none of the others runs along.

    Ids of arcs are digests of their points, so equal arcs of several topologies become one row by themselves. A feature of
    a later part replaces one of the same id.
    """
    uses = [u.select(F.lit(n).alias("entry_idx"), F.lit(tag).alias("tag"), "*") for n, (tag, (_, u), _) in enumerate(parts)]
    shown = [u if hidden is None else u.join(hidden.select("id").distinct(), "id", "left_anti").select(u.columns) for u, (_, _, hidden) in zip(uses, parts)]
    together = shown[0]
    for u in shown[1:]:
        together = together.unionByName(u)
    last = together.groupBy("id").agg(F.max("entry_idx").alias("entry_idx"))
    kept = together.join(last, ["id", "entry_idx"])
    arcs = parts[0][1][0].select("arc_id", "pts")
    for _, (a, _), _ in parts[1:]:
        arcs = arcs.unionByName(a.select("arc_id", "pts"))
    counts = kept.groupBy("arc_id").agg(F.count("*").alias("n_uses"))
    return arcs.groupBy("arc_id").agg(F.any_value("pts").alias("pts")).join(counts, "arc_id"), kept.select("tag", *parts[0][1][1].columns)


# dissolving


def outline(features: DataFrame, group: str) -> DataFrame:
    """(grp, a, b): the directed segments on the outside of each group, its inside on their left; segments that run both ways cancel."""
    rings = features.select(F.col(group).alias("grp"), F.explode(F.flatten(G.rewound(F.col("g")))).alias("r"))
    n = F.size("r") - 1
    ways = rings.select("grp", F.explode(F.arrays_zip(F.slice("r", F.lit(1), n).alias("a"), F.slice("r", F.lit(2), n).alias("b"))).alias("s")).select("grp", "s.a", "s.b").filter("a <> b")
    forward = F.col("a") < F.col("b")
    one = ways.select("grp", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.when(forward, 1).otherwise(-1).alias("way"))
    net = one.groupBy("grp", "low", "high").agg(F.sum("way").alias("net")).filter("net <> 0")
    ahead = F.col("net") > 0
    return net.select("grp", F.when(ahead, F.col("low")).otherwise(F.col("high")).alias("a"), F.when(ahead, F.col("high")).otherwise(F.col("low")).alias("b"))


def _followed(edges: DataFrame) -> DataFrame:
    """(e, nxt) for edges (grp, e, a, b): at an edge's end, the first edge out when turning clockwise from the way back.

    That edge bounds the same piece of the group's inside, so pieces that touch in a vertex are rings of their own. Edges in and
    out of a vertex are sorted by angle once, so a vertex with many costs a sort, not pairs.
    """
    angle = lambda at, to: F.atan2(to["y"] - at["y"], to["x"] - at["x"])
    a, b = F.col("a"), F.col("b")
    into = edges.select("grp", b.alias("v"), F.lit(0).alias("out"), angle(b, a).alias("t"), "e")
    leave = edges.select("grp", a.alias("v"), F.lit(1).alias("out"), angle(a, b).alias("t"), "e")
    at = Window.partitionBy("grp", "v")
    out = F.when(F.col("out") == 1, F.col("e"))
    before = F.last(out, ignorenulls=True).over(at.orderBy("t", "out").rowsBetween(Window.unboundedPreceding, -1))
    around = F.max_by("e", F.when(F.col("out") == 1, F.col("t"))).over(at)
    met = into.unionByName(leave).withColumn("nxt", F.coalesce(before, around))
    return met.filter("out = 0").select("e", "nxt")


def _doubled(table: DataFrame, step: dict[str, Column], check: Column) -> DataFrame:
    """Rounds of pointer doubling over (e, nxt, value): ``nxt`` becomes the one after it, until ``check`` holds in no row.

    ``step`` gives new columns from ``l`` (a row) and ``r`` (the row that it points to). A round is a table; rounds grow with the logarithm of the longest list.
    """
    now = staged(table, "rounds")
    while True:
        new = staged(now.alias("l").join(now.alias("r"), F.col("l.nxt") == F.col("r.e"), "left").select(F.col("l.e").alias("e"), *(c.alias(n) for n, c in step.items()), check.alias("more")), "rounds")
        more = new.agg(F.max("more")).first()[0]
        dropped(now)
        now = new
        if not more:
            return now


def rings_of(edges: DataFrame) -> DataFrame:
    """(grp, ring, r): closed rings of directed edges (grp, a, b) that lead on from one to the next.

    A ring's number is its least edge's, found by doubling pointers; cut there, doubling again ranks its edges.
    """
    edges = staged(edges.withColumn("e", F.monotonically_increasing_id()), "edges")
    nxt = staged(_followed(edges).filter("nxt is not null"), "next")
    low = _doubled(nxt.select("e", "nxt", F.col("e").alias("low")), {"nxt": F.col("r.nxt"), "low": F.least("l.low", "r.low")}, F.col("r.low") < F.col("l.low"))
    # the edge before a ring's least one ends the list
    chain = nxt.join(low.select("e", "low"), "e").select("e", "low", F.when(F.col("nxt") != F.col("low"), F.col("nxt")).alias("nxt"))
    chain = staged(chain, "chain")
    rank = _doubled(chain.select("e", "nxt", F.col("nxt").isNotNull().cast("bigint").alias("left")), {"nxt": F.col("r.nxt"), "left": F.col("l.left") + F.coalesce(F.col("r.left"), F.lit(0))}, F.col("r.nxt").isNotNull())
    rows = edges.join(chain.select("e", "low"), "e").join(rank.select("e", "left"), "e")
    rings = rows.groupBy("grp", F.col("low").alias("ring")).agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "a"))).alias("v"))
    return rings.select("grp", "ring", F.transform("v", lambda s: s["a"]).alias("r")).withColumn("r", F.concat("r", F.slice("r", 1, 1)))


def nested(rings: DataFrame) -> DataFrame:
    """(grp, g): each group's rings as one geometry: counter-clockwise rings are polygons, the others holes of the least one around them.

    Holes are placed by the middle of an edge, in a join on grid cells; the polygons come by their first point.
    """
    signed = staged(rings.withColumn("s", -G.ring_direction(F.col("r"))).filter("s <> 0"), "rings")
    outer = signed.filter("s > 0")
    p, q = F.element_at("r", 1), F.element_at("r", 2)
    holes = signed.filter("s < 0").select(F.struct("grp", "ring").alias("id"), ((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))
    around = outer.select(F.struct("grp", "ring").alias("district"), F.array(F.array("r")).alias("g"), "s")
    met = spatial.points_within(holes, around, carry=("s",)).filter("p.grp <=> f.grp")
    owner = met.groupBy("p").agg(F.min_by("f", F.struct("s", "f")).alias("f"))
    placed = owner.select(F.col("p.grp").alias("grp"), F.col("p.ring").alias("ring"), F.col("f.ring").alias("outer"))
    inner = signed.filter("s < 0").join(placed, ["grp", "ring"]).select("grp", "outer", F.lit(1).alias("k"), "r")
    both = outer.select("grp", F.col("ring").alias("outer"), F.lit(0).alias("k"), "r").unionByName(inner)
    polygons = both.groupBy("grp", "outer").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda s: s["r"]).alias("p"))
    return polygons.groupBy("grp").agg(F.array_sort(F.collect_list("p")).alias("g"))


def dissolved(features: DataFrame, group: str) -> DataFrame:
    """(group, g): one multipolygon per group of features (id, g) that share borders point by point.

    Groups without area are left out; features of a group that overlap aren't a topology, and count where their borders say.
    """
    return nested(rings_of(outline(features, group))).withColumnRenamed("grp", group)


# simplification


#: The least weight of a point (steradians), the first weight for shapes in trouble, square metres and degrees of small shapes, rounds.
LEAST_WEIGHT, KEEP_WEIGHT, SMALL_AREA, SMALL_REACH, POINT_REACH, TRIES = 1e-10, 1e-11, 500.0, 1e-4, 1e-5, 30


def triangle_areas(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Solid angles of triangles of unit vectors (n, 3)."""
    turn = np.abs(np.einsum("ij,ij->i", a, np.cross(b, c)))
    return 2 * np.arctan2(turn, 1 + (a * b).sum(axis=1) + (b * c).sum(axis=1) + (c * a).sum(axis=1))


def weights(points: np.ndarray) -> np.ndarray:
    """Weight of each point of a line: the area of its triangle when it is the least one left to take out, never less than one taken before; the ends' is infinite."""
    n = len(points)
    out = np.full(n, np.inf)
    if n < 3:
        return out
    lon, lat = np.radians(points.T)
    unit = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    area = np.concatenate([[np.inf], triangle_areas(unit[:-2], unit[1:-1], unit[2:]), [np.inf]])
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    heap = [(float(w), k) for k, w in enumerate(area[1:-1].tolist(), 1)]
    heapq.heapify(heap)
    most = 0.0
    while heap:
        w, k = heapq.heappop(heap)
        if out[k] != np.inf or w != area[k]:
            continue
        out[k] = most = max(most, w)
        i, j = int(left[k]), int(right[k])
        right[i], left[j] = j, i
        for m in (i, j):
            if 0 < m < n - 1:
                x, z = unit[left[m]], unit[right[m]]
                area[m] = float(triangle_areas(x[None], unit[m][None], z[None])[0])
                heapq.heappush(heap, (float(area[m]), m))
    return out


def crosses(ring: np.ndarray) -> bool:
    """Whether two edges of a closed ring cross in their inner points: edges in order of their left ends meet those that begin before they end."""
    a, b = ring[:-1], ring[1:]
    left, right = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    order = np.argsort(left, kind="stable")
    a, b, left, right = a[order], b[order], left[order], right[order]
    ends = np.searchsorted(left, right, side="right")
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    for k in range(len(a)):
        c, d = a[k + 1 : ends[k]], b[k + 1 : ends[k]]
        if len(c) and ((side(a[k], b[k], c) * side(a[k], b[k], d) < 0) & (side(c, d, a[k]) * side(c, d, b[k]) < 0)).any():
            return True
    return False


def weighted(arcs: DataFrame) -> DataFrame:
    """``arcs`` (arc_id, pts) with ``w``, the weights of their points; a small helper per arc, a map without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"arc_id": pdf["arc_id"], "pts": pdf["pts"], "w": [weights(np.stack([x, y], axis=1)) for x, y in zip(pdf["xs"], pdf["ys"])]})

    flat = arcs.select("arc_id", "pts", F.col("pts.x").alias("xs"), F.col("pts.y").alias("ys"))
    return flat.mapInPandas(run, f"arc_id string, pts {POINTS}, w array<double>")


def _troubles(features: DataFrame, min_area: float) -> DataFrame:
    """(id, trouble) of features (id, g, px, py): ``all`` for shapes without area, small and thin ones, and those that
    lose their inner point (px, py), where they have one; ``some`` for rings that cross themselves."""
    kind = features.schema["id"].dataType.simpleString()
    lost = F.coalesce(G.edge_distance(F.col("g"), F.col("px"), F.col("py")) < POINT_REACH, F.lit(False))
    rows = features.select("id", "g", F.transform("g", lambda p: G.area(F.array(p))).alias("areas"), lost.alias("lost"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, g, areas, lost in zip(pdf["id"], pdf["g"], pdf["areas"], pdf["lost"]):
                rings = [[np.array([[q["x"], q["y"]] for q in r]) for r in p] for p in g]
                if any(a <= 0 or (a < min_area and shapes.label(p)[2] < SMALL_REACH) for a, p in zip(areas, rings)):
                    out.append((key, "all"))
                elif any(crosses(r) for p in rings for r in p):
                    out.append((key, "some"))
                elif lost:
                    out.append((key, "all"))
            yield pd.DataFrame(out, columns=["id", "trouble"])

    return rows.mapInPandas(run, f"id {kind}, trouble string")


def simplified(features: DataFrame, id_col: str = "id", inner: tuple[str, str] | None = None, least: float = LEAST_WEIGHT, min_area: float = SMALL_AREA) -> DataFrame:
    """(id, g): features (id, g) without the points that weigh less than ``least``, the same points on both sides of a border.

    Shapes that come out wrong (see :func:`_troubles`; ``inner`` names the columns of a point that must stay inside) get points of their arcs back,
    all or those from a weight on that falls when a round mends none, and with them all shapes along
    these arcs are looked at again, until none is wrong or all its points are back.
    """
    arcs, uses = topology(features, id_col)
    heavy = staged(weighted(arcs), "weights")
    points = features.select(F.col(id_col).alias("id"), *((F.col(c) if inner else F.lit(None)).cast("double").alias(n) for n, c in zip(("px", "py"), inner or ("", ""))))
    keep, todo, bad_before, weight = None, uses, None, KEEP_WEIGHT

    def light() -> DataFrame:
        known = heavy.withColumn("keep", F.lit(np.inf)) if keep is None else heavy.join(keep, "arc_id", "left").withColumn("keep", F.coalesce("keep", F.lit(np.inf)))
        kept = F.filter("pts", lambda q, i: (F.get(F.col("w"), i) >= least) | (F.get(F.col("w"), i) >= F.col("keep")))
        return known.select("arc_id", F.size("pts").alias("n_pts"), kept.alias("pts"))

    for _ in range(TRIES):
        now = light()
        wrong = _troubles(rebuilt(now, todo).join(points, "id"), min_area)
        thinned = uses.join(now.filter("size(pts) < n_pts").select("arc_id"), "arc_id", "left_semi").select("id").distinct()
        wrong = staged(wrong.join(thinned, "id", "left_semi"), "wrong")
        bad = wrong.count()
        if not bad:
            break
        if bad_before is not None and bad >= bad_before:
            weight /= 10
        bad_before = bad
        more = uses.join(wrong, "id").groupBy("arc_id").agg(F.min(F.when(F.col("trouble") == "all", 0.0).otherwise(weight)).alias("keep"))
        more = more if keep is None else more.unionByName(keep).groupBy("arc_id").agg(F.min("keep").alias("keep"))
        keep = staged(more, "keep")
        again = uses.join(uses.join(wrong, "id").select("arc_id").distinct(), "arc_id", "left_semi").select("id").distinct()
        todo = uses.join(again, "id", "left_semi")
    return rebuilt(light(), uses, id_col)

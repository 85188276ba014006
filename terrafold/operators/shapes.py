"""Shape measures that need a point set's order or a search, by numpy on Arrow batches of features.

Each row is measured by itself; a small helper per row, a map without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import flat

#: Pairs of points and edges in one array.
PRODUCTS = 1 << 20


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, from the least point."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p)
    chains: list = []
    for order in (p, p[::-1]):
        chain: list = []
        for x, y in order:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2:]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                chain.pop()
            chain.append((x, y))
        chains += chain[:-1]
    return np.array(chains)


def _through(q: list) -> tuple[float, float, float]:
    """The circle with two points as diameter, or through three."""
    (ax, ay), (bx, by) = q[:2]
    if len(q) == 2:
        return (ax + bx) / 2, (ay + by) / 2, math.hypot(ax - bx, ay - by) / 2
    bx, by, cx, cy = bx - ax, by - ay, q[2][0] - ax, q[2][1] - ay
    d = 2 * (bx * cy - by * cx)
    x, y = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return ax + x, ay + y, math.hypot(x, y)


def enclosing_circle(corners: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle around the corners of a hull, widening past each point outside."""
    p = corners.tolist()

    def outside(q: list, circle: tuple[float, float, float]) -> bool:
        return math.hypot(q[0] - circle[0], q[1] - circle[1]) > circle[2] * (1 + 1e-12)

    best = (*p[0], 0.0)
    for i, a in enumerate(p):
        if outside(a, best):
            best = (*a, 0.0)
            for j, b in enumerate(p[:i]):
                if outside(b, best):
                    best = _through([a, b])
                    for c in p[:j]:
                        if outside(c, best):
                            best = _through([a, b, c])
    return best


def least_rectangle(p: np.ndarray) -> tuple[float, float, float]:
    """Area, longer and shorter side of the smallest rectangle around a hull's corners; a side lies along an edge."""
    edges = np.roll(p, -1, axis=0) - p
    unit = edges / np.linalg.norm(edges, axis=1, keepdims=True)
    along = p @ unit.T
    across = p @ np.stack([-unit[:, 1], unit[:, 0]])
    w, h = np.ptp(along, axis=0), np.ptp(across, axis=0)
    k = int((w * h).argmin())
    return float(w[k] * h[k]), float(max(w[k], h[k])), float(min(w[k], h[k]))


def farthest(corners: np.ndarray) -> float:
    """Greatest distance of two corners of a hull (counter-clockwise), by calipers turned once around: a corner and the one farthest from the edge at it."""
    n = len(corners)
    if n < 3:
        return float(np.hypot(*(corners[0] - corners[-1])))
    p, best, j = corners.tolist(), 0.0, 1
    for i in range(n):
        (ax, ay), (bx, by) = p[i], p[(i + 1) % n]
        while True:
            (cx, cy), (dx, dy) = p[j], p[(j + 1) % n]
            best = max(best, math.hypot(ax - cx, ay - cy), math.hypot(bx - cx, by - cy))
            if (bx - ax) * (dy - cy) - (by - ay) * (dx - cx) <= 0:
                break
            j = (j + 1) % n
    return best


def thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: those farther than the tolerance from the chords between kept ones."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = points[b] - points[a], points[a + 1 : b] - points[a]
        t = np.clip((q @ d) / max(float(d @ d), 1e-300), 0, 1) if d.any() else np.zeros(len(q))
        far = np.hypot(*(q - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def label(rings: list[np.ndarray], precision: float = 0.02) -> tuple[float, float, float]:
    """The inside point of one polygon farthest from all edges, and that distance; see :func:`labels`."""
    xy, n = np.concatenate(rings), flat.offsets(np.array([len(r) for r in rings]))
    x, y, far = labels(flat.Flat(xy[:, 0], xy[:, 1], n, np.array([0, len(rings)]), np.array([0, 1])), precision)
    return float(x[0]), float(y[0]), float(far[0])


def labels(g: flat.Flat, precision: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By polygon: the inside point farthest from all edges (x, y), and that distance, to within a share of the box's shorter side.

    Squares that cover a polygon's box are judged by the most that they can hold (their centre's distance plus half a diagonal);
    those that can hold more than the best so far are quartered, until none can. All polygons' squares of one size are one array. Polygons without edges have distance -inf.
    """
    a, b, off = g.edges()
    ax, ay, by = g.x[a], g.y[a], g.y[b]
    dx, dy = g.x[b] - ax, by - ay
    length = np.maximum(dx * dx + dy * dy, 1e-300)
    slope = np.divide(dx, dy, out=np.zeros(len(dx)), where=dy != 0)

    def depth(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of points from the edges of polygons ``p``, negative outside; some pairs at a time."""
        n = off[p + 1] - off[p]
        out = np.empty(len(p))
        for lo, hi in flat.chunks(n, PRODUCTS):
            k, some = flat.spans(off[p[lo:hi]], n[lo:hi]), n[lo:hi]
            vx, vy = np.repeat(x[lo:hi], some) - ax[k], np.repeat(y[lo:hi], some) - ay[k]
            t = np.clip((vx * dx[k] + vy * dy[k]) / length[k], 0, 1)
            first = np.cumsum(some) - some
            far = np.sqrt(np.minimum.reduceat((vx - t * dx[k]) ** 2 + (vy - t * dy[k]) ** 2, first))
            high = np.repeat(y[lo:hi], some)
            crossed = ((ay[k] > high) != (by[k] > high)) & (vx < vy * slope[k])
            out[lo:hi] = np.where(np.add.reduceat(crossed, first, dtype=np.int64) % 2 == 1, far, -far)
        return out

    n = len(g.polygon) - 1
    best_x, best_y, best = np.zeros(n), np.zeros(n), np.full(n, -np.inf)
    p = np.flatnonzero(np.diff(off) > 0)
    p = p[g.ring[g.polygon[p] + 1] > g.ring[g.polygon[p]]]
    if not len(p):
        return best_x, best_y, best
    outer = g.polygon[p]
    count = g.ring[outer + 1] - g.ring[outer]
    at, first = flat.spans(g.ring[outer], count), np.cumsum(count) - count
    low, high = (np.stack([f.reduceat(v[at], first) for v in (g.x, g.y)]) for f in (np.minimum, np.maximum))
    half = np.maximum((high - low).min(axis=0), 1e-9) / 2
    enough = np.zeros(n)
    enough[p] = precision * 2 * half
    across, up = (np.maximum(np.ceil((np.maximum(high[c], low[c] + half * 1.001) - (low[c] + half)) / (2 * half)).astype(np.int64), 1) for c in (0, 1))
    k = flat.spans(np.zeros(len(p), dtype=np.int64), across * up)
    q = np.repeat(np.arange(len(p)), across * up)
    x, y, half, p = low[0][q] + half[q] + k % across[q] * 2 * half[q], low[1][q] + half[q] + k // across[q] * 2 * half[q], half[q], p[q]
    while len(p):
        far = depth(p, x, y)
        first = np.flatnonzero(np.diff(p, prepend=-1))
        most = np.maximum.reduceat(far, first)
        is_most = np.flatnonzero(far == np.repeat(most, np.diff(np.append(first, len(p)))))
        top = is_most[np.flatnonzero(np.diff(p[is_most], prepend=-1))]  # the first of equals
        top = top[far[top] > best[p[top]]]
        best_x[p[top]], best_y[p[top]], best[p[top]] = x[top], y[top], far[top]
        keep = far + half * math.sqrt(2) - best[p] > enough[p]
        p, half = np.repeat(p[keep], 4), np.repeat(half[keep] / 2, 4)
        x = np.repeat(x[keep], 4) + np.tile([-1, -1, 1, 1], int(keep.sum())) * half
        y = np.repeat(y[keep], 4) + np.tile([-1, 1, -1, 1], int(keep.sum())) * half
    return best_x, best_y, best


def _row_labels(g: flat.Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: the label point of the polygon that leaves most room, the first of equals; distance -inf without one."""
    x, y, far = labels(g)
    row = np.repeat(np.arange(len(g.row) - 1), np.diff(g.row))
    order = np.lexsort((-far, row))
    top = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    out = np.zeros((3, len(g.row) - 1))
    out[2] = -np.inf
    out[:, row[top]] = x[top], y[top], far[top]
    return tuple(out)


def labelled(features: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, x, y, distance): the label point of each feature's polygon that leaves most room."""
    kind = features.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, far = _row_labels(flat.Flat.read(batch.column(1)))
            out = pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (x, y, far))], ["id", "x", "y", "distance"])
            yield out.filter(pa.array(far > -np.inf))

    whole = features.select(F.col(id_col).alias("id"), "g").filter("size(g) > 0")
    return whole.mapInArrow(run, f"id {kind}, x double, y double, distance double").withColumnRenamed("id", id_col)


def simplified(features: DataFrame, tolerance: float = 1e-4, id_col: str = "id") -> DataFrame:
    """(id, g): each ring without the points within the tolerance of its chords; rings keep four points at least."""
    kind = features.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for polygons in pdf["g"]:
                done = []
                for rings in polygons:
                    done.append([])
                    for r in rings:
                        keep = thin(np.array([[q["x"], q["y"]] for q in r]), tolerance)
                        done[-1].append([q for q, k in zip(r, keep) if k] if keep.sum() >= 4 else list(r))
                out.append(done)
            yield pd.DataFrame({"id": pdf["id"], "g": out})

    return features.select(F.col(id_col).alias("id"), "g").mapInPandas(run, f"id {kind}, g {G.GEOMETRY}").withColumnRenamed("id", id_col)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with few input splits dealt to all cores, as the work per row is much more than its shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def measured(features: DataFrame, id_col: str = "id", tolerance: float = 1e-4) -> DataFrame:
    """(id, hull, hull_points, hull_area, circle_x, circle_y, circle_r, box_area, box_length, box_width, kept_points, farthest), planar."""
    kind = features.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, xs, ys in zip(pdf["id"], pdf["xs"], pdf["ys"]):
                p = np.stack([xs, ys], axis=1)
                h = hull(p)
                x, y = h[:, 0], h[:, 1]
                area = abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2
                out.append((key, [{"x": a, "y": b} for a, b in h.tolist()], len(h), area, *enclosing_circle(h), *least_rectangle(h), int(thin(p, tolerance).sum()), farthest(h)))
            yield pd.DataFrame(out, columns=["id", "hull", "hull_points", "hull_area", "circle_x", "circle_y", "circle_r", "box_area", "box_length", "box_width", "kept_points", "farthest"])

    flat = features.select(F.col(id_col).alias("id"), G.exterior_points(F.col("g")).alias("p")).select("id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys")).filter("size(xs) >= 3")
    schema = f"id {kind}, hull array<struct<x:double,y:double>>, hull_points int, hull_area double, circle_x double, circle_y double, circle_r double, box_area double, box_length double, box_width double, kept_points int, farthest double"
    return spread(flat).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def diameters(features: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, metres, flat, farthest): across the smallest circle around a feature, the longer of its two axes on the sphere and in the plane, and between its two farthest points."""
    m = measured(features, id_col)
    x, y, r = F.col("circle_x"), F.col("circle_y"), F.col("circle_r")
    metres = F.greatest(G.haversine(x - r, y, x + r, y), G.haversine(x, y - r, x, y + r))
    return m.select(id_col, metres.alias("metres"), (2 * r).alias("flat"), "farthest")


def circle_polygon(x: Column, y: Column, r: Column, segments: int = 8) -> Column:
    """A circle as a geometry of ``segments`` (8 at least) points a quarter, from the top clockwise; null without a radius."""
    n = max(segments, 8)
    turns = [k * math.pi / 2 / n for k in range(4 * n)]
    points = [G.point(x + r * math.sin(t), y + r * math.cos(t)) for t in turns]
    return F.when(r != 0, F.array(F.array(F.array(*points, points[0]))))


#: Properties that may hold a point inside, in order of preference.
INNER_X = ["INTPTLON30", "INTPTLON20", "INTPTLON10", "INTPTLON"]
INNER_Y = ["INTPTLAT30", "INTPTLAT20", "INTPTLAT10", "INTPTLAT"]


def with_label(features: DataFrame, properties: str = "properties", id_col: str = "id") -> DataFrame:
    """``features`` (id, properties map, g) with ``x``, ``y``: a label point inside each.

    The properties labelx and labely stand if they are there; then the first of the inner points' properties that are neither missing nor
    empty, if it lies inside; else the point with most room around it, to six places. Only features that need one are searched.
    """
    names = features.columns
    of = lambda props, found: F.coalesce(*(F.nullif(F.try_element_at(props, F.lit(n)), F.lit("")).try_cast("double") for n in found), F.lit(0.0))
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  (value is taken once, however often f names it)

    def known(props: Column) -> Column:
        own = [F.try_element_at(props, F.lit(n)).try_cast("double") for n in ("labelx", "labely")]
        inner = F.struct(of(props, INNER_X).alias("x"), of(props, INNER_Y).alias("y"))
        good = lambda q: F.coalesce((q["x"] != 0) & (q["y"] != 0) & G.contains(F.col("g"), q["x"], q["y"]), F.lit(False))
        given = F.try_element_at(props, F.lit("labelx")).isNotNull()
        return F.when(given, F.struct(own[0].alias("x"), own[1].alias("y"), F.lit(True).alias("known"))).otherwise(bound(inner, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), good(q).alias("known"))))

    rows = features.withColumn("_p", bound(F.col(properties), known)).select(*names, F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"), F.coalesce("_p.known", F.lit(False)).alias("_known"))
    at = names.index("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(~np.asarray(batch.column("_known")))
            found = np.array(_row_labels(flat.Flat.read(batch.column(at).take(pa.array(some)))))
            x, y = (np.full(len(batch), np.nan) for _ in "xy")
            for v, w in zip((x, y), found):
                v[some] = np.where(found[2] > -np.inf, w, np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, from_pandas=True) for v in (x, y))], [*batch.schema.names, "_sx", "_sy"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(run, f"{schema}, _sx double, _sy double")
    return out.select(*names, *(F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.round(f"_s{c}", 6)).alias(c) for c in "xy"))


def circle_area(y: Column, r: Column) -> Column:
    """Square metres of the circle of ``r`` degrees around latitude ``y`` as drawn on a map of longitude and latitude."""
    t = F.radians(r)
    return (G.EARTH_RADIUS**2 * math.pi) * t * t * F.cos(F.radians(y)) * (1 - t * t / 8 + t * t * t * t / 192)


def compactness(features: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, reock, polsby_popper, convex_hull, schwartzberg, value): a feature's area on the sphere as a share of its
    smallest circle's, of the circle's with its perimeter, and of its hull's; its circle's perimeter as a share of its own.

    Features without area or circle have 0 in all. Circles are true circles of degrees.
    """
    base = features.select(id_col, G.area(F.col("g")).alias("a"), G.perimeter(F.col("g")).alias("l"))
    out = base.join(measured(features, id_col).select(id_col, "hull", "circle_y", "circle_r"), id_col)
    round_to = lambda r: F.col("a") / circle_area(F.col("circle_y"), r)
    reock, popper = round_to(F.col("circle_r")), round_to(F.col("l") / (2 * math.pi * G.METRES_PER_DEGREE))
    shares = {
        "reock": reock,
        "polsby_popper": popper,
        "convex_hull": F.col("a") / G.ring_area(F.col("hull")),
        "schwartzberg": 2 * math.pi * F.sqrt(F.col("a") / math.pi) / F.col("l"),
        "value": F.floor((reock + popper) / 2 * 100).cast("double"),
    }
    real = (F.col("a") > 0) & (F.col("circle_r") > 0)
    return out.select(id_col, *(F.when(real, c).otherwise(0.0).alias(n) for n, c in shares.items()))

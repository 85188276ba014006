"""Polygon measures and predicates as expressions over nested arrays.

A geometry ``g`` is array<polygon>, a polygon array<ring> (outer ring, then holes), a ring
array<struct<x, y>> with the last point equal to the first. All builders stay in Spark's
expressions, so they run inside generated code and are pruned with their columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
#: The sphere's radius and metres of a degree.
EARTH_RADIUS = 6371000.0
METRES_PER_DEGREE = 111139.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*(point(x, y) for x, y in points))


def box_polygon(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box as a geometry."""
    return F.array(F.array(ring((left, top), (left, bottom), (right, bottom), (right, top), (left, top))))


def points(g: Column) -> Column:
    return F.flatten(F.flatten(g))


def exterior_points(g: Column) -> Column:
    return F.flatten(F.transform(g, lambda p: F.get(p, F.lit(0))))


def is_null(g: Column) -> Column:
    return g.isNull() | (F.size(g) == 0)


def describe(g: Column) -> Column:
    """(npoly, nhole, npoint)."""
    holes = F.aggregate(g, F.lit(0), lambda n, p: n + F.size(p) - 1)
    return F.struct(F.size(g).alias("npoly"), holes.alias("nhole"), F.size(points(g)).alias("npoint"))


def map_points(g: Column, f: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """``g`` with every point replaced by f(x, y)."""
    return F.transform(g, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: point(*f(q["x"], q["y"])))))


def rounded(g: Column, places: int = 6) -> Column:
    """Coordinates rounded, ties toward positive infinity."""
    scale = float(10**places)
    return map_points(g, lambda x, y: (F.floor(x * scale + 0.5) / scale, F.floor(y * scale + 0.5) / scale))


def _edges(r: Column) -> Column:
    """Pairs (a, b) of following points of a ring."""
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return F.zip_with(F.slice(r, 1, n), F.slice(r, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _rings(g: Column, outer: Callable[[Column], Column], hole: float) -> Column:
    """Sum over polygons of a ring measure, holes weighted."""
    return _sum(F.transform(g, lambda p: _sum(F.transform(p, lambda r, i: outer(r) * F.when(i == 0, 1.0).otherwise(hole)))))


def ring_area(r: Column) -> Column:
    """Square metres of a ring on the sphere; open rings are closed by wrapping around."""
    n = F.size(r) - F.when((F.element_at(r, 1) == F.element_at(r, -1)) & (F.size(r) > 1), 1).otherwise(0)
    turn = lambda i: (F.radians(F.get(r, (i + 2) % n)["x"]) - F.radians(F.get(r, i)["x"])) * F.sin(F.radians(F.get(r, (i + 1) % n)["y"]))
    return F.when(n < 3, 0.0).otherwise(F.abs(_sum(F.transform(F.sequence(F.lit(0), n - 1), turn))) * (EARTH_RADIUS**2 / 2))


def area(g: Column) -> Column:
    """Square metres, outer rings less holes."""
    return _rings(g, ring_area, -1.0)


def ring_direction(r: Column) -> Column:
    """Sum of (x2 - x1) * (y2 + y1): negative if the ring runs counter-clockwise."""
    return _sum(F.transform(_edges(r), lambda e: (e["b"]["x"] - e["a"]["x"]) * (e["b"]["y"] + e["a"]["y"])))


def windings(g: Column) -> Column:
    """Direction of each ring, by polygon."""
    return F.transform(g, lambda p: F.transform(p, ring_direction))


def area_flat(g: Column) -> Column:
    """Planar area, outer rings less holes."""
    return _rings(g, lambda r: F.abs(_sum(F.transform(_edges(r), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2, -1.0)


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres."""
    dy, dx = F.radians(y2 - y1), F.radians(x2 - x1)
    h = F.pow(F.sin(dy / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(dx / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def closed(r: Column) -> Column:
    """A ring with its first point repeated at the end."""
    return F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))


def perimeter(g: Column) -> Column:
    """Metres around the outer rings."""
    return _rings(g, lambda r: _sum(F.transform(_edges(closed(r)), lambda e: haversine(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))), 0.0)


def perimeter_flat(g: Column) -> Column:
    """Planar length of the outer rings."""
    return _rings(g, lambda r: _sum(F.transform(_edges(closed(r)), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))), 0.0)


def clip_longitude(x: Column) -> Column:
    """Longitudes east of Greenwich count as -179."""
    return F.when(x > 0, -179.0).otherwise(x)


def bounds(g: Column, clip: bool = True) -> Column:
    """(left, top, right, bottom) of all points."""
    xs = F.transform(points(g), lambda q: clip_longitude(q["x"]) if clip else q["x"])
    ys = F.transform(points(g), lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_max(ys).alias("top"), F.array_max(xs).alias("right"), F.array_min(ys).alias("bottom"))


def bounds_intersect(a: Column, b: Column) -> Column:
    return (a["left"] <= b["right"]) & (a["right"] >= b["left"]) & (a["bottom"] <= b["top"]) & (a["top"] >= b["bottom"])


def bounds_contain(a: Column, x: Column, y: Column) -> Column:
    """Left and top edges are outside, right and bottom inside."""
    return (x > a["left"]) & (x <= a["right"]) & (y < a["top"]) & (y >= a["bottom"])


def bounds_inside(a: Column, b: Column) -> Column:
    """Whether box ``a`` lies in box ``b``."""
    return (a["left"] >= b["left"]) & (a["right"] <= b["right"]) & (a["bottom"] >= b["bottom"]) & (a["top"] <= b["top"])


def bounds_center(a: Column) -> tuple[Column, Column]:
    return (a["left"] + a["right"]) / 2, (a["top"] + a["bottom"]) / 2


def bounds_width(a: Column) -> Column:
    return F.abs(a["right"] - a["left"])


def bounds_height(a: Column) -> Column:
    return F.abs(a["bottom"] - a["top"])


def bounds_empty(a: Column) -> Column:
    """Whether a box is missing or has no area."""
    return a.isNull() | a["left"].isNull() | (bounds_area(a) == 0)


def bounds_area(a: Column) -> Column:
    return area(box_polygon(a["left"], a["top"], a["right"], a["bottom"]))


def ring_contains(r: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: edges crossed by a ray to the right."""
    crossed = F.filter(
        _edges(r),
        lambda e: ((e["b"]["y"] > y) != (e["a"]["y"] > y))
        & (x < (e["a"]["x"] - e["b"]["x"]) * (y - e["b"]["y"]) / F.nullif(e["a"]["y"] - e["b"]["y"], F.lit(0.0)) + e["b"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def contains(g: Column, x: Column, y: Column) -> Column:
    """Whether any polygon holds the point outside all its holes."""
    return F.exists(g, lambda p: ring_contains(F.get(p, F.lit(0)), x, y) & ~F.exists(F.slice(p, 2, F.size(p)), lambda h: ring_contains(h, x, y)))


def bad_coordinates(g: Column) -> Column:
    """Whether any coordinate is no number or above 360 in size."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 360)
    return F.exists(points(g), lambda q: bad(q["x"]) | bad(q["y"]))


def rewound(g: Column) -> Column:
    """Rings closed; outer rings counter-clockwise, holes clockwise."""
    turned = lambda r, i: F.when((i == 0) & (ring_direction(r) > 0), F.reverse(r)).when((i > 0) & (ring_direction(r) < 0), F.reverse(r)).otherwise(r)
    return F.transform(g, lambda p: F.transform(F.transform(p, closed), turned))


def segment_distance_squared(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2)


def edge_distance(g: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest edge, negative outside."""
    edges = F.flatten(F.transform(F.flatten(g), _edges))
    least = F.array_min(F.transform(edges, lambda e: segment_distance_squared(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    return F.sqrt(least) * F.when(contains(g, x, y), 1).otherwise(-1)


def self_intersects(g: Column) -> Column:
    """Whether two edges of one ring cross in their inner points."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def cross(e: Column, f: Column) -> Column:
        return (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)

    return F.exists(F.flatten(g), lambda r: F.exists(_edges(r), lambda e: F.exists(_edges(r), lambda f: cross(e, f))))


def _side(p: Column, q: Column, r: Column) -> Column:
    """Positive if ``r`` lies left of the line from ``p`` to ``q``."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def _clip(r: Column, cut: Column) -> Column:
    """The part of a closed ring left of the line from cut.a to cut.b, closed."""

    def kept(e: Column) -> Column:
        u, v = _side(cut["a"], cut["b"], e["a"]), _side(cut["a"], cut["b"], e["b"])
        t = u / F.nullif(u - v, F.lit(0.0))
        met = point(e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"]))
        end = point(e["b"]["x"], e["b"]["y"])
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when((u >= 0) & (v >= 0), F.array(end)).when(u >= 0, F.array(met)).when(v >= 0, F.array(met, end)).otherwise(none)

    out = F.flatten(F.transform(_edges(r), kept))
    return F.concat(out, F.slice(out, 1, 1))


def _signed(r: Column) -> Column:
    return _sum(F.transform(_edges(r), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_intersection_area(a: Column, b: Column) -> Column:
    """Planar area that two closed rings share.

    ``b`` is a signed sum of the triangles from its first point, and clipping by a triangle keeps
    areas exact for any simple ring, so neither ring has to be convex.
    """

    def part(e: Column) -> Column:
        p = F.element_at(b, 1)
        turn = F.signum(_side(p, e["a"], e["b"]))
        q, r = F.when(turn >= 0, e["a"]).otherwise(e["b"]), F.when(turn >= 0, e["b"]).otherwise(e["a"])
        lines = F.array(*(F.struct(u.alias("a"), v.alias("b")) for u, v in ((p, q), (q, r), (r, p))))
        piece = F.aggregate(lines, F.transform(a, lambda x: point(x["x"], x["y"])), _clip)
        return F.when(turn == 0, 0.0).otherwise(turn * F.abs(_signed(piece)))

    return F.abs(_sum(F.transform(_edges(b), part)))


def intersection_area(a: Column, b: Column) -> Column:
    """Planar area that two geometries share; holes count against it."""
    sign = lambda i: F.when(i == 0, 1.0).otherwise(-1.0)
    rings = lambda g: F.flatten(F.transform(g, lambda p: F.transform(p, lambda r, i: F.struct(r.alias("r"), sign(i).alias("s")))))
    return _sum(F.transform(rings(a), lambda u: _sum(F.transform(rings(b), lambda v: u["s"] * v["s"] * ring_intersection_area(u["r"], v["r"])))))


def difference_area(a: Column, b: Column) -> Column:
    """Planar area of ``a`` outside ``b``."""
    return area_flat(a) - intersection_area(a, b)


def union_area(a: Column, b: Column) -> Column:
    """Planar area of both together."""
    return area_flat(a) + area_flat(b) - intersection_area(a, b)


def intersects(a: Column, b: Column, least: float = 1e-9) -> Column:
    """Whether the outer rings share more than ``least`` area; boxes that do not meet are told apart first."""
    outer = lambda g: F.transform(g, lambda p: F.slice(p, 1, 1))
    return F.when(bounds_intersect(bounds(a, False), bounds(b, False)), intersection_area(outer(a), outer(b)) > least).otherwise(False)


def content_hash(g: Column) -> Column:
    """A 64-bit hash of all coordinates in order, for equality."""
    return F.xxhash64(g)


def equal_perimeter_circle(g: Column) -> Column:
    """Radius in degrees of the circle with the geometry's perimeter."""
    return perimeter(g) / (2 * math.pi) / METRES_PER_DEGREE


def from_utm14(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Longitude and latitude of WGS84 UTM zone 14 north, by the published inverse series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = northing / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    terms = (3 * e1 / 2 - 27 * e1**3 / 32, 21 * e1**2 / 16 - 55 * e1**4 / 32, 151 * e1**3 / 96, 1097 * e1**4 / 512)
    phi = mu
    for n, c in enumerate(terms, 1):
        phi = phi + c * F.sin(2 * n * mu)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n1, t1, c1 = a / F.sqrt(1 - e2 * sin * sin), tan * tan, ep2 * cos * cos
    r1 = a * (1 - e2) / F.pow(1 - e2 * sin * sin, 1.5)
    d = (easting - 500000.0) / (n1 * k0)
    lat = phi - n1 * tan / r1 * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t1 + c1) * F.pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * F.pow(d, 5) / 120) / cos
    return F.degrees(lon) - 99.0, F.degrees(lat)

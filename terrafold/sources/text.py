"""Delimited lines and GeoJSON as DataFrames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from terrafold.functions import geometry as G

_FIELD = re.compile(r"""\s*(?:(?P<quote>['"])(?P<inside>.*?)(?:(?P=quote)|$)(?P<after>[^,|]*)|(?P<plain>[^,|]*))(?P<end>[,|]|$)""", re.S)
_CELL = re.compile(r"""\s*(?P<cell>"(?:[^"]|"")*"?|[^,|]*)[^,|]*(?P<end>[,|]|$)""", re.S)


def split_loose(line: str | None) -> list[str] | None:
    """Fields of a line: ``,`` and ``|`` separate, either quote opens a field, text after a closing quote belongs to it."""
    if line is None or not line.strip():
        return None if line is None else []
    out, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        out.append((m["inside"] + m["after"].rstrip()) if m["quote"] else m["plain"].rstrip())
        if not m["end"]:
            return out
        at = m.end()


def split_strict(line: str | None) -> list[str] | None:
    """Fields of a line: only double quotes, doubled inside; unquoted fields keep trailing blanks."""
    if line is None or not line.strip():
        return None if line is None else []
    line, out, at = line.strip(), [], 0
    while True:
        m = _CELL.match(line, at)
        cell = m["cell"]
        out.append(cell[1:-1].replace('""', '"') if cell.startswith('"') else cell)
        if not m["end"]:
            return out
        at = m.end()


@pandas_udf(T.ArrayType(T.StringType()))
def _loose(lines: pd.Series) -> pd.Series:
    return lines.map(split_loose)


@pandas_udf(T.ArrayType(T.StringType()))
def _strict(lines: pd.Series) -> pd.Series:
    return lines.map(split_strict)


def fields(line: Column, strict: bool = False) -> Column:
    """Fields of a text column; lines without quotes are split in Spark's own expressions."""
    quoted = line.contains('"') if strict else line.rlike("""['"]""")
    plain = F.when(F.trim(line) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(F.trim(line) if strict else line, r"[,|]", -1), lambda x: F.ltrim(x) if strict else F.trim(x))
    )
    return F.when(quoted, (_strict if strict else _loose)(F.when(quoted, line))).otherwise(plain)


def read_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(fields) of the non-empty lines of text files; a quoted field never spans lines."""
    lines = spark.read.text(path).filter("value <> ''")
    return lines.select(fields(F.col("value"), strict).alias("fields"))


#: Fixed value: properties that may hold an id, in order of preference.
ID_PROPERTIES = ["id", "GEOID", "GEOID10", "GEOID20", "GEOID30", "DISTRICT", "DISTRICTNO", "DISTRICTNAME"]


def geometry_from_json(kind: Column, coordinates: Column) -> Column:
    """Polygon and MultiPolygon coordinates (JSON text) as nested points; others are null."""
    deep = "array<array<array<array<double>>>>"
    many = F.when(kind == "MultiPolygon", F.from_json(coordinates, deep)).when(kind == "Polygon", F.array(F.from_json(coordinates, "array<array<array<double>>>")))
    return F.transform(many, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: G.point(F.get(q, F.lit(0)), F.get(q, F.lit(1))))))


#: Fixed value: the name of the projected system whose coordinates are turned to degrees.
UTM14 = "urn:ogc:def:crs:EPSG::32614"


def in_degrees(g: Column, crs: Column) -> Column:
    """A geometry in longitude and latitude: UTM zone 14 north is converted where ``crs`` names it, all else stays."""
    return F.when(crs == UTM14, G.map_points(g, G.from_utm14)).otherwise(g)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, geom_type, g, ord) of a FeatureCollection's polygons, rewound; features without geometry are left out.

    The collection's id property is the first of ``ID_PROPERTIES`` (as written or in lower case) that its first
    feature has. Without one, or if its values are not there for all features or not unique, ids are positions.
    Coordinates of a collection that names UTM zone 14 north as its system become degrees.
    """
    schema = "crs struct<properties:struct<name:string>>, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    first = F.get("features", F.lit(0))["properties"]
    spelled = [x for p in ID_PROPERTIES for x in dict.fromkeys((p, p.lower()))]
    chosen = F.coalesce(*(F.when(F.map_contains_key(first, x), F.lit(x)) for x in spelled))
    files = files.withColumn("ids", F.transform("features", lambda f: F.try_element_at(f["properties"], chosen)))
    whole = (F.array_size(F.array_distinct(F.array_compact("ids"))) == F.size("ids")) & chosen.isNotNull()
    rows = files.select(F.posexplode(F.arrays_zip("features", "ids")).alias("ord", "z"), whole.alias("whole"), F.col("crs.properties.name").alias("crs"))
    rows = rows.select("ord", "crs", F.col("z.features").alias("f"), F.when(F.col("whole"), F.col("z.ids")).alias("named"))
    named = F.coalesce("named", (F.col("ord") + 1).cast("string"))
    out = rows.select(named.alias("id"), F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geom_type"), in_degrees(geometry_from_json(F.col("f.geometry.type"), F.col("f.geometry.coordinates")), F.col("crs")).alias("g"), "ord")
    return out.filter("g is not null and properties is not null").withColumn("g", G.rewound(F.col("g")))


def number_list(g: Column) -> Column:
    """A geometry as text: counts of polygons, rings and points, then all coordinates."""
    counts = F.flatten(F.transform(g, lambda p: F.concat(F.array(F.size(p)), F.transform(p, lambda r: F.size(r)))))
    xy = F.flatten(F.transform(G.points(g), lambda q: F.array(q["x"], q["y"])))
    return F.concat_ws(" ", F.size(g).cast("string"), F.array_join(counts.cast("array<string>"), " "), F.array_join(xy.cast("array<string>"), " "))


def geometry_of_numbers(line: str | None) -> list | None:
    """The geometry of a text that :func:`number_list` made; null where its counts don't fit."""
    if line is None:
        return None
    n = [float(x) for x in line.split()]
    try:
        at, sizes = 1, []
        for _ in range(int(n[0])):
            rings = int(n[at])
            sizes.append([int(x) for x in n[at + 1 : at + 1 + rings]])
            at += 1 + rings
        out = []
        for rings in sizes:
            out.append([])
            for size in rings:
                xy = n[at : at + 2 * size]
                if len(xy) != 2 * size:
                    return None
                out[-1].append([{"x": x, "y": y} for x, y in zip(xy[::2], xy[1::2])])
                at += 2 * size
        return out
    except IndexError:
        return None


_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(_POINT))))
def from_number_list(lines: pd.Series) -> pd.Series:
    """Geometries from their texts."""
    return lines.map(geometry_of_numbers)

"""Functions and operators on small inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from terrafold.functions import arrays as A
from terrafold.functions import geometry as G
from terrafold.functions import palette, scalars
from terrafold.operators import records, shapes, spatial
from terrafold.sources import text
from terrafold.streaming import edits


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def shape(*polygons):
    return F.array(*(F.array(*(F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in r)) for r in p)) for p in polygons))


UNIT = [(-100, 40), (-99, 40), (-99, 41), (-100, 41), (-100, 40)]
SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]


def test_numbers(spark):
    lit = F.lit
    r = one(
        spark, scalars.text_hash(lit("hello")), scalars.text_hash(lit("")), scalars.round_half_up(lit(-2.5)), scalars.percent_text(lit(1.0), lit(3.0), 1),
        scalars.percent_text(lit(1.0), lit(0.0)), scalars.wrap_longitude(lit(190.0)), scalars.to_safe_number(lit("12d")), scalars.to_safe_number(lit(" -1.5e2 ")), scalars.number_text(lit(3.0)), scalars.locale_number(lit(2.5)),
        scalars.locale_number(lit(1234.565), 2), scalars.hex_byte(lit(10)), scalars.hex_byte(lit(256)), scalars.is_guid(scalars.keyed_guid(lit("k"))), scalars.guid_key(scalars.keyed_guid(lit("k"))),
    )
    assert list(r) == [181380007, 5381, -2.0, "33.3%", "(-)", -170.0, 0.0, -150.0, "3", "3", "1,234.57", "0a", None, True, "k"]


def test_dates(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    now = ts("2024-03-05 15:00:00")
    r = one(
        spark, scalars.pretty_date(ts("2024-03-05 00:05:00")), scalars.pretty_date(ts("2024-03-05 12:30:00")), scalars.pretty_date(F.lit(None).cast("timestamp")), scalars.wordy_date(ts("2024-03-05 13:05:00"), now),
        scalars.relative_date(ts("2024-01-02 01:00:00"), now), scalars.relative_date(ts("2023-01-02 01:00:00"), now), scalars.recent_date(ts("2024-03-05 14:59:50"), now), scalars.recent_date(ts("2024-03-05 11:00:00"), now),
    )
    assert list(r) == ["Mar 5, 2024 at 0:05 AM", "Mar 5, 2024 at 12:30 PM", "unknown", "today Mar 5, 2024 at 1:05 PM", "Jan 2", "Jan 2, 2023", "1m", "5h"]


def test_maps_sets_colors(spark):
    m = lambda **k: F.create_map(*(x for p in k.items() for x in map(F.lit, p)))
    r = one(
        spark, scalars.map_overlay(m(a=1, b=2), m(b=3)).alias("o"), scalars.map_without(m(a=1, b=2), F.array(F.lit("a"))).alias("w"), scalars.key_diff(m(a=1, b=2), m(a=1, b=3, c=4)).alias("d"),
        scalars.sorted_set(F.array(*map(F.lit, ["b", "A", "", "b", "C"]))).alias("s"), scalars.members_of(scalars.bits_of(F.array(F.lit("c"), F.lit("x")), list("abc")), list("abc")).alias("m"),
        palette.rgba(F.lit("#ff0010"), 0.5).alias("c"), palette.cyclic_color(F.lit(4), ["x", "y", "z"]).alias("y"), palette.gradient(F.lit(0.25), [("#000000", 0.0), ("white", 0.5)]).alias("g"),
        scalars.text_to_html(F.lit("a\n|x|y\nb")).alias("h"),
    )
    assert r.o == {"a": 1, "b": 3} and r.w == {"b": 2} and r.d == ["b", "c"] and r.s == ["A", "b", "C"] and r.m == ["c"]
    assert r.c == "rgba(255, 0, 16, 0.5)" and r.y == "x" and r.g == "#7f7f7f" and r.h == "<p>a</p><table><tr><td>x</td><td>y</td></tr></table><p>b</p>"


def test_geometry(spark):
    g, two, holed = shape([UNIT]), shape([UNIT], [UNIT]), shape([SQUARE, HOLE])
    r = one(
        spark, G.area(g).alias("a"), G.area_flat(holed).alias("f"), G.perimeter_flat(holed).alias("p"), G.describe(two).alias("d"), G.contains(g, F.lit(-99.5), F.lit(40.5)).alias("c"), G.contains(holed, F.lit(1.5), F.lit(1.5)).alias("h"),
        G.perimeter_flat(shape([SQUARE[:4]])).alias("o"), G.windings(G.rewound(shape([SQUARE[::-1], HOLE]))).alias("w"), G.self_intersects(shape([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])).alias("x"), G.self_intersects(holed).alias("nx"),
        G.bounds(shape([[(10, 0), (11, 0), (11, 1), (10, 0)]])).alias("b"), G.bad_coordinates(shape([[(400, 0), (1, 1), (2, 2), (400, 0)]])).alias("bad"), G.edge_distance(holed, F.lit(3.0), F.lit(3.0)).alias("e"), text.number_list(g).alias("n"),
        F.struct(*(c.alias(n) for c, n in zip(G.from_utm14(F.lit(500000.0), F.lit(4427757.0)), "xy"))).alias("u"),
    )
    assert abs(r.a - 9401777053.85) < 0.01 and r.f == 15 and r.p == 16 and tuple(r.d) == (2, 0, 10) and r.c and not r.h and r.o == 16
    assert r.w[0][0] <= 0 <= r.w[0][1] and r.x and not r.nx and r.b.left == r.b.right == -179 and r.bad and r.e == 1
    assert r.n.startswith("1 1 5 -100.0 40.0 ") and abs(r.u.x + 99) < 1e-9 and abs(r.u.y - 40) < 1e-3


def test_shared_area(spark):
    notch = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]  # not convex: 4x4 less a triangle of base 4 and height 3
    far, touching = [(9, 9), (10, 9), (10, 10), (9, 9)], [(4, 0), (6, 0), (6, 4), (4, 4), (4, 0)]
    square, v = shape([SQUARE]), shape([notch])
    r = one(
        spark, G.intersection_area(square, v).alias("a"), G.intersection_area(v, square).alias("b"), G.intersection_area(v, v).alias("c"), G.intersection_area(shape([SQUARE, HOLE]), square).alias("h"),
        G.intersects(square, shape([touching])).alias("t"), G.intersects(square, shape([far])).alias("f"), G.intersects(v, shape([touching], [[(1, 0), (5, 0), (5, 1), (1, 0)]])).alias("i"),
        G.difference_area(square, v).alias("d"), G.union_area(square, shape([touching])).alias("u"), G.intersection_area(shape([SQUARE, HOLE]), shape([SQUARE, HOLE])).alias("hh"),
    )
    assert [round(x, 9) for x in (r.a, r.b, r.c, r.h, r.d, r.u, r.hh)] == [10, 10, 10, 15, 6, 24, 15] and (r.t, r.f, r.i) == (False, False, True)


def test_matrices(spark):
    m = lambda *rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    a, b = m((1.0, 2.0), (3.0, 4.0)), m((5.0,), (6.0,))
    r = one(
        spark, A.multiply(a, b).alias("p"), A.multiply(b, b).alias("bad"), A.transpose(a).alias("t"), A.subset(a, F.array(F.lit(1)), F.array(F.lit(1), F.lit(0))).alias("s"), A.integers(F.lit(2), F.lit(4)).alias("i"),
        A.integers(F.lit(2), F.lit(2)).alias("e"), A.stacked(a, b, False).alias("w"), A.along(a, False, F.array_max).alias("m"), A.column(a, 1).alias("c"),
    )
    assert r.p == [[17.0], [39.0]] and r.bad is None and r.t == [[1.0, 3.0], [2.0, 4.0]] and r.s == [[4.0, 3.0]] and r.i == [2, 3] and r.e == [] and r.w == [[1.0, 2.0, 5.0], [3.0, 4.0, 6.0]] and r.m == [3.0, 4.0] and r.c == [2.0, 4.0]


def test_shapes(spark):
    df = spark.range(1).select("id", shape([[(0, 0), (2, 0), (2, 1), (1, 0.5), (0, 1), (0, 0)]]).alias("g"))
    m = shapes.measured(df).first()
    assert (m.hull_points, m.hull_area, m.box_area, m.kept_points) == (4, 2, 2, 6) and abs(m.circle_r - math.sqrt(5) / 2) < 1e-9
    tilted = spark.range(1).select("id", shape([[(0, 0), (1, 1), (0, 2), (-1, 1), (0, 0)]]).alias("g"))
    assert abs(shapes.measured(tilted).first().box_area - 2) < 1e-9
    at = shapes.labelled(spark.range(1).select("id", shape([SQUARE, HOLE]).alias("g"))).first()
    assert at.x > 2 and at.y > 2 and abs(at.distance - 2 * math.sqrt(2) / (1 + math.sqrt(2))) < 0.08
    line = spark.range(1).select("id", shape([[(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2), (0, 0)]]).alias("g"))
    assert shapes.simplified(line, 0.01).select(G.describe(F.col("g"))["npoint"]).first()[0] == 5


def test_mapping_layers(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "blockid string, geoid string")
    layers = records.layers(("main", table(("b1", "g1"), ("b2", "g1"), ("b3", "g2"))), ("over", table(("b2", "g3"))))
    got = lambda df: {r[0]: r[1] for r in df.collect()}
    assert got(records.map_override(layers))["b2"] == "g3" and got(records.map_all(layers))["b2"] == ["g1", "g3"] and got(records.map_main(layers))["b2"] == "g1"
    assert got(records.map_reverse(layers)) == {"g1": ["b1", "b2"], "g2": ["b3"], "g3": ["b2"]}


def test_records(spark):
    df = spark.createDataFrame([("k", 1, (1.0, 5.0, "x", (2.0, None))), ("k", 2, (2.0, 3.0, "y", (9.0, 1.0)))], "k string, ord long, rec struct<a:double,min:double,s:string,d:struct<max:double,n:double>>")
    assert records.accumulate(df, ["k"], "ord").first().rec.asDict(True) == {"a": 3.0, "min": 3.0, "s": "y", "d": {"max": 9.0, "n": 1.0}}
    ids = spark.range(100).select(F.col("id"), (-F.col("id")).alias("o")).repartition(5)
    assert {r.id: r.n for r in records.position(ids, "o").collect()} == {i: 100 - i for i in range(100)}
    a, b = spark.range(5).withColumn("entry_idx", F.lit(0)), spark.range(3)
    assert records.same_ids(a, b).first().equal is False and records.same_ids(a, a).first().equal is True
    assert records.show(a.select("id"), b).count() == 2 and records.find(a, b, 4).count() == 1 and records.find(a, b, 1).count() == 0


def test_position_over_sampled_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # as for tables of many partitions
    try:
        n = 200_000
        rows = spark.range(0, n, 1, 8).select("id", (F.col("id") * 7919 % n).alias("o"), F.concat(F.lit("row "), "id").alias("t"))
        got = records.position(rows, "o")
        wrong = F.count_if((F.col("n") != F.col("o") + 1) | (F.col("t") != F.concat(F.lit("row "), "id")))
        assert tuple(got.agg(F.count("*"), F.countDistinct("n"), wrong).first()) == (n, n, 0)
        assert got.filter("n = 1").select("o").first().o == 0
        assert records.canonical_ids(rows, "o").agg(F.countDistinct("id")).first()[0] == n
    finally:
        spark.conf.set(key, before)


def test_spatial(spark):
    grid = spark.createDataFrame([("c1", 0.0), ("c2", 1.0)], "id string, x double").select("id", G.box_polygon(F.col("x"), F.lit(1.0), F.col("x") + 1, F.lit(0.0)).alias("g"))
    pairs = {(r.id, r.neighbor) for r in spatial.contiguity(grid).collect()}
    assert pairs == {("c1", "c2"), ("c2", "c1"), ("c1", "OUT_OF_STATE"), ("c2", "OUT_OF_STATE"), ("OUT_OF_STATE", "c1"), ("OUT_OF_STATE", "c2")}
    nested = spark.createDataFrame([("big", 10.0), ("small", 2.0)], "district string, s double").select("district", G.box_polygon(F.lit(0.0), F.col("s"), F.col("s"), F.lit(0.0)).alias("g"))
    points = spark.createDataFrame([("p", 1.0, 1.0), ("q", 5.0, 5.0), ("r", 50.0, 5.0)], "id string, x double, y double")
    assert {r.id: r.district for r in spatial.assign_smallest(points, nested, 3.0).collect()} == {"p": "small", "q": "big"}
    arcs = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), (2, [(1.0, 0.0), (2.0, 0.0)])], "arc_id int, pts array<struct<x:double,y:double>>")
    assert spatial.duplicate_segments(arcs).count() == 1 and [tuple(r) for r in spatial.interior_sharing(arcs).collect()] == [(1.0, 0.0, 1, 1)]


@pytest.mark.parametrize("line, loose, strict", [("a, 'b,c' | \"d\" ,", ["a", "b,c", "d", ""], ["a", "'b", "c' ", "d", ""]), ('"a""b"', ['a"b"'], ['a"b']), ('"abc', ["abc"], ["ab"]), ("  ", [], []), ("a|b,,c", ["a", "b", "", "c"], ["a", "b", "", "c"]), ("a, b", ["a", "b"], ["a", "b"])])
def test_lines(spark, line, loose, strict):
    r = one(spark, text.fields(F.lit(line)).alias("l"), text.fields(F.lit(line), True).alias("s"))
    assert r.l == loose and r.s == strict


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"GEOID":"7"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]]]}},'
        '{"type":"Feature","properties":{"x":"1"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}},{"type":"Feature","properties":{},"geometry":null}]}'
    )
    rows = {r.id: r.g for r in text.read_geojson(spark, str(tmp_path / "a.json")).collect()}
    assert set(rows) == {"1", "2"} and [tuple(p) for p in rows["1"][0][0]] == [(0, 0), (1, 1), (0, 1), (0, 0)]
    same = '{"features":[%s]}' % ",".join(
        '{"type":"Feature","properties":{"district":"%s","GEOID30":null},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}' % d for d in "ba"
    )
    (tmp_path / "c.json").write_text(same.replace(',"GEOID30":null', ""))
    assert [r.id for r in text.read_geojson(spark, str(tmp_path / "c.json")).orderBy("ord").collect()] == ["b", "a"]
    (tmp_path / "d.json").write_text(same)
    assert [r.id for r in text.read_geojson(spark, str(tmp_path / "d.json")).orderBy("ord").collect()] == ["1", "2"]
    (tmp_path / "b.csv").write_text("a,b\n\n'c,d'|e\n")
    assert sorted(r.fields for r in text.read_lines(spark, str(tmp_path / "b.csv")).collect()) == [["a", "b"], ["c,d", "e"]]


def test_edits(spark):
    step = lambda op, n, data="": F.struct(F.lit(op).alias("op"), F.lit(n).alias("n"), F.lit(data).alias("data"))
    r = one(spark, edits.splice(edits.splice(F.lit("hello"), F.array(step("retain", 5), step("insert", 6, " world"))), F.array(step("delete", 5), step("retain", 6))))
    assert r[0] == " world"
    e = spark.createDataFrame([("r", "k", "add", 2.0, 1), ("r", "k", "add", 3.0, 2), ("r", "j", "add", 2.0, 1), ("r", "j", "del", None, 2)], "resource string, key string, op string, value double, clock int")
    assert [tuple(x) for x in edits.counter_state(e).collect()] == [("r", "k", 5.0)]
    assert sorted(tuple(x) for x in edits.counter_composed(e).collect()) == [("r", "j", "add", 2.0), ("r", "k", "add", 5.0)]
    s = spark.createDataFrame([("c", 0, 1), ("c", 1, 2), ("c", 1, 3), ("c", 3, 4)], "client string, seq int, arrival int")
    assert [x.status for x in edits.sequence_status(s).orderBy("arrival").collect()] == ["ok", "ok", "duplicate", "gap"]


def test_stream(spark, tmp_path):
    schema = "resource string, client string, seq long, key string, value double"
    rows = [("r", "a", 0, "k", 1.0), ("r", "a", 1, "k", 2.0), ("r", "a", 1, "k", 2.0), ("r", "b", 0, "k", 5.0), ("r", "b", 2, "k", 6.0), ("s", "a", 0, "j", 1.0)]
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = edits.ingest(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.resource, r.client, r.seq, r.clock, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.status == "ok")
    assert got == [("r", "a", 0, 1, "ok"), ("r", "a", 1, 2, "ok"), ("r", "b", 0, 3, "ok"), ("s", "a", 0, 1, "ok")]
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["duplicate", "gap", "ok", "ok", "ok", "ok"]

"""Registered queries of edits, logs, streams and text sources over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import scalars
from terrafold.operators import records
from terrafold.operators.staging import shared_dir, staged
from terrafold.plans.queries import _BOXES, _EDITS, event_edits, order_boxes
from terrafold.plans.registry import query, table
from terrafold.sources import text
from terrafold.streaming import edits


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
  SELECT k AS l_orderkey, true AS same, count(*) FILTER (i % 3 = 0 AND (k % 2 = 0 OR i < n))::INT AS n_set, CASE WHEN any_value(k) % 2 = 0 THEN 'insert' ELSE 'delete' END AS tail FROM l GROUP BY 1""")
def list_edits(spark, d):
    """An order's parts against its parts with every third replaced and one more, or one less, at the end; the edit applied gives the new list."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", at.alias("i"))
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "l_partkey"))).alias("v"))
    lists = lists.select("l_orderkey", F.transform("v", lambda s: s["l_partkey"]).alias("old"))
    new = F.transform("old", lambda x, i: F.when(i % 3 == 2, -x - 1).otherwise(x))
    new = F.when(F.col("l_orderkey") % 2 == 0, F.concat(new, F.array(F.lit(0).cast("bigint")))).otherwise(F.slice(new, F.lit(1), F.size(new) - 1))
    rows = lists.withColumn("new", new).withColumn("e", edits.list_diff(F.col("old"), F.col("new")))
    return rows.select("l_orderkey", (edits.splice_list(F.col("old"), F.col("e")) == F.col("new")).alias("same"), F.size(F.filter("e", lambda s: s["op"] == "set")).alias("n_set"), F.element_at("e", -1)["op"].alias("tail"))


@query("""SELECT doc_id, replace(coalesce(text, ''), 'e', 'E!') || '.' AS new, length(coalesce(text, '')) AS n_before, true AS joined FROM documents""")
def text_edits(spark, d):
    """Every text against a changed copy: the edit applied gives the copy; so do edits at both ends."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", t.alias("old"), F.concat(F.replace(t, F.lit("e"), F.lit("E!")), F.lit(".")).alias("new"))
    rows = rows.withColumn("e", edits.text_diff(F.col("old"), F.col("new")))
    old, mark = F.col("old"), F.lit("<>")
    ends = (edits.splice(old, edits.inserted_at_start(old, mark)) == F.concat(mark, old)) & (edits.splice(old, edits.inserted_at_end(old, mark)) == F.concat(old, mark))
    return rows.select("doc_id", edits.splice(old, F.col("e")).alias("new"), edits.edit_lengths(F.col("e"))["before"].alias("n_before"), ends.alias("joined"))


@query(f"""WITH l AS (SELECT resource, row_number() OVER (PARTITION BY resource ORDER BY event_id) + (resource % 3 = 0 AND event_id % 5 = 0)::INT AS clock, key, CASE WHEN gone THEN 'del' ELSE 'set' END AS op, value FROM {_EDITS}),
  b AS (SELECT resource, max(clock) AS high, count(*) = count(DISTINCT clock) AND max(clock) - min(clock) + 1 = count(*) AS good FROM l GROUP BY 1),
  s AS (SELECT resource, key, arg_max(value, clock) AS value, arg_max(gone, clock) AS gone FROM {_EDITS} GROUP BY ALL)
  SELECT l.resource, clock, key, op, round(value, 6) AS value, false AS rebuilt FROM l JOIN b ON b.resource = l.resource AND good
  UNION ALL SELECT s.resource, high, key, 'set', round(value, 6), true FROM s JOIN b ON b.resource = s.resource AND NOT good WHERE NOT gone""")
def validated_logs(spark, d):
    """Logs of a third of all resources have clocks that repeat or leave gaps; their states take their place."""
    e = event_edits(spark, d)
    clock = F.row_number().over(Window.partitionBy("resource").orderBy("clock.event_id")) + ((F.col("resource") % 3 == 0) & (F.col("clock.event_id") % 5 == 0)).cast("int")
    log = e.select("resource", clock.cast("bigint").alias("clock"), "key", "op", "value")
    return edits.validated_log(log, edits.map_state(e)).withColumn("value", F.round("value", 6))


@query(f"""WITH s AS (SELECT resource, key, value FROM (SELECT resource, key, arg_max(value, clock) AS value, arg_max(gone, clock) AS gone FROM {_EDITS} GROUP BY ALL) WHERE NOT gone)
  SELECT resource, key, value FROM s WHERE resource % 3 = 0 OR key <> 'k1'""")
def collected_state(spark, d):
    """State whose registries, for two thirds of all resources, name two of three keys."""
    e = event_edits(spark, d)
    live = e.filter("resource % 3 <> 0").select("resource", F.explode(F.array(F.lit("k0"), F.lit("k2"))).alias("key")).distinct()
    return edits.collected(edits.map_state(e), live)


@query("""WITH e AS (SELECT event_id, 'r' || user_id % 50 AS resource, 'u' || user_id AS client, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY client, seq) AS clock FROM e)
  SELECT resource, client, seq::BIGINT AS seq, clock::BIGINT AS clock, 'ok' AS status FROM k UNION ALL SELECT resource, client, seq, NULL, 'duplicate' FROM k WHERE event_id % 11 = 0""")
def stream_ingest(spark, d):
    """All events as a stream of their users' edits, every eleventh sent twice: clocks for the first, rejects for the others."""
    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = e.select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("resource"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client"), seq.cast("bigint").alias("seq"), F.col("event_type").alias("key"), "value", "event_id")
    source = staged(e.unionByName(e.filter("event_id % 11 = 0")).drop("event_id"), "events")
    place = staged(spark.range(1), "stream").staged_path  # a new folder below the shared one
    got = edits.ingest(spark.readStream.schema(source.schema).parquet(source.staged_path))
    done = got.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{place}/out").select("resource", "client", "seq", "clock", "status")


@query("""SELECT p_partkey, 4 AS n, p_name || ' "x", y' AS name, p_size::VARCHAR AS last FROM part""")
def csv_quoted(spark, d):
    """Strict lines with a quoted field that holds doubled quotes and a separator."""
    part = table(spark, d, "part")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(',"'), F.col("p_name"), F.lit(' ""x"", y"|b,'), F.col("p_size").cast("string"))
    f = text.fields(line, strict=True)
    return part.select("p_partkey", F.size(f).alias("n"), F.get(f, F.lit(1)).alias("name"), F.element_at(f, -1).alias("last"))


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS name, 5 AS n_points, c_custkey % 9 * 1.0::DOUBLE AS lft FROM customer""")
def geojson_features(spark, d):
    """A collection for each hundred customers, written as text and read back."""
    c = table(spark, d, "customer")
    x, y = (F.col("c_custkey") % 9).cast("double"), F.floor(F.col("c_custkey") / 9).cast("double")
    ring = F.array(*(F.array(x + i, y + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("c_custkey").cast("string").alias("GEOID"), F.col("c_name").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    whole = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("part")).agg(F.collect_list(feature).alias("features"))
    place = f"{shared_dir(spark)}/{staged(spark.range(1), 'geojson').staged_path.rsplit('/', 1)[1]}/files"
    whole.select("part", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.partitionBy("part").text(place)
    got = text.read_geojson(spark, f"{place}/*")
    return got.select("id", F.col("properties")["name"].alias("name"), F.size(G.points(F.col("g"))).alias("n_points"), G.bounds(F.col("g"), False)["left"].alias("lft"))


@query("""SELECT c_custkey, -99.0::DOUBLE AS lon, round(degrees(mu + (3 * e / 2 - 27 * e ** 3 / 32) * sin(2 * mu) + (21 * e ** 2 / 16 - 55 * e ** 4 / 32) * sin(4 * mu) + 151 * e ** 3 / 96 * sin(6 * mu) + 1097 * e ** 4 / 512 * sin(8 * mu)), 6) AS lat
  FROM (SELECT c_custkey, (1000000.0::DOUBLE + c_custkey % 80 * 100000) / 0.9996 / (6378137.0::DOUBLE * (1 - q / 4 - 3 * q ** 2 / 64 - 5 * q ** 3 / 256)) AS mu, (1 - sqrt(1 - q)) / (1 + sqrt(1 - q)) AS e
  FROM customer, (SELECT (2 - 1 / 298.257223563::DOUBLE) / 298.257223563::DOUBLE AS q))""")
def utm_degrees(spark, d):
    """Boxes' corners on the middle meridian of UTM zone 14, by the system that their collection names."""
    n = 1000000.0 + F.col("c_custkey") % 80 * 100000
    c = table(spark, d, "customer").select("c_custkey", F.array(F.array(F.array(G.point(F.lit(500000.0), n)))).alias("g"), F.lit(text.UTM14).alias("crs"))
    p = F.get(G.points(text.in_degrees(F.col("g"), F.col("crs"))), F.lit(0))
    return c.select("c_custkey", F.round(p["x"], 6).alias("lon"), p["y"].alias("y")).select("c_custkey", "lon", F.round("y", 6).alias("lat"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'third' WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'all' END AS tag FROM part WHERE p_partkey % 7 <> 1 AND p_partkey % 10 <> 3""")
def edited_collections(spark, d):
    """Collections put together, taken out, hidden and shown: the third replaces the second, one goes again, some hidden ids are shown."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"))
    hidden = part.filter("id % 7 in (1, 2)")
    other = records.Collections().add("third", part.filter("id % 3 = 0")).hide(part.filter("id % 10 = 3"))
    c = records.Collections().add("all", part).add("gone", part).add("even", part.filter("id % 2 = 0")).hide(hidden)
    c = c.show(part.filter("id % 7 = 2")).remove("gone").add_multi(other)
    return c.visible().select("id", "tag")


@query("""SELECT p_partkey AS id FROM part WHERE p_size > 10 AND p_partkey % 2 = 0""")
def collection_of_collections(spark, d):
    """What one set of collections shows becomes a collection of another, which hides other ids instead."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), "p_size")
    inner = records.Collections().add("small", part.filter("p_size <= 25")).add("large", part.filter("p_size > 25")).hide(part.filter("p_size <= 10"))
    outer = records.Collections().hide(part.filter("id % 3 = 0")).add_all("shown", inner).hide_set_all(part.filter("id % 2 = 1"))
    return outer.filter("true").hide_set_all(part.filter("id % 2 = 1")).visible().select("id")


@query(f"""SELECT id, '1 1 5 ' || 'ok' AS head, true AS same FROM {_BOXES}""")
def packed_texts(spark, d):
    """Geometries as lists of numbers, and back."""
    b = order_boxes(spark, d).select("id", "g", text.number_list(F.col("g")).alias("t"))
    return b.select("id", F.concat(F.substring("t", 1, 6), F.lit("ok")).alias("head"), (text.from_number_list(F.col("t")) == F.col("g")).alias("same"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types, 1 + (count(*) FILTER (event_type <> 'error') > 0)::INT AS depth, (count(*) FILTER (event_type <> 'error'))::INT AS n_marks, bool_or(event_type = 'view') AS maybe
  FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def small_values(spark, d):
    """Sets as bit texts and back; marks of which ``error`` is none and ``view`` undetermined, and how deep they nest."""
    domain = ["signup", "purchase", "view", "click", "error"]
    per = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    bits = scalars.members_of_string(scalars.bit_string(F.col("s"), domain), domain)
    state = F.map_from_arrays("s", F.transform("s", lambda x: F.when(x == "error", False).when(x != "view", True)))
    rows = per.select("user_id", F.array_join(F.array_sort(bits), ",").alias("types"), scalars.marked(state).alias("m"))
    return rows.select("user_id", "types", F.when(F.size("m") == 0, 1).otherwise(scalars.depth_of(F.col("m"), rows.schema["m"].dataType)).alias("depth"), F.size("m").alias("n_marks"), scalars.undetermined(F.col("m"), F.lit("view")).alias("maybe"))


@query("""WITH RECURSIVE j AS (SELECT p_partkey, '{"a":' || p_partkey || ',"b":"' || p_brand || '"}' AS t FROM part), h AS (SELECT p_partkey, t, length(t) AS k, 5381::BIGINT AS h FROM j
  UNION ALL SELECT p_partkey, t, k - 1, xor(h * 33, ascii(substr(t, k, 1))::BIGINT) & 4294967295 FROM h WHERE k > 0)
  SELECT p_partkey, h AS hash FROM h WHERE k = 0""")
def object_hash(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", scalars.hash_object(F.struct(F.col("p_partkey").alias("a"), F.col("p_brand").alias("b"))).alias("hash"))

"""Registered queries over the given tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import arrays, palette, scalars
from terrafold.operators import clipping, filters, records, shapes, spatial
from terrafold.plans.registry import query, table
from terrafold.sources import text
from terrafold.streaming import edits

#: The moment that date queries call now.
NOW = "1997-06-15 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


# filters


@query("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'widget') AND p_size < 20")
def filter_field_and_relation(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return filters.filter_rows(part, "p_name: widget and p_size: < 20")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def filter_text_any(spark, d):
    part = table(spark, d, "part")
    return filters.filter_rows(part, "red", types={c: "skip" for c in part.columns if c not in ("p_name", "p_brand", "p_type")}).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND NOT contains(lower(o_orderpriority), 'urgent')")
def filter_relational(spark, d):
    return filters.filter_rows(table(spark, d, "orders"), "o_totalprice: >= 100000 and not o_orderpriority: urgent").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE (contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto'))
  AND NOT contains(lower(c_name), '7') AND c_acctbal > 0""")
def filter_not_and_or(spark, d):
    return filters.filter_rows(table(spark, d, "customer"), "c_mktsegment: (build or auto) and not c_name: 7 and c_acctbal: > 0").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) <> 'f' AND o_orderstatus <> '' AND lower(o_orderpriority) > '3'")
def filter_text_comparison(spark, d):
    return filters.filter_rows(table(spark, d, "orders"), "o_orderstatus: != f and o_orderpriority: > '3-'", types={"o_comment": "skip"}).filter("o_orderpriority >= '3'").select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE contains(lower(strftime(o_orderdate, '%b %-d, %Y') || ' at ' ||
  CASE WHEN hour(o_orderdate) > 12 THEN hour(o_orderdate) - 12 ELSE hour(o_orderdate) END || strftime(o_orderdate, ':%M') ||
  CASE WHEN hour(o_orderdate) >= 12 THEN ' PM' ELSE ' AM' END), 'mar 1')""")
def filter_date_word(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return filters.filter_rows(orders, "o_orderdate: 'mar 1'", types={"o_orderdate": "date"}, now=_now()).select("o_orderkey")


@query("""SELECT p_partkey, lower(concat_ws('|', p_name, p_brand, p_size::VARCHAR)) AS _search FROM part
  WHERE contains(lower(concat_ws('|', p_name, p_brand, p_size::VARCHAR)), 'blue')""")
def filter_search_text(spark, d):
    part = table(spark, d, "part")
    searched = filters.with_search_text(part.select("p_name", "p_brand", "p_size", "p_partkey"), types={"p_partkey": "skip"})
    return searched.select("p_partkey", F.regexp_replace("_search", r"\|$", "").alias("_search")).filter(F.contains("_search", F.lit("blue")))


@query("""SELECT l_orderkey, l_linenumber, floor(coalesce(l_extendedprice * (1 - l_discount) / nullif(l_quantity + l_tax, 0), 0) * 100 + 0.123456) AS value,
  round(l_quantity + l_discount + l_tax, 4) AS total FROM lineitem""")
def detail_and_total(spark, d):
    line = table(spark, d, "lineitem")
    value = filters.detail("=l_extendedprice * (1 - l_discount) / (l_quantity + l_tax)", line.columns)
    out = filters.row_total(line, ["l_quantity", "l_discount", "l_tax"], "Total")
    return out.select("l_orderkey", "l_linenumber", F.floor(value * 100 + 0.123456).cast("double").alias("value"), F.round("Total", 4).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_discount <> 0 THEN floor(l_extendedprice / l_quantity * 100 + 0.123456) ELSE l_tax - 1 END AS value FROM lineitem""")
def detail_conditional(spark, d):
    line = table(spark, d, "lineitem")
    value = filters.detail("=l_quantity > 25 && l_discount != 0 ? l_extendedprice / l_quantity : -1 + l_tax", line.columns)
    return line.select("l_orderkey", "l_linenumber", F.when(value > 0, F.floor(value * 100 + 0.123456).cast("double")).otherwise(value).alias("value"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN substr('08' || c_custkey, 3)
  WHEN 2 THEN trim(replace(c_name, 'Customer', '')) ELSE trim(c_mktsegment) END AS name FROM customer""")
def display_names(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 4
    rows = c.select(
        "c_custkey",
        F.col("c_custkey").cast("string").alias("id"),
        F.when(k == 1, F.concat(F.lit("Block Group "), F.col("c_name"))).when(k == 2, F.concat(F.regexp_replace("c_name", "Customer", "Voting District"), F.lit(" "))).alias("NAME"),
        F.when(k == 3, F.concat(F.lit("Precinct "), F.col("c_mktsegment"))).alias("NAMELSAD20"),
        F.concat(F.lit("08"), F.col("c_custkey").cast("string")).alias("GEOID10"),
    )
    return rows.select("c_custkey", records.display_name(rows.columns).alias("name"))


@query(f"""SELECT o_orderkey, o_orderstatus = 'O' AS is_public, o_custkey % 7 <> 3 AS is_shared, o_custkey % 7 = 3 AND d AS is_trash,
  o_custkey % 7 = 3 AND NOT d AND o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS is_recent, o_custkey % 7 = 3 AND NOT d AS is_owned
  FROM (SELECT *, o_orderkey % 5 = 0 AS d FROM orders)""")
def session_modes(spark, d):
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", (F.col("o_custkey") % 7).cast("string").alias("createdBy"), F.when(F.col("o_orderstatus") == "O", "yes").alias("published"), (F.col("o_orderkey") % 5 == 0).alias("deleted"), F.col("o_orderdate").alias("modifyTime"))
    return rows.select("o_orderkey", *(c.alias(f"is_{m}") for m, c in filters.session_mode("3", _now()).items()))


@query("""SELECT c_nationkey, bit_or((1 << (c_custkey % 4))::INT) AS perm FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1""")
def access_permissions(spark, d):
    entries = table(spark, d, "customer").select("c_nationkey", F.array(F.concat(F.lit("u"), (F.col("c_custkey") % 3).cast("string"))).alias("userIDs"), F.expr("CAST(1 << CAST(c_custkey % 4 AS INT) AS INT)").alias("perm"))
    return filters.access_map_permission(entries, ["c_nationkey"], "u1")


# records


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, min(l_discount) AS low, max(l_tax) AS high,
  arg_max(l_shipdate::VARCHAR, (l_orderkey, l_linenumber, l_shipdate)) AS last_ship FROM lineitem GROUP BY ALL""")
def deep_accumulate(spark, d):
    line = table(spark, d, "lineitem")
    rec = F.struct(
        F.col("l_quantity").alias("qty"),
        F.struct(F.col("l_extendedprice").alias("price"), F.struct(F.col("l_discount").alias("min"), F.col("l_tax").alias("max")).alias("ends")).alias("money"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship"),
    )
    rows = line.select("l_returnflag", "l_linestatus", F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("ord"), rec.alias("rec"))
    out = records.accumulate(rows, ["l_returnflag", "l_linestatus"], "ord")
    return out.select("l_returnflag", "l_linestatus", F.round("rec.qty", 2).alias("qty"), F.round("rec.money.price", 2).alias("price"), F.col("rec.money.ends.min").alias("low"), F.col("rec.money.ends.max").alias("high"), F.col("rec.ship").alias("last_ship"))


@query("""SELECT user_id, list_sum(map_values(m))::DOUBLE AS total, cardinality(m)::INT AS n FROM (
  SELECT user_id, map_from_entries(list((event_type, v))) AS m FROM (SELECT user_id, event_type, round(sum(value), 4) AS v FROM events GROUP BY ALL) GROUP BY 1)""")
def accumulate_maps(spark, d):
    rows = table(spark, d, "events").select("user_id", F.create_map("event_type", "value").alias("m"))
    out = records.accumulate_map(rows, ["user_id"], "m")
    return out.select("user_id", F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, v: s + F.round(v, 4)), 6).alias("total"), F.size("m").alias("n"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def reverse_mapping(spark, d):
    out = records.reverse_mapping(table(spark, d, "orders"), "o_orderkey", "o_custkey")
    return out.select("o_custkey", F.array_join(F.col("o_orderkeys").cast("array<string>"), ",").alias("orders"))


def _layers(spark, d):
    key, value = (lambda c: F.col(c).cast("string")), (lambda c: F.concat(F.lit("n"), F.col(c).cast("string")))
    customer, supplier, part = (table(spark, d, t) for t in ("customer", "supplier", "part"))
    return records.layers(
        ("customer", customer.select(key("c_custkey").alias("blockid"), value("c_nationkey").alias("geoid"))),
        ("supplier", supplier.select(key("s_suppkey").alias("blockid"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(value("s_nationkey")).alias("geoid"))),
        ("part", part.select(key("p_partkey").alias("blockid"), value("p_size").alias("geoid"))),
    )


_LAYERS = """WITH l AS (SELECT c_custkey::VARCHAR AS b, 'n' || c_nationkey AS g, 0 AS i FROM customer
  UNION ALL SELECT s_suppkey::VARCHAR, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'n' || s_nationkey END, 1 FROM supplier
  UNION ALL SELECT p_partkey::VARCHAR, 'n' || p_size, 2 FROM part) """


@query(_LAYERS + "SELECT b AS blockid, arg_max(g, i) AS geoid FROM l WHERE g <> '' GROUP BY 1")
def mapping_override(spark, d):
    return records.map_override(_layers(spark, d))


@query(_LAYERS + "SELECT b AS blockid, string_agg(g, ',' ORDER BY i) AS geoids FROM l WHERE g <> '' GROUP BY 1")
def mapping_all(spark, d):
    return records.map_all(_layers(spark, d)).select("blockid", F.array_join("geoids", ",").alias("geoids"))


@query(_LAYERS + "SELECT b AS blockid, g AS geoid FROM l WHERE i = 0")
def mapping_main(spark, d):
    return records.map_main(_layers(spark, d))


@query(_LAYERS + ", p AS (SELECT g, i, string_agg(b, ',' ORDER BY b) AS bs FROM l GROUP BY ALL) SELECT g AS geoid, arg_max(bs, i) AS blocks FROM p GROUP BY 1")
def mapping_reverse(spark, d):
    return records.map_reverse(_layers(spark, d)).select("geoid", F.array_join("blocks", ",").alias("blocks"))


@query("""WITH t AS (SELECT DISTINCT substr(p_brand, 1, n) AS prefix, substr(p_brand, 1, n) || '!' AS v, n FROM part, (SELECT unnest([6, 7]) AS n) WHERE p_size > 25 OR n = 6)
  SELECT p_partkey, p_brand, (SELECT arg_max(v, n) FROM t WHERE starts_with(p_brand, prefix)) AS value FROM part""")
def prefix_lookup(spark, d):
    part = table(spark, d, "part")
    short, long = (part.filter(w).select(F.substring("p_brand", 1, n).alias("prefix")) for w, n in (("true", 6), ("p_size > 25", 7)))
    prefixes = short.unionByName(long).distinct().withColumn("value", F.concat("prefix", F.lit("!")))
    brands = part.select("p_brand").distinct()
    found = records.lookup_prefix(brands, "p_brand", prefixes, [6, 7])
    return part.select("p_partkey", "p_brand").join(found, "p_brand", "left").select("p_partkey", "p_brand", "value")


@query("""SELECT p_size AS id, arg_max(p_partkey, (p_brand_n, p_partkey)) AS p_partkey FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS p_brand_n FROM part)
  WHERE p_size % 7 <> 0 GROUP BY 1""")
def union_visible(spark, d):
    part = table(spark, d, "part").select(F.col("p_size").alias("id"), "p_partkey", F.col("p_partkey").alias("ord"))
    hidden = part.filter("id % 7 = 0").select("id")
    parts = [("even", part.filter("p_partkey % 2 = 0")), ("odd", part.filter("p_partkey % 2 <> 0"))]
    return records.union_visible(parts, hidden).select("id", "p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def hidden_anti_join(spark, d):
    hidden = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return records.hide(table(spark, d, "customer"), hidden, "c_nationkey").select("c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey)::VARCHAR AS id FROM customer")
def canonical_ids(spark, d):
    c = table(spark, d, "customer").withColumn("o", F.struct("c_acctbal", "c_custkey"))
    return records.canonical_ids(c, "o").select("c_custkey", "id")


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_nationkey <> 3 AND c_acctbal > 0) WHERE n = 11""")
def nth_visible(spark, d):
    c = table(spark, d, "customer")
    hidden = c.filter("c_nationkey = 3").select("c_nationkey").distinct()
    return records.position(records.hide(c, hidden, "c_nationkey").filter("c_acctbal > 0"), "c_custkey").filter("n = 11").select("c_custkey")


@query("SELECT (SELECT count(*) = count(DISTINCT p_partkey) FROM part) AS part_ids, (SELECT count(*) = count(DISTINCT p_size) FROM part) AS part_sizes")
def valid_ids(spark, d):
    part = table(spark, d, "part")
    return records.valid_ids(part, "p_partkey").select(F.col("valid").alias("part_ids")).crossJoin(records.valid_ids(part, "p_size").select(F.col("valid").alias("part_sizes")))


@query("""WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 1 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)
  SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size""")
def version_delta(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size"))
    new = part.filter("p_partkey % 5 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 6 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return records.delta(part.filter("p_partkey % 4 <> 0"), new, "p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def partial_equal(spark, d):
    return table(spark, d, "customer").filter(scalars.partial_equal({"c_mktsegment": "BUILDING", "c_nationkey": 3})).select("c_custkey")


# scalars


@query("""SELECT l_orderkey, l_linenumber, floor((l_extendedprice - 30000) * 10 + 0.5) / 10 AS half_up,
  CASE WHEN l_quantity = 7 THEN '(-)' ELSE (floor(l_tax / nullif(l_quantity - 7, 0) * 10000 + 0.5)::BIGINT)::VARCHAR || '%' END AS share,
  round(sqrt((l_quantity - l_tax) ** 2 + (l_discount * 100) ** 2), 6) AS dist,
  (l_extendedprice - 360 * floor((l_extendedprice + 180) / 360)) AS lon, round(radians(l_quantity), 9) AS rad FROM lineitem""")
def number_scalars(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.round_half_up(c("l_extendedprice") - 30000, 1).alias("half_up"),
        scalars.percent_text(c("l_tax") * 100, c("l_quantity") - 7).alias("share"), F.round(scalars.distance(c("l_tax"), F.lit(0.0), c("l_quantity"), c("l_discount") * 100), 6).alias("dist"),
        scalars.wrap_longitude(c("l_extendedprice")).alias("lon"), F.round(F.radians("l_quantity"), 9).alias("rad"),
    )


@query("""SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN floor(p_retailprice)::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS shown,
  regexp_matches(s, '^\\s*-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?\\s*$') AS numeric, coalesce(CASE WHEN regexp_matches(s, '^\\s*-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?\\s*$') THEN trim(s)::DOUBLE END, 0) AS safe,
  lower(lpad(to_hex(p_size), 2, '0')) AS hex FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN ' -' || p_size || '.5 ' WHEN 2 THEN p_size || 'd' ELSE p_name END AS s FROM part)""")
def text_numbers(spark, d):
    part = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 4 == 0, size).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" -"), size, F.lit(".5 "))).when(F.col("p_partkey") % 4 == 2, F.concat(size, F.lit("d"))).otherwise(F.col("p_name"))
    return part.select("p_partkey", scalars.number_text(F.col("p_retailprice")).alias("shown"), scalars.is_number(s).alias("numeric"), scalars.to_safe_number(s).alias("safe"), scalars.hex_byte(F.col("p_size")).alias("hex"))


@query("""WITH RECURSIVE h AS (SELECT p_partkey, p_name, length(p_name) AS k, 5381::BIGINT AS h FROM part
  UNION ALL SELECT p_partkey, p_name, k - 1, xor(h * 33, ascii(substr(p_name, k, 1))::BIGINT) & 4294967295 FROM h WHERE k > 0)
  SELECT p_partkey, h AS hash FROM h WHERE k = 0""")
def text_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.text_hash(F.col("p_name")).alias("hash"))


_CLOCK = "CASE WHEN hour(t) > 12 THEN hour(t) - 12 ELSE hour(t) END || strftime(t, ':%M') || CASE WHEN hour(t) >= 12 THEN ' PM' ELSE ' AM' END"


@query(f"""SELECT event_id, strftime(t, '%b %-d, %Y') || ' at ' || {_CLOCK} AS pretty,
  CASE WHEN t::DATE = n::DATE THEN 'Today at ' || {_CLOCK} WHEN year(t) = year(n) THEN strftime(t, '%b %-d') ELSE strftime(t, '%b %-d, %Y') END AS relative,
  CASE WHEN ms < 3600000 THEN (floor(ms / 60000 + 0.5) + 1)::BIGINT || 'm' WHEN ms < 86400000 THEN (floor(ms / 3600000 + 0.5) + 1)::BIGINT || 'h'
    WHEN t::DATE = n::DATE THEN 'Today at ' || {_CLOCK} WHEN year(t) = year(n) THEN strftime(t, '%b %-d') ELSE strftime(t, '%b %-d, %Y') END AS recent
  FROM (SELECT event_id, ts AS t, m AS n, (epoch_ms(m) - epoch_ms(ts))::DOUBLE AS ms FROM events, (SELECT max(ts) AS m FROM events))""")
def date_scalars(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.crossJoin(F.broadcast(now))  # one row: the latest moment
    t, n = F.col("ts"), F.col("now")
    return rows.select("event_id", scalars.pretty_date(t).alias("pretty"), scalars.relative_date(t, n).alias("relative"), scalars.recent_date(t, n).alias("recent"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types, bit_or(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 WHEN 'click' THEN 8 WHEN 'error' THEN 16 ELSE 0 END)::INT AS bits
  FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def sets_and_bits(spark, d):
    domain = ["signup", "purchase", "view", "click", "error"]
    per = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    bits = scalars.bits_of(F.col("s"), domain)
    members = scalars.members_of(bits, domain)
    return per.select("user_id", F.array_join(scalars.sorted_set(members), ",").alias("types"), F.conv(F.hex(bits), 16, 10).cast("int").alias("bits"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS changed FROM (SELECT user_id, event_type, arg_max(value, event_id) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 0) AS na,
  arg_max(value, event_id) FILTER (event_id % 2 = 1) AS b, count(*) FILTER (event_id % 2 = 1) AS nb FROM events GROUP BY ALL) WHERE nb > 0 AND (na = 0 OR a IS DISTINCT FROM b) GROUP BY 1""")
def map_key_diff(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id", (F.col("event_id") % 2).alias("v"), "event_type").agg(F.max_by("value", "event_id").alias("value"))
    maps = last.groupBy("user_id").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("v") == v, F.struct("event_type", "value")))).alias(n) for v, n in ((0, "old"), (1, "new"))))
    return maps.select("user_id", F.array_join(scalars.key_diff(F.col("old"), F.col("new")), ",").alias("changed")).filter("changed <> ''")


@query("""SELECT c_custkey, CASE WHEN v < 0 THEN '#ff0000' WHEN v < 0.5 THEN '#' || lower(lpad(to_hex(floor(255 - 255 * v / 0.5)::INT), 2, '0')) || lower(lpad(to_hex(floor(255 * v / 0.5)::INT), 2, '0')) || '00'
  WHEN v < 1 THEN '#00' || lower(lpad(to_hex(floor(255 - 255 * (v - 0.5) / 0.5)::INT), 2, '0')) || lower(lpad(to_hex(floor(255 * (v - 0.5) / 0.5)::INT), 2, '0')) ELSE '#0000ff' END AS color
  FROM (SELECT c_custkey, c_acctbal / 8000 AS v FROM customer)""")
def gradient_color(spark, d):
    stops = palette.parse_gradient("#ff0000 0, #00ff00 50%, #0000ff 1")
    return table(spark, d, "customer").select("c_custkey", palette.gradient(F.col("c_acctbal") / 8000, stops).alias("color"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'GhostWhite' ELSE list_extract(['#a00000', '#00a000', '#0000a0'], (((n_nationkey - 1) % 3) + 1)::INT) END AS color FROM nation")
def cyclic_color(spark, d):
    return table(spark, d, "nation").select("n_nationkey", palette.cyclic_color(F.col("n_nationkey"), ["#a00000", "#00a000", "#0000a0"]).alias("color"))


# sources


@query("SELECT p_partkey, 5 AS n, trim(p_name) AS name, p_type AS kind, '' AS last FROM part")
def csv_loose(spark, d):
    part = table(spark, d, "part")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(" ,'"), F.col("p_name"), F.lit("' | \""), F.col("p_type"), F.lit("\" ,"), F.col("p_size").cast("string"), F.lit(" |"))
    f = text.fields(line)
    return part.select("p_partkey", F.size(f).alias("n"), F.trim(F.get(f, F.lit(1))).alias("name"), F.get(f, F.lit(2)).alias("kind"), F.element_at(f, -1).alias("last"))


@query("SELECT p_partkey, 3 AS n, p_name AS name, p_size::VARCHAR AS last FROM part")
def csv_strict(spark, d):
    part = table(spark, d, "part")
    line = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(", "), F.col("p_name"), F.lit("|"), F.col("p_size").cast("string"))
    f = text.fields(line, strict=True)
    return part.select("p_partkey", F.size(f).alias("n"), F.get(f, F.lit(1)).alias("name"), F.element_at(f, -1).alias("last"))


# geometry: a rectangle for each nation and order, points for customers


def nation_boxes(spark, d):
    n = table(spark, d, "nation")
    x, y = (F.lit(-120) + 2 * (F.col("n_nationkey") % 5)).cast("double"), (F.lit(30) + 2 * F.floor(F.col("n_nationkey") / 5)).cast("double")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), "n_nationkey", "n_regionkey", G.box_polygon(x, y + 2, x + 2, y).alias("g"))


def order_boxes(spark, d, spread=False):
    """A box for each order; with ``spread`` the orders are dealt to all cores first, by their two keys alone."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    o = shapes.spread(o) if spread else o
    x, y = -120 + F.col("o_custkey") % 97 * 0.25, 30 + F.col("o_orderkey") % 89 * 0.125
    w, h = 0.5 + F.col("o_orderkey") % 7 * 0.25, 0.5 + F.col("o_custkey") % 5 * 0.25
    return o.select(F.col("o_orderkey").alias("id"), G.box_polygon(x, y + h, x + w, y).alias("g"))


_BOXES = "(SELECT o_orderkey AS id, -120 + o_custkey % 97 * 0.25::DOUBLE AS x, 30 + o_orderkey % 89 * 0.125::DOUBLE AS y, 0.5 + o_orderkey % 7 * 0.25::DOUBLE AS w, 0.5 + o_custkey % 5 * 0.25::DOUBLE AS h FROM orders)"


@query(f"""SELECT id, round(abs(radians(w) * (sin(radians(y + h)) - sin(radians(y)))) * 6371000.0 ** 2 / 1e6, 3) AS km2, w * h AS flat, 2 * (w + h) AS around, 1 AS npoly, 0 AS nhole, 5 AS npoint FROM {_BOXES}""")
def box_measures(spark, d):
    g = F.col("g")
    m = order_boxes(spark, d).select("id", F.round(G.area(g) / 1e6, 3).alias("km2"), G.area_flat(g).alias("flat"), G.perimeter_flat(g).alias("around"), G.describe(g).alias("d"))
    return m.select("id", "km2", "flat", "around", "d.*")


@query(f"""SELECT id, round((2 * 6371000.0 * asin(sin(radians(h / 2))) * 2 + 2 * 6371000.0 * (asin(cos(radians(y)) * sin(radians(w / 2))) + asin(cos(radians(y + h)) * sin(radians(w / 2))))) / 1000, 3) AS km FROM {_BOXES}""")
def box_perimeter(spark, d):
    return order_boxes(spark, d).select("id", F.round(G.perimeter(F.col("g")) / 1000, 3).alias("km"))


@query(f"SELECT id, x AS lft, y + h AS top, x + w AS rgt, y AS bottom, -2 * w * h AS direction, false AS bad, x + w / 2 AS cx FROM {_BOXES}")
def box_bounds(spark, d):
    b = order_boxes(spark, d).select("id", "g", G.bounds(F.col("g")).alias("b"))
    direction = F.get(F.get(G.windings(F.col("g")), F.lit(0)), F.lit(0))
    return b.select("id", F.col("b.left").alias("lft"), "b.top", F.col("b.right").alias("rgt"), "b.bottom", F.round(direction, 9).alias("direction"), G.bad_coordinates(F.col("g")).alias("bad"), G.bounds_center(F.col("b"))[0].alias("cx"))


@query(f"SELECT id FROM {_BOXES} WHERE x >= -115 AND x + w <= -105 AND y >= 33 AND y + h <= 39")
def select_bounds(spark, d):
    return spatial.select_box(order_boxes(spark, d), -115.0, 39.0, -105.0, 33.0, "bounds").select("id")


@query(f"SELECT id FROM {_BOXES} WHERE x + w / 2 > -115 AND x + w / 2 <= -105 AND y + h / 2 >= 33 AND y + h / 2 < 39")
def select_center(spark, d):
    return spatial.select_box(order_boxes(spark, d), -115.0, 39.0, -105.0, 33.0, "center").select("id")


@query(f"SELECT id FROM {_BOXES} WHERE x <= -105 AND x + w >= -115 AND y <= 39 AND y + h >= 33")
def select_overlap(spark, d):
    return spatial.select_box(order_boxes(spark, d), -115.0, 39.0, -105.0, 33.0, "overlap").select("id")


def customer_points(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), (-121 + F.col("c_custkey") % 131 * 0.1 + 0.03).alias("x"), (29 + F.col("c_custkey") % 127 * 0.1 + 0.07).alias("y"))


_POINTS = "(SELECT c_custkey AS id, -121 + c_custkey % 131 * 0.1::DOUBLE + 0.03 AS px, 29 + c_custkey % 127 * 0.1::DOUBLE + 0.07 AS py FROM customer)"
_NATIONS = "(SELECT 'n' || n_nationkey AS n, -120 + 2 * (n_nationkey % 5) AS nx, 30 + 2 * (n_nationkey // 5) AS ny FROM nation)"


@query(f"SELECT id, n AS district FROM {_POINTS}, {_NATIONS} WHERE px > nx AND px < nx + 2 AND py > ny AND py < ny + 2")
def point_in_polygon(spark, d):
    boxes = nation_boxes(spark, d).select(F.col("id").alias("district"), "g")
    return spatial.points_in(customer_points(spark, d), boxes, 1.0).select(F.col("p").alias("id"), F.col("f").alias("district"))


def _least_areas(spark, d, boxes):
    boxes = boxes.select(F.col("id").alias("district"), "g")
    got = spatial.assign_smallest(customer_points(spark, d), boxes, 1.0, area="area")
    return got.select("id", F.round(F.col("area") / G.EARTH_RADIUS**2, 9).alias("least"))


@query(f"""WITH m AS (SELECT p.id, b.id AS district, abs(radians(w) * (sin(radians(y + h)) - sin(radians(y)))) AS a FROM {_POINTS} p, {_BOXES} b WHERE px > x AND px < x + w AND py > y AND py < y + h)
  SELECT id, round(min(a), 9) AS least FROM m GROUP BY 1""")
def assign_smallest(spark, d):
    return _least_areas(spark, d, order_boxes(spark, d, spread=True))


@query("""WITH c AS (SELECT n_nationkey AS k, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation), e AS (SELECT a.k, b.k AS o, 'n' || a.k AS id, 'n' || b.k AS neighbor FROM c a, c b WHERE abs(a.i - b.i) + abs(a.j - b.j) = 1),
  o AS (SELECT DISTINCT 'n' || k AS id FROM c WHERE i IN (0, 4) OR j IN (0, 4))
  SELECT id, neighbor FROM e UNION SELECT id, 'OUT_OF_STATE' FROM o UNION SELECT 'OUT_OF_STATE', id FROM o""")
def contiguity(spark, d):
    return spatial.contiguity(nation_boxes(spark, d))


@query("""SELECT n_regionkey, count(*)::BIGINT AS n, string_agg('n' || n_nationkey, ',' ORDER BY 'n' || n_nationkey) AS blocks FROM nation GROUP BY 1""")
def virtual_features(spark, d):
    boxes = nation_boxes(spark, d).withColumn("n", F.lit(1).cast("bigint"))
    return spatial.virtual_features(boxes, "n_regionkey", values=["n"]).select("n_regionkey", "n", F.array_join("blocks", ",").alias("blocks"))


@query("""WITH c AS (SELECT n_nationkey AS k, n_regionkey AS r, -120 + 2 * (n_nationkey % 5) AS x, 30 + 2 * (n_nationkey // 5) AS y FROM nation),
  s AS (SELECT r, x AS ax, y AS ay, x AS bx, y + 2 AS "by" FROM c UNION ALL SELECT r, x + 2, y, x + 2, y + 2 FROM c UNION ALL SELECT r, x, y, x + 2, y FROM c UNION ALL SELECT r, x, y + 2, x + 2, y + 2 FROM c)
  SELECT r AS n_regionkey, count(*)::BIGINT AS n FROM (SELECT * FROM s GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1""")
def dissolve_boundary(spark, d):
    return spatial.dissolve_boundary(nation_boxes(spark, d), "n_regionkey").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("""SELECT ax, ay, bx, "by", count(DISTINCT k) AS n_arcs FROM (SELECT n_nationkey AS k, -120 + 2 * (n_nationkey % 5) AS x, 30 + 2 * (n_nationkey // 5) AS y FROM nation) c,
  LATERAL (SELECT unnest([{'ax': x, 'ay': y, 'bx': x, 'by': y + 2}, {'ax': x + 2, 'ay': y, 'bx': x + 2, 'by': y + 2}, {'ax': x, 'ay': y, 'bx': x + 2, 'by': y}, {'ax': x, 'ay': y + 2, 'bx': x + 2, 'by': y + 2}], recursive := true)) s
  GROUP BY ALL HAVING count(DISTINCT k) > 1""")
def duplicate_segments(spark, d):
    arcs = nation_boxes(spark, d).select(F.col("n_nationkey").alias("arc_id"), G.exterior_points(F.col("g")).alias("pts"))
    s = spatial.duplicate_segments(arcs)
    return s.select(*(F.col(f"{p}.{c}").cast("int").alias(f"{p}{c}") for p in "ab" for c in "xy"), "n_arcs")


# topology over a growing grid: a unit cell for each customer, 64 in a row


def customer_cells(spark, d):
    c = table(spark, d, "customer")
    x, y = (F.col("c_custkey") % 64).cast("double"), F.floor(F.col("c_custkey") / 64).cast("double")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_nationkey", G.box_polygon(x, y + 1, x + 1, y).alias("g"))


_CELLS = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS r, c_custkey % 64 AS x, c_custkey // 64 AS y FROM customer),
  s AS (SELECT k, r, x AS ax, y AS ay, x AS bx, y + 1 AS "by" FROM c UNION ALL SELECT k, r, x + 1, y, x + 1, y + 1 FROM c UNION ALL SELECT k, r, x, y, x + 1, y FROM c UNION ALL SELECT k, r, x, y + 1, x + 1, y + 1 FROM c) """
_BESIDE = """, e AS (SELECT a.k, a.r, b.k AS o, b.r AS q FROM c a JOIN c b ON b.y = a.y AND abs(a.x - b.x) = 1 UNION ALL SELECT a.k, a.r, b.k, b.r FROM c a JOIN c b ON b.x = a.x AND abs(a.y - b.y) = 1),
  o AS (SELECT k, r FROM c WHERE (SELECT count(*) FROM e WHERE e.k = c.k) < 4) """


@query(_CELLS + _BESIDE + "SELECT 'c' || k AS id, 'c' || o AS neighbor FROM e UNION SELECT 'c' || k, 'OUT_OF_STATE' FROM o UNION SELECT 'OUT_OF_STATE', 'c' || k FROM o")
def contiguity_grid(spark, d):
    return spatial.contiguity(customer_cells(spark, d))


@query(_CELLS + _BESIDE + """, v AS (SELECT r, q::VARCHAR AS q FROM e WHERE q <> r UNION SELECT r, 'OUT_OF_STATE' FROM o)
  SELECT r AS c_nationkey, n, blocks, beside FROM (SELECT r, count(*)::BIGINT AS n, string_agg('c' || k, ',' ORDER BY 'c' || k) AS blocks FROM c GROUP BY 1) LEFT JOIN (SELECT r, string_agg(q, ',' ORDER BY q) AS beside FROM v GROUP BY 1) USING (r)""")
def virtual_features_grid(spark, d):
    cells = customer_cells(spark, d).withColumn("n", F.lit(1).cast("bigint"))
    return spatial.virtual_features(cells, "c_nationkey", values=["n"]).select("c_nationkey", "n", F.array_join("blocks", ",").alias("blocks"), F.array_join("contiguity", ",").alias("beside"))


@query(_CELLS + """SELECT r AS c_nationkey, ax, ay, bx, "by" FROM s GROUP BY ALL HAVING count(*) % 2 = 1""")
def dissolve_boundary_grid(spark, d):
    s = spatial.dissolve_boundary(customer_cells(spark, d), "c_nationkey")
    return s.select("c_nationkey", *(F.col(f"{p}.{c}").cast("int").alias(f"{p}{c}") for p in "ab" for c in "xy"))


@query(_CELLS + """SELECT ax, ay, bx, "by", count(DISTINCT k) AS n_arcs FROM s GROUP BY ALL HAVING count(DISTINCT k) > 1""")
def duplicate_segments_grid(spark, d):
    s = spatial.duplicate_segments(customer_cells(spark, d).select(F.col("c_custkey").alias("arc_id"), G.exterior_points(F.col("g")).alias("pts")))
    return s.select(*(F.col(f"{p}.{c}").cast("int").alias(f"{p}{c}") for p in "ab" for c in "xy"), "n_arcs")


@query()
def interior_sharing(spark, d):
    arcs = order_boxes(spark, d).select(F.col("id").alias("arc_id"), G.exterior_points(F.col("g")).alias("pts"))
    return spatial.interior_sharing(arcs)


@query(f"SELECT id, 4 AS hull_points, round(w * h, 6) AS hull_area, round(sqrt(w * w + h * h) / 2, 6) AS circle_r, round(w * h, 6) AS box_area, 5 AS kept_points FROM {_BOXES}")
def shape_measures(spark, d):
    m = shapes.measured(order_boxes(spark, d))
    return m.select("id", "hull_points", F.round("hull_area", 6).alias("hull_area"), F.round("circle_r", 6).alias("circle_r"), F.round("box_area", 6).alias("box_area"), "kept_points")


@query(f"""SELECT id, round(a / (z * cos(radians(y + h / 2)) * t ** 2 * (1 - t ** 2 / 8 + t ** 4 / 192)), 6) AS reock,
  round(a / (z * cos(radians(y + h / 2)) * u ** 2 * (1 - u ** 2 / 8 + u ** 4 / 192)), 6) AS polsby_popper,
  1.0::DOUBLE AS convex_hull, round(2 * sqrt(pi() * a) / l, 6) AS schwartzberg
  FROM (SELECT *, pi() * 6371000.0 ** 2 AS z, radians(sqrt(w * w + h * h) / 2) AS t, radians(l / (2 * pi() * 111139.0)) AS u FROM (
  SELECT *, abs(radians(w) * (sin(radians(y + h)) - sin(radians(y)))) * 6371000.0 ** 2 AS a,
  2 * 6371000.0 * (radians(h) + asin(cos(radians(y)) * sin(radians(w / 2))) + asin(cos(radians(y + h)) * sin(radians(w / 2)))) AS l FROM {_BOXES}))""")
def compactness(spark, d):
    c = shapes.compactness(order_boxes(spark, d))
    return c.select("id", F.round("reock", 6).alias("reock"), F.round("polsby_popper", 6).alias("polsby_popper"), F.round("convex_hull", 6).alias("convex_hull"), F.round("schwartzberg", 6).alias("schwartzberg"))


@query(f"SELECT id FROM {_BOXES} WHERE x < -105 AND x + w > -115 AND y < 39 AND y + h > 33")
def select_intersects(spark, d):
    return spatial.select_box(order_boxes(spark, d), -115.0, 39.0, -105.0, 33.0, "intersects").select("id")


@query(f"SELECT n AS a, id AS b FROM {_NATIONS}, {_BOXES} WHERE x < nx + 2 AND x + w > nx AND y < ny + 2 AND y + h > ny")
def spatial_overlap_join(spark, d):
    return clipping.overlaps(nation_boxes(spark, d), order_boxes(spark, d), "id", "id").select("a", "b")


@query(f"""SELECT n AS a, id AS b, round((least(x + w, nx + 2) - greatest(x, nx)) * (least(y + h, ny + 2) - greatest(y, ny)), 6) AS shared,
  round(w * h + 4 - (least(x + w, nx + 2) - greatest(x, nx)) * (least(y + h, ny + 2) - greatest(y, ny)), 6) AS both
  FROM {_NATIONS}, {_BOXES} WHERE x < nx + 2 AND x + w > nx AND y < ny + 2 AND y + h > ny""")
def intersection_areas(spark, d):
    met = clipping.overlaps(nation_boxes(spark, d), order_boxes(spark, d), "id", "id")
    return met.select("a", "b", F.round("shared", 6).alias("shared"), F.round(F.col("area_a") + F.col("area_b") - F.col("shared"), 6).alias("both"))


@query("""SELECT n_regionkey, i::INT AS part, (-120 + 2 * (k % 5))::DOUBLE AS lft FROM (SELECT n_regionkey, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)""")
def polygon_parts(spark, d):
    merged = spatial.merged_polygons(nation_boxes(spark, d), "n_regionkey", "n_nationkey")
    return spatial.parts(merged, "n_regionkey").select("n_regionkey", "part", G.bounds(F.col("g"))["left"].alias("lft"))


@query(f"SELECT id, round(least(w, h) / 2, 3) AS distance FROM {_BOXES}")
def label_points(spark, d):
    return shapes.labelled(order_boxes(spark, d, spread=True)).select("id", F.round("distance", 3).alias("distance"))


@query(f"SELECT id, 5 AS npoint, w * h AS flat FROM {_BOXES}")
def simplified(spark, d):
    g = F.col("g")
    return shapes.simplified(order_boxes(spark, d)).select("id", G.describe(g)["npoint"].alias("npoint"), G.area_flat(g).alias("flat"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax + l_discount * 2, 6) AS dot, round(l_quantity * 3 + l_discount * 5, 6) AS first, round(l_tax * 3 + 2 * 5, 6) AS second, round(l_quantity - l_tax, 6) AS diff FROM lineitem""")
def matrix_products(spark, d):
    c = F.col
    a, b = F.array(c("l_quantity"), c("l_discount")), F.array(c("l_tax"), F.lit(2.0))
    product = arrays.multiply(F.array(a, b), F.array(F.array(F.lit(3.0)), F.array(F.lit(5.0))))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(arrays.dot(a, b), 6).alias("dot"), F.round(F.get(F.get(product, F.lit(0)), F.lit(0)), 6).alias("first"),
        F.round(F.get(F.get(product, F.lit(1)), F.lit(0)), 6).alias("second"), F.round(F.get(arrays.subtract(a, b), F.lit(0)), 6).alias("diff"),
    )


# edits: a resource per user, a key per event type


def event_edits(spark, d):
    op = F.when(F.col("event_type") == "error", "del").otherwise("set")
    return table(spark, d, "events").select(F.col("user_id").alias("resource"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("key"), op.alias("op"), "value", F.struct("ts", "event_id").alias("clock"))


_EDITS = "(SELECT user_id AS resource, 'k' || event_id % 3 AS key, event_type = 'error' AS gone, value, (ts, event_id) AS clock, event_id FROM events)"


@query(f"SELECT resource, key, value FROM (SELECT resource, key, arg_max(value, clock) AS value, arg_max(gone, clock) AS gone FROM {_EDITS} GROUP BY ALL) WHERE NOT gone")
def edits_map(spark, d):
    return edits.map_state(event_edits(spark, d))


@query(f"""WITH e AS {_EDITS}, g AS (SELECT resource, key, max(clock) AS c FROM e WHERE gone GROUP BY ALL)
  SELECT e.resource, e.key, round(sum(value), 4) AS value FROM e LEFT JOIN g ON g.resource = e.resource AND g.key = e.key WHERE NOT gone AND (c IS NULL OR clock > c) GROUP BY ALL""")
def edits_counter(spark, d):
    e = event_edits(spark, d).withColumn("op", F.when(F.col("op") == "set", "add").otherwise("del"))
    return edits.counter_state(e).withColumn("value", F.round("value", 4))


@query(f"SELECT resource, key, CASE WHEN arg_min(gone, clock) THEN 'del' ELSE 'add' END AS op, round(sum(CASE WHEN gone THEN 0 ELSE value END), 4) AS value FROM {_EDITS} GROUP BY ALL")
def edits_counter_composed(spark, d):
    e = event_edits(spark, d).withColumn("op", F.when(F.col("op") == "set", "add").otherwise("del")).withColumn("value", F.when(F.col("op") == "add", F.col("value")))
    return edits.counter_composed(e).withColumn("value", F.round("value", 4))


@query(f"""WITH e AS {_EDITS} SELECT DISTINCT a.resource, a.key FROM e a WHERE a.event_id % 41 <> 0 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_id % 41 = 0 AND b.resource = a.resource AND b.key = a.key)""")
def edits_rebase(spark, d):
    e = event_edits(spark, d)
    mine, prior = e.filter(F.col("clock.event_id") % 41 != 0), e.filter(F.col("clock.event_id") % 41 == 0)
    return edits.map_rebase(mine, prior, False).select("resource", "key").distinct()


@query("""SELECT event_id, CASE WHEN seq <= p THEN 'duplicate' WHEN seq > p + 1 THEN 'gap' ELSE 'ok' END AS status FROM (
  SELECT event_id, seq, coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p FROM (
  SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + event_id % 13 // 12 END AS seq FROM events))""")
def edits_sequence(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1 + F.floor(F.col("event_id") % 13 / 12)
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(n).alias("seq"), F.col("event_id").alias("arrival"))
    return edits.sequence_status(rows).select("event_id", "status")


@query("""SELECT doc_id, left(text, 3) || '<cut>' || substr(text, 9) AS edited, length(text) AS n_before, length(text) - greatest(least(length(text) - 3, 5), 0) + 5 AS n_after FROM documents""")
def edits_splice(spark, d):
    """Every text: a short one keeps and loses what it has; a null one gives nulls."""
    text, n = F.col("text"), F.char_length("text")
    step = lambda op, n, data="": F.struct(F.lit(op).alias("op"), n.cast("int").alias("n"), F.lit(data).alias("data"))
    kept, gone = F.least(n, F.lit(3)), F.greatest(F.least(n - 3, F.lit(5)), F.lit(0))
    e = F.when(text.isNotNull(), F.array(step("retain", kept), step("delete", gone), step("insert", F.lit(5), "<cut>"), step("retain", n - kept - gone)))
    lengths = edits.edit_lengths(e)
    return table(spark, d, "documents").select("doc_id", edits.splice(text, e).alias("edited"), lengths["before"].alias("n_before"), lengths["after"].alias("n_after"))


@query(f"""WITH o AS (SELECT user_id AS resource, event_type AS key, arg_max(value, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id AS resource, event_type AS key, arg_max(value, event_id) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
  SELECT coalesce(o.resource, n.resource) AS resource, coalesce(o.key, n.key) AS key, CASE WHEN n.resource IS NULL THEN 'del' ELSE 'set' END AS op, n.v AS value
  FROM o FULL JOIN n ON o.resource = n.resource AND o.key = n.key WHERE n.resource IS NULL OR o.resource IS NULL OR o.v IS DISTINCT FROM n.v""")
def edits_record_diff(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("resource"), F.col("event_type").alias("key"), "value", "event_id")
    old, new = (e.filter(F.col("event_id") % 2 == k).groupBy("resource", "key").agg(F.max_by("value", "event_id").alias("value")) for k in (0, 1))
    return edits.record_diff(old, new, replace=True)


@query(f"""WITH e AS {_EDITS} SELECT a.event_id FROM e a WHERE NOT gone AND a.event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.gone AND b.event_id % 2 = 1 AND b.resource = a.resource AND b.key = a.key)""")
def edits_counter_rebase(spark, d):
    e = event_edits(spark, d)
    mine, prior = (e.filter(F.col("clock.event_id") % 2 == k) for k in (0, 1))
    return edits.counter_rebase(mine.filter("op <> 'del'"), prior, False).select("clock.event_id")


# measures of single boxes


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE w END AS width, h AS height, id % 3 = 0 AS empty FROM {_BOXES}")
def box_extents(spark, d):
    """Every third box is flattened to a line."""
    b = order_boxes(spark, d).select("id", G.bounds(F.col("g"), False).alias("b"))
    right = F.when(F.col("id") % 3 == 0, F.col("b.left")).otherwise(F.col("b.right"))
    b = b.withColumn("b", F.struct("b.left", "b.top", right.alias("right"), "b.bottom"))
    return b.select("id", G.bounds_width(F.col("b")).alias("width"), G.bounds_height(F.col("b")).alias("height"), G.bounds_empty(F.col("b")).alias("empty"))


@query(f"SELECT id, least(w, h) / 2 AS inside, -1.0::DOUBLE AS outside FROM {_BOXES}")
def edge_distances(spark, d):
    """From a box's centre to its nearest edge, and from a point one degree left of it."""
    b = order_boxes(spark, d).select("id", "g", G.bounds(F.col("g"), False).alias("b"))
    x, y = G.bounds_center(F.col("b"))
    return b.select("id", G.edge_distance(F.col("g"), x, y).alias("inside"), G.edge_distance(F.col("g"), F.col("b.left") - 1, y).alias("outside"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE -2 END * w * h AS before, -2 * w * h AS after FROM {_BOXES}")
def rewound_rings(spark, d):
    """Every other box comes with its ring reversed."""
    turned = F.when(F.col("id") % 2 == 0, F.transform("g", lambda p: F.transform(p, F.reverse))).otherwise(F.col("g"))
    boxes = order_boxes(spark, d).select("id", turned.alias("g"))
    direction = lambda g: F.round(F.get(F.get(G.windings(g), F.lit(0)), F.lit(0)), 9)
    return boxes.select("id", direction(F.col("g")).alias("before"), direction(G.rewound(F.col("g"))).alias("after"))


@query(f"SELECT id, id % 2 = 0 AS crossed FROM {_BOXES}")
def self_crossings(spark, d):
    """Every other box has its two right corners exchanged, so that two of its edges cross."""
    bow = lambda r: F.array(*(F.get(r, F.lit(k)) for k in (0, 1, 3, 2, 4)))
    turned = F.when(F.col("id") % 2 == 0, F.transform("g", lambda p: F.transform(p, bow))).otherwise(F.col("g"))
    return order_boxes(spark, d).select("id", G.self_intersects(turned).alias("crossed"))


@query(f"SELECT id, round(x / 3, 2) AS x, round((y + h) / 3 + 1, 2) AS y FROM {_BOXES}")
def moved_points(spark, d):
    moved = G.rounded(G.map_points(F.col("g"), lambda x, y: (x / 3, y / 3 + 1)), 2)
    return order_boxes(spark, d).select("id", F.get(G.points(moved), F.lit(0)).alias("q")).select("id", "q.x", "q.y")


@query(f"SELECT id, round(w * h / 2, 6) AS area FROM {_BOXES}")
def difference_areas(spark, d):
    """What a box keeps outside a copy of itself moved by half its width."""
    b = order_boxes(spark, d).select("id", "g", G.bounds(F.col("g"), False).alias("b"))
    half = G.bounds_width(F.col("b")) / 2
    pairs = b.select("id", F.col("g").alias("ga"), G.map_points(F.col("g"), lambda x, y: (x + half, y)).alias("gb"))
    return clipping.with_shared_areas(shapes.spread(pairs)).select("id", F.round(F.col("area_a") - F.col("shared"), 6).alias("area"))


# texts and maps


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS guid, (c_custkey % 10)::VARCHAR AS key FROM customer")
def guid_texts(spark, d):
    """Every fourth text is too short for a guid."""
    k = F.col("c_custkey")
    whole = F.format_string("%08d-0000-%d%03d-8000-%012d", k, k % 10, k % 1000, k)
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("g"))
    return rows.select("c_custkey", scalars.is_guid(F.col("g")).alias("guid"), scalars.guid_key(F.col("g")).alias("key"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN -p_size - 0.5::DOUBLE END AS n, format('{:,.1f}', p_size * 1234567.5::DOUBLE) AS shown FROM part""")
def parsed_numbers(spark, d):
    size = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, size).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" -"), size, F.lit(".5 "))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", "p_size", scalars.to_number(s).alias("n"))
    return rows.select("p_partkey", F.when(~F.isnan("n"), F.col("n")).alias("n"), scalars.locale_number(F.col("p_size") * 1234567.5, 1).alias("shown"))


@query("""SELECT p_partkey, '<p>' || p_name || '</p><table><tr><td>' || p_brand || '</td><td>' || p_size || '</td></tr></table>' AS html FROM part""")
def html_text(spark, d):
    lines = F.concat(F.col("p_name"), F.lit("\n|"), F.col("p_brand"), F.lit("|"), F.col("p_size").cast("string"), F.lit("|"))
    return table(spark, d, "part").select("p_partkey", scalars.text_to_html(lines).alias("html"))


@query("""SELECT c_custkey, 2 AS n, 'a' AS first, c_custkey % 5 AS second, c_custkey % 3 = c_custkey % 5 AS same, 1 AS left_over, c_custkey % 7 = 0 AS empty FROM customer""")
def map_parts(spark, d):
    k = F.col("c_custkey").cast("bigint")
    low, high = F.create_map(F.lit("a"), k, F.lit("b"), k % 3), F.create_map(F.lit("b"), k % 5)
    rows = table(spark, d, "customer").select("c_custkey", low.alias("low"), scalars.map_overlay(low, high).alias("m"))
    m, gone = F.col("m"), F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return rows.select(
        "c_custkey", scalars.count_keys(m).alias("n"), scalars.nth_key(m, 0).alias("first"), scalars.nth_value(m, 1).alias("second"), scalars.shallow_equal(F.col("low"), m).alias("same"),
        scalars.count_keys(scalars.map_without(m, F.array(F.lit("a")))).alias("left_over"), scalars.is_empty(scalars.map_without(m, gone)).alias("empty"),
    )

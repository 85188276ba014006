"""Folding, mapping and overriding records."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.operators.staging import staged


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in schema.fields:
        out += _leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [((*path, f.name), f.dataType)]
    return out


def accumulate(df: DataFrame, keys: list[str], order: str, record: str = "rec") -> DataFrame:
    """Merges the struct column ``record`` of each key: numbers add up, leaves named ``min`` and ``max`` keep
    the least and greatest, other leaves the last value by ``order``. A null leaf is a missing property and overwrites
    nothing. One shuffle, combined before it."""
    schema = df.schema[record].dataType
    aggregates: dict[tuple[str, ...], Column] = {}
    for path, kind in _leaves(schema):
        c = F.col(".".join(f"`{p}`" for p in (record, *path)))
        if path[-1] in ("min", "max") and isinstance(kind, T.NumericType):
            aggregates[path] = F.min(c) if path[-1] == "min" else F.max(c)
        elif isinstance(kind, T.NumericType):
            aggregates[path] = F.sum(c)
        else:
            aggregates[path] = F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    flat = df.groupBy(*keys).agg(*(a.alias("/".join(p)) for p, a in aggregates.items()))

    def rebuilt(s: T.StructType, path: tuple[str, ...]) -> Column:
        return F.struct(*((rebuilt(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else F.col(f"`{'/'.join((*path, f.name))}`")).alias(f.name) for f in s.fields))

    return flat.select(*keys, rebuilt(schema, ()).alias(record))


def accumulate_map(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Merges map<string, double> columns of each key: entries add up; ``min`` and ``max`` keep the extremes."""
    entries = df.select(*keys, F.explode(values).alias("k", "v")).groupBy(*keys, "k")
    entries = entries.agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    value = F.when(F.col("k") == "min", F.col("lo")).when(F.col("k") == "max", F.col("hi")).otherwise(F.col("s"))
    return entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", value.alias("v"))))).alias(values))


def reverse_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): the sorted keys that map to each value."""
    return df.groupBy(value).agg(F.sort_array(F.collect_list(key)).alias(f"{key}s"))


def layers(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Mapping tables (blockid, geoid) as one table with ``tag`` and ``entry_idx``; a tag given again replaces its table."""
    chosen = dict(tables)
    parts = [df.select(F.lit(tag).alias("tag"), F.lit(n).alias("entry_idx"), "blockid", "geoid") for n, (tag, df) in enumerate(chosen.items())]
    return reduce(DataFrame.unionByName, parts)


def map_override(layered: DataFrame) -> DataFrame:
    """(blockid, geoid) of the last layer that has a non-empty value."""
    return layered.filter("geoid is not null and geoid <> ''").groupBy("blockid").agg(F.max_by("geoid", "entry_idx").alias("geoid"))


def map_all(layered: DataFrame) -> DataFrame:
    """(blockid, geoids) of all layers in layer order."""
    pairs = layered.filter("geoid is not null and geoid <> ''").groupBy("blockid").agg(F.sort_array(F.collect_list(F.struct("entry_idx", "geoid"))).alias("v"))
    return pairs.select("blockid", F.transform("v", lambda s: s["geoid"]).alias("geoids"))


def map_main(layered: DataFrame) -> DataFrame:
    """(blockid, geoid) of the first layer."""
    return layered.filter("entry_idx = 0").select("blockid", "geoid")


def map_reverse(layered: DataFrame) -> DataFrame:
    """(geoid, blocks): the sorted blocks of the last layer that has the geoid."""
    per = layered.groupBy("geoid", "entry_idx").agg(F.sort_array(F.collect_list("blockid")).alias("blocks"))
    return per.groupBy("geoid").agg(F.max_by("blocks", "entry_idx").alias("blocks"))


def lookup_prefix(df: DataFrame, key: str, table: DataFrame, lengths: list[int]) -> DataFrame:
    """Joins (prefix, value) by the longest prefix of ``key``, one equi-join row per length; null if none fits."""
    keyed = df.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("_n")).filter(F.char_length(key) >= F.col("_n"))
    met = keyed.withColumn("_p", F.substring(F.col(key), F.lit(1), F.col("_n"))).join(table, F.col("_p") == F.col("prefix"))
    best = met.groupBy(key).agg(F.max_by("value", "_n").alias("value"))
    return df.join(best, key, "left")


def last_by_id(df: DataFrame, id_col: str, *order: str) -> DataFrame:
    """The last row of each id by ``order``: a maximum per id, combined before the shuffle."""
    best = df.groupBy(id_col).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def hide(df: DataFrame, hidden: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not hidden."""
    return df.join(hidden.select(id_col).distinct(), id_col, "left_anti")


def show(hidden: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The hidden ids without ``ids``."""
    return hidden.join(ids.select(id_col), id_col, "left_anti")


def union_visible(parts: list[tuple[str, DataFrame]], hidden: DataFrame, id_col: str = "id", order: str = "ord") -> DataFrame:
    """Tagged collections as one: hidden ids go first, then the last collection's row of each id stays."""
    rows = [df.select("*", F.lit(tag).alias("tag"), F.lit(n).alias("entry_idx")) for n, (tag, df) in enumerate(dict(parts).items())]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return last_by_id(hide(everything, hidden, id_col), id_col, "entry_idx", order)


def find(df: DataFrame, hidden: DataFrame, value: object, id_col: str = "id", entry: str = "entry_idx") -> DataFrame:
    """The visible row of an id from the first collection that has it."""
    hits = hide(df.filter(F.col(id_col) == value), hidden, id_col)
    return hits.groupBy(id_col).agg(F.min_by(F.struct(*df.columns), entry).alias("_r")).select("_r.*")


@dataclass(frozen=True)
class Collections:
    """Tagged collections (id, ord, ...) and hidden ids; each change is a new value, and nothing runs before its rows are read.

    Tags keep the order in which they first came. Later collections win over earlier ones on equal ids.
    """

    parts: dict[str, DataFrame] = field(default_factory=dict)
    hidden: DataFrame | None = None

    def add(self, tag: str, df: DataFrame | None) -> Collections:
        """A collection under a tag, in place of the one before; none removes the tag."""
        return self.remove(tag) if df is None else replace(self, parts={**self.parts, tag: df})

    def remove(self, tag: str) -> Collections:
        return replace(self, parts={t: df for t, df in self.parts.items() if t != tag})

    def add_multi(self, other: Collections) -> Collections:
        """All tags of another, and its hidden ids."""
        both = replace(self, parts={**self.parts, **other.parts})
        return both if other.hidden is None else both.hide(other.hidden)

    def add_all(self, tag: str, other: Collections) -> Collections:
        """What another shows, as one collection; nothing to show in it removes the tag."""
        return self.add(tag, other.visible().drop("tag", "entry_idx") if other.parts else None)

    def hide(self, ids: DataFrame, id_col: str = "id") -> Collections:
        ids = ids.select(F.col(id_col).alias("id"))
        return replace(self, hidden=ids if self.hidden is None else self.hidden.unionByName(ids))

    def show(self, ids: DataFrame, id_col: str = "id") -> Collections:
        return self if self.hidden is None else replace(self, hidden=show(self.hidden, ids.withColumnRenamed(id_col, "id")))

    def show_all(self) -> Collections:
        return replace(self, hidden=None)

    def hide_set_all(self, ids: DataFrame, id_col: str = "id") -> Collections:
        """Exactly these ids hidden."""
        return self.show_all().hide(ids, id_col)

    def some_hidden(self) -> bool:
        return self.hidden is not None and not self.hidden.isEmpty()

    def filter(self, condition: Column | str) -> Collections:
        """The rows that meet a condition, by tag, nothing hidden."""
        return Collections({tag: df.filter(condition) for tag, df in self.parts.items()})

    def visible(self) -> DataFrame:
        """One row an id: not hidden, from the last collection that has it."""
        first = next(iter(self.parts.values()))
        return union_visible(list(self.parts.items()), first.select("id").limit(0) if self.hidden is None else self.hidden)

    def find(self, value: object, hidden_too: bool = False) -> DataFrame:
        """The row of an id from the first collection that has it; of a hidden one only if asked for."""
        rows = [df.filter(F.col("id") == value).withColumn("entry_idx", F.lit(n)) for n, df in enumerate(self.parts.values())]
        everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        none = everything.select("id").limit(0)
        return find(everything, none if hidden_too or self.hidden is None else self.hidden, value)


def position(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Adds the 1-based position in the given order, without one task for all rows.

    The range-partitioned rows are written once with their partition's number. Row numbers, counts
    and offsets (one row a partition) are all taken from that table, as another exchange of the same
    rows would sample other range bounds.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "position")
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b._c"), F.lit(0)).alias("_o"))
    return local.join(F.broadcast(before), "_p").withColumn(name, (F.col("_k") + F.col("_o")).cast("bigint")).drop("_p", "_k", "_o")


def canonical_ids(df: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Ids from the position: '1', '2', ..."""
    return position(df, order, name="_n").withColumn(name, F.col("_n").cast("string")).drop("_n")


def valid_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: whether all ids are there and unique."""
    return df.groupBy(id_col).count().agg(F.coalesce(F.max("count") == 1, F.lit(True)).alias("unique"), F.coalesce(F.max(F.col(id_col).isNull().cast("int")) == 0, F.lit(True)).alias("complete")).select((F.col("unique") & F.col("complete")).alias("valid"))


def same_ids(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: whether both have as many rows and every id of ``a`` is in ``b``."""
    missing = a.join(b.select(id_col).distinct(), id_col, "left_anti").agg(F.count("*").alias("missing"))
    sizes = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))
    return missing.crossJoin(sizes).select(((F.col("missing") == 0) & (F.col("na") == F.col("nb"))).alias("equal"))


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): rows added, removed or changed between two versions with equal columns."""
    digest = lambda df: F.xxhash64(*(c for c in df.columns if c != key))
    joined = old.select(key, digest(old).alias("a")).join(new.select(key, digest(new).alias("b")), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return joined.select(key, change.alias("change")).filter("change is not null")


#: Fixed value: name properties in order of preference.
NAME_COLUMNS = [
    "name", "entry_name", "Name", "NAME", "NAMELSAD", "namelsad", "NAME10", "name10", "NAMELSAD10", "namelsad10",
    "NAME20", "name20", "NAMELSAD20", "namelsad20", "NAME30", "name30", "NAMELSAD30", "namelsad30",
]
#: Fixed value: words that a name does without, the first of each, in this order.
NAME_NOISE = ["Voting Districts", "Precinct", "Voting District"]


def display_name(columns: list[str]) -> Column:
    """The first name property that a row has, without noise words; a block group's is its GEOID10 without the state.

    Column names are told apart by case. Rows without a name show their id.
    """
    name = F.coalesce(*(F.col(f"`{c}`") for c in NAME_COLUMNS if c in columns), F.lit(None).cast("string"))
    short = name
    for noise in NAME_NOISE:
        short = F.regexp_replace(short, f"^((?s:.*?)){noise}", "$1")
    short = F.trim(short)
    if "GEOID10" in columns:
        short = F.when(name.startswith("Block Group") & F.col("GEOID10").isNotNull(), F.expr("substring(CAST(GEOID10 AS STRING), 3)")).otherwise(short)
    return F.when(name.isNotNull(), short).otherwise(F.col("id").cast("string") if "id" in columns else F.lit(None).cast("string"))

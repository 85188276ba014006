"""Exact Jaccard self-join of documents' word shingle sets, with set-relation skipping.

Sets are the distinct hashes of ``n``-word shingles. Documents with equal sets are
one class, its smallest id the representative; only representatives are joined.

Order. Shingles are ordered by a hash, with frequent ones moved behind all others.
Two sets that reach the threshold share a shingle among the first
``size - ceil(threshold * size) + 1`` of each. Mostly these lie in the lowest part of
the hash range, so each set first sends that part; shingles in more than ``limit``
sets are counted there, and sets that they leave short send all their shingles and
have the rest of the range counted among themselves. The order decides only the work.

Index. A list holds the sets with one shingle in their prefix, cut in blocks by set
size (one block spans one ratio of the threshold) and by the shingle's position in the
prefix (``STEPS`` steps). What two sets share through a shingle is bounded by what follows
its positions. As the smaller set of a pair, a set enters only with its early positions, and it
meets only those blocks of its own and the next size whose step lets some size in
the block reach the threshold: all others are skipped unread. Inside a block, position and
size bound the overlap of each pair before anything is fetched.

Answers. Each set is first compared with one or two of its blocks' leaders (their
smallest sets), those that share most lists with it, then with the head of the largest
family in its lists; the verified links form families around pivots. A member's answer is its
pivot's, taken over: sets of one family are connected and never compared again, which
leaves nothing to do in lists of one family. Only pairs across families remain; first
pivots are compared, and a pair is dropped if the pivots' overlap plus what each set has
beyond its pivot is below the overlap that it needs. The rest is verified.

Bounds. Before full sets are fetched, a parity bitmap of each set gives a lower
bound of the symmetric difference (one bit per shingle; at most the true difference).
Nothing is dropped on an estimate: frequent lists, large classes and long texts change
only how much is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import textkit
from llm.components import components
from llm.staging import dropped, sieved, sized, staged

#: Part of the hash range whose shingles every set sends.
LOW_PART = 0.25
#: Sets with at most so many shingles send all of them.
SMALL = 48
#: Sets that share a shingle before it counts as frequent, raised until few shingles are.
FREQUENT = 48
FREQUENT_ROWS = 200_000
#: Rounds in which sets are compared with the head of the largest family in their lists, while links are found.
JOIN_ROUNDS = 1
#: Blocks of a list by position, for each block of sizes.
STEPS = 4
#: Bits of a parity bitmap: the power of two from the set size on, within these.
BITS_LEAST, BITS_MOST = 128, 4096
#: Pairs of one set that are verified together; more are dealt out.
HUB_PAIRS = 256

_LOW = np.int64(int(-(2**63) + LOW_PART * 2**64))


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap with which sets of these sizes reach the threshold."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def _sets(texts: pa.Array, n: int, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, sorted distinct shingle hashes (signed) end to end, and their offsets, by slices of a column."""
    for lo, hi in textkit.slices(texts):
        data, off = textkit.raw(texts.slice(lo, hi - lo))
        starts, ends, first = textkit.words(data, off)
        words = textkit.word_hashes(data, starts, ends, lower)
        shingles, at = textkit.window_hashes(words, first, n)
        row = np.searchsorted(first, at, side="right") - 1
        counts = np.diff(first)
        for k in np.unique(counts[(counts > 0) & (counts < n)]).tolist():  # short texts: the whole sequence
            short = np.flatnonzero(counts == k)
            all_k, at_k = textkit.window_hashes(words, first, k)
            shingles = np.concatenate([shingles, all_k[np.searchsorted(at_k, first[short])]])
            row = np.concatenate([row, short])
        values = shingles.view(np.int64)
        order = np.lexsort((values, row))
        values, row = values[order], row[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[new], row[new]
        yield lo, values, np.searchsorted(row, np.arange(hi - lo + 1))


def _bits(n: int) -> int:
    return min(max(BITS_LEAST, 1 << max(n - 1, 1).bit_length()), BITS_MOST)


def _bitmaps(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of each set's shingles per bit, as longs end to end, and their offsets."""
    bits = np.array([_bits(n) for n in np.diff(off).tolist()], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(bits)])
    own = np.repeat(np.arange(len(bits)), np.diff(off))
    at = first[own] + (values.view(np.uint64) & (bits[own] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(first[-1])) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), first // 64


def _lists(off: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int64()))


def _classes_rows(n: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, off in _sets(batch.column(1), n, lower):
                mixed = np.zeros((2, len(values) + 1), dtype=np.uint64)
                np.cumsum(textkit.mix(values.view(np.uint64)), out=mixed[0, 1:])
                np.cumsum(textkit.mix(values.view(np.uint64) ^ np.uint64(0x5DEECE66D)), out=mixed[1, 1:])
                sums = (mixed[:, off[1:]] - mixed[:, off[:-1]]).view(np.int64)
                size = np.diff(off)
                sent = (np.repeat(size, size) <= SMALL) | (values < _LOW)
                part = np.concatenate([[0], np.cumsum(sent)])[off]
                bitmap, longs = _bitmaps(values, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(size)), pa.array(size, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), _lists(part, values[sent]), _lists(longs, bitmap)],
                    ["id", "size", "d1", "d2", "part", "bitmap"],
                )

    return run


def _set_rows(n: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, off in _sets(batch.column(1), n, lower):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(off) - 1), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))], ["id", "shingles"]
                )

    return run


def _overlap_rows(n: int, lower: bool):
    """Sizes of the intersections of two text columns' sets; rows of one hub mostly come together, and its set is made once a batch."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        return [values[x:y] for _, values, off in _sets(texts, n, lower) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first, which = np.unique(batch.column(4).to_numpy(), return_index=True, return_inverse=True)
            spokes, hubs = sets(batch.column(5)), sets(batch.column(6).take(pa.array(first)))
            met = [len(np.intersect1d(spoke, hubs[k], assume_unique=True)) for spoke, k in zip(spokes, which.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(met, pa.int64())], ["a", "b", "a_size", "b_size", "overlap"])

    return run


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles and their counts, few by raising the limit; only these come to the driver."""
    limit = FREQUENT
    while counts.filter(F.col("count") > limit).count() > FREQUENT_ROWS:
        limit *= 2
    found = counts.filter(F.col("count") > limit).toPandas()
    found = found.sort_values("x")
    return found["x"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _prefix_rows(frequent: np.ndarray, counts: np.ndarray, percent: int):
    """Prefixes in the order: not frequent by hash, then frequent by count. A null prefix: the part sent is too short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, parts = batch.column(1).to_numpy(), batch.column(2)
            out = []
            for n, lo, hi in zip(sizes.tolist(), parts.offsets.to_numpy()[:-1].tolist(), parts.offsets.to_numpy()[1:].tolist()):
                v = parts.values.to_numpy()[lo:hi]
                want = int(n - -(-percent * n // 100) + 1)
                at = np.searchsorted(frequent, v)
                at[at == len(frequent)] = 0
                hot = frequent[at] == v if len(frequent) else np.zeros(len(v), dtype=bool)
                cool = v[~hot]
                if len(cool) >= want:
                    out.append(cool[:want])
                elif len(v) == n:
                    warm = v[hot][np.lexsort((v[hot], counts[at[hot]]))]
                    out.append(np.concatenate([cool, warm])[:want])
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "size", "prefix"])

    return run


def _fold(bitmap: Column, longs: Column) -> Column:
    """A parity bitmap over fewer bits: bits that fall together are combined."""
    size = F.size(bitmap)
    return F.transform(
        F.sequence(F.lit(0), longs - 1),
        lambda i: F.aggregate(F.sequence(F.lit(0), (size / longs).cast("int") - 1), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get(bitmap, i + k * longs))),
    )


def _may_link(percent: int) -> Column:
    """Whether the parity bitmaps ``a_bitmap`` and ``b_bitmap`` allow the needed overlap."""
    longs = F.least(F.size("a_bitmap"), F.size("b_bitmap"))
    differ = F.aggregate(
        F.zip_with(_fold(F.col("a_bitmap"), longs), _fold(F.col("b_bitmap"), longs), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0).cast("int"),
        lambda acc, x: acc + x,
    )
    return differ <= F.col("a_size") + F.col("b_size") - 2 * _needed(F.col("a_size"), F.col("b_size"), percent)


def _sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (with ``id``) with the column ``maybe``, false only for rows with none of ``ids``."""
    return sieved(rows, F.xxhash64("id"), ids.select(F.xxhash64("id")))


def _texts_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``base`` with one of ``ids``, a staged table, and its columns; most other texts are not shuffled."""
    return _sieved(base, ids).filter("maybe").drop("maybe").join(sized(ids), "id")


def _overlaps(pairs: DataFrame, reps: DataFrame, base: DataFrame, n: int, lower: bool, percent: int, bitmaps: bool = True) -> DataFrame:
    """Exact overlaps of pairs (a, b) of representatives, with sizes; with ``bitmaps`` only of pairs they allow."""
    for side in ("a", "b"):
        info = reps.select(F.col("id").alias(side), F.col("size").alias(f"{side}_size"), F.col("bitmap").alias(f"{side}_bitmap"))
        pairs = pairs.join(info, side)
    if bitmaps:
        pairs = pairs.filter(_may_link(percent))
    pairs = first = staged(pairs.drop("a_bitmap", "b_bitmap"), "pairs")
    if pairs.isEmpty():
        return pairs.withColumn("overlap", F.lit(0).cast("long"))
    # each pair's text of fewer pairs (the spoke) goes to that of more (the hub), so that a hub's is not sent with each of its pairs
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    ends = staged(ends, "ends")
    for side in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n")), side)
    swap = F.col("a_n") > F.col("b_n")
    spoke, hub = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    parts = F.ceil(F.greatest("a_n", "b_n") / F.lit(HUB_PAIRS)).cast("int")
    pairs = pairs.select("a", "b", "a_size", "b_size", spoke.alias("spoke"), hub.alias("hub"), parts.alias("parts"))
    pairs = staged(pairs.withColumn("deal", F.pmod(F.xxhash64("spoke"), F.col("parts")).cast("int")), "sides")
    ids = pairs.select(F.col("spoke").alias("id"), F.lit(True).alias("as_spoke"), F.lit(0).alias("parts")).unionByName(pairs.select(F.col("hub").alias("id"), F.lit(False).alias("as_spoke"), "parts"))
    ids = staged(ids.groupBy("id").agg(F.max("as_spoke").alias("as_spoke"), F.max("parts").alias("parts")), "ids")
    texts = staged(_texts_of(base, ids), "texts")
    joined = pairs.join(texts.filter("as_spoke").select(F.col("id").alias("spoke"), F.col("text").alias("spoke_text")), "spoke")
    hubs = texts.filter("parts > 0").select(F.col("id").alias("hub"), F.col("text").alias("hub_text"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal"))
    joined = joined.join(hubs, ["hub", "deal"])
    kind = base.schema["id"].dataType.simpleString()
    out = joined.select("a", "b", "a_size", "b_size", "hub", "spoke_text", "hub_text").mapInArrow(
        textkit.tidy(_overlap_rows(n, lower)), f"a {kind}, b {kind}, a_size bigint, b_size bigint, overlap bigint"
    )
    out = staged(out, "overlaps")
    dropped(first, ends, pairs, ids, texts)
    return out


def _mixed(index: DataFrame, families: DataFrame) -> DataFrame:
    """The index with each set's family, without lists of one family."""
    member = index.join(families.withColumnRenamed("component", "family"), "id", "left").withColumn("family", F.coalesce("family", "id"))
    mixed = member.groupBy("x").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).filter("lo <> hi").select("x")
    return member.join(mixed, "x", "left_semi")


def similarity_classes(
    docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` and ``n_copies``.

    Documents link when 100 * overlap >= percent * union of their shingle sets;
    ``component_id`` is the smallest id that links reach, ``n_copies`` the number of
    documents with the same set. A text with fewer than ``n`` words is one shingle; a text
    without words (null, blank) has none, links with nothing and is its own component.
    Ids are unique integers; a repeated row is answered once per row; rows with a null id
    have a null component; an empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = base.mapInArrow(textkit.tidy(_classes_rows(n, lower)), f"id {kind}, size bigint, d1 bigint, d2 bigint, part array<bigint>, bitmap array<bigint>")
    rows = staged(rows, "sets")
    classes = staged(rows.filter("size > 0").groupBy("size", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies")), "classes")
    own = classes.filter("rep is not null").select(F.col("rep").alias("id"))
    # most rows are the only one of their id and set, and need no shuffle; the others have their sets shuffled
    full = rows.filter("id is not null and size > 0")
    others = full.groupBy("id").agg(F.count("*").alias("n")).join(own.withColumn("own", F.lit(True)), "id", "left").filter("n > 1 or own is null")
    others = staged(others.select("id"), "others")
    told = _sieved(full, others)
    columns = ["id", "size", "part", "bitmap"]
    picked = staged(told.filter("maybe").join(own, "id", "left_semi").dropDuplicates(["id"]).select(columns), "representatives")
    reps = told.filter("not maybe").select(columns).unionByName(picked)
    bitmaps = staged(reps.select("id", "size", "bitmap"), "bitmaps")
    digests = staged(rows.select("id", "size", "d1", "d2"), "digests")

    # frequent shingles, and prefixes
    low = staged(reps.select(F.explode("part").alias("x")).groupBy("x").agg(F.count("*").alias("count")).filter("count > 1"), "counts")
    frequent, many = _frequent(low)
    schema = f"id {kind}, size bigint, prefix array<bigint>"
    first = staged(reps.select("id", "size", "part").mapInArrow(textkit.tidy(_prefix_rows(frequent, many, percent)), schema), "prefixes")
    short = staged(first.filter("prefix is null").select("id"), "short")
    whole = _texts_of(base, short).dropDuplicates(["id"]).mapInArrow(textkit.tidy(_set_rows(n, lower)), f"id {kind}, shingles array<bigint>")
    whole = whole.select("id", F.size("shingles").cast("bigint").alias("size"), F.col("shingles").alias("part"))
    whole = staged(whole.unionByName(reps.filter(F.col("size") <= SMALL).select("id", "size", "part")), "whole")
    dropped(rows, others, picked, short)
    high = whole.select(F.explode("part").alias("x")).filter(F.col("x") >= int(_LOW)).groupBy("x").agg(F.count("*").alias("count")).filter("count > 1")
    high = staged(high, "counts")
    frequent_high, many_high = _frequent(high)
    lowest = frequent < _LOW
    frequent, many = np.concatenate([frequent[lowest], frequent_high]), np.concatenate([many[lowest], many_high])
    second = whole.mapInArrow(textkit.tidy(_prefix_rows(frequent, many, percent)), schema)
    prefixes = first.filter(F.col("prefix").isNotNull() & (F.col("size") > SMALL)).unionByName(second)

    # the index: postings of shingles that two sets sent, cut in blocks by size
    posting = prefixes.select("id", "size", F.posexplode("prefix").alias("pos", "x"))
    block = F.floor(F.log(F.col("size").cast("double")) / -math.log(percent / 100) + 1e-9)
    shared = low.filter(F.col("x") < int(_LOW)).unionByName(high).select("x")
    index = staged(posting.join(shared, "x", "left_semi").withColumn("block", block), "index")
    dropped(first, whole, low, high)
    rows, reps = digests, bitmaps

    # families around the leaders of blocks
    leader = index.groupBy("x", "block").agg(F.min(F.struct("size", "id")).alias("lead"))
    leaders = leader.unionByName(leader.withColumn("block", F.col("block") + 1)).select("x", "block", F.col("lead.id").alias("a"), F.col("lead.size").alias("s"))
    star = index.join(leaders, ["x", "block"]).filter((F.col("id") != F.col("a")) & (100 * F.least("s", "size") >= percent * F.greatest("s", "size")))
    # of the leaders that a set meets, the one of its own block and the one of the block below with most lists in common
    star = star.withColumn("below", F.col("s") < F.col("size")).groupBy("id", "below", "a").agg(F.count("*").alias("lists"))
    star = star.groupBy("id", "below").agg(F.max_by("a", F.struct("lists", -F.col("a"))).alias("a"))
    star = staged(star.select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct(), "star")
    enough = 100 * F.col("overlap") >= percent * (F.col("a_size") + F.col("b_size") - F.col("overlap"))
    found = _overlaps(star, reps, base, n, lower, percent).filter(enough)
    families = staged(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "families")

    # lists of one family need nothing more; in others, sets outside the list's largest family are compared with its head
    member = staged(_mixed(index, families), "members")
    dropped(index)
    for _ in range(JOIN_ROUNDS):
        sizes = member.groupBy("x", "family").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("x").agg(F.max_by("family", F.struct("n", -F.col("family"))).alias("head"))
        joining = member.join(largest, "x").filter("family <> head").groupBy("id", "head").agg(F.count("*").alias("lists"))
        joining = joining.groupBy("id").agg(F.max_by("head", F.struct("lists", -F.col("head"))).alias("head"))
        joining = joining.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).join(star, ["a", "b"], "left_anti")
        joining = staged(joining.distinct(), "joining")
        if joining.isEmpty():
            break
        new = _overlaps(joining, reps, base, n, lower, percent).filter(enough)
        star, found = star.unionByName(joining), found.unionByName(new)
        if new.isEmpty():
            break
        families = staged(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "families")
        narrower = staged(_mixed(member.drop("family"), families), "members")
        dropped(member)
        member = narrower

    # pairs across families
    t = percent / 100
    step = F.least(F.floor(F.col("pos") * F.lit(STEPS / (1 - t)) / F.col("size")), F.lit(STEPS - 1)) if percent < 100 else F.lit(0)
    member = member.withColumn("step", step.cast("int"))
    # the greatest size in a block that can be as similar, and the steps that it may reach
    most = lambda o: F.least(F.pow(F.lit(1 / t), F.col("block") + o + 1), F.col("size") / F.lit(t))
    reached = [(o, k, F.lit(k * (1 - t) * (1 + t) / STEPS - 1e-9) <= 1 - F.lit(t) * F.col("size") / most(o)) for o in (0, 1) for k in range(STEPS)]
    near = F.filter(F.array(*(F.when(fits, F.struct((F.col("block") + o).alias("near"), F.lit(k).alias("step"))) for o, k, fits in reached)), lambda b: b.isNotNull())
    left = member.filter(F.col("pos") <= F.col("size") - _needed(F.col("size"), F.col("size"), percent))
    left = left.select("x", F.col("id").alias("a"), F.col("size").alias("sa"), F.col("pos").alias("pa"), F.col("family").alias("fa"), F.inline(near))
    right = member.select("x", F.col("id").alias("b"), F.col("size").alias("sb"), F.col("pos").alias("pb"), F.col("family").alias("fb"), F.col("block").alias("near"), "step")
    bound = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= _needed(F.col("sa"), F.col("sb"), percent)
    ahead = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    fits = (F.col("fa") != F.col("fb")) & ahead & (100 * F.col("sa") >= percent * F.col("sb")) & bound
    cross = left.join(right, ["x", "near", "step"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cross = cross.join(star, ["a", "b"], "left_anti")
    # a set's overlap with its pivot, and so what it has beyond it
    pivots = found.select(F.col("b").alias("id"), F.col("a").alias("pivot"), (F.col("b_size") - F.col("overlap")).alias("beyond"))
    pivots = staged(pivots.groupBy("id").agg(F.min_by(F.struct("pivot", "beyond"), "pivot").alias("p")).select("id", "p.pivot", "p.beyond"), "pivots")
    for side in ("a", "b"):
        of = pivots.select(F.col("id").alias(side), F.col("pivot").alias(f"{side}_pivot"), F.col("beyond").alias(f"{side}_beyond"))
        cross = cross.join(of, side, "left").withColumn(f"{side}_pivot", F.coalesce(f"{side}_pivot", side)).withColumn(f"{side}_beyond", F.coalesce(f"{side}_beyond", F.lit(0)))
    cross = cross.withColumn("u", F.least("a_pivot", "b_pivot")).withColumn("v", F.greatest("a_pivot", "b_pivot"))
    # bitmaps bound what is left
    for side in ("a", "b"):
        cross = cross.join(reps.select(F.col("id").alias(side), F.col("size").alias(f"{side}_size"), F.col("bitmap").alias(f"{side}_bitmap")), side)
    cross = staged(cross.filter(_may_link(percent)).drop("a_bitmap", "b_bitmap"), "cross")
    heads = cross.filter("(a <> a_pivot or b <> b_pivot) and u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    heads = _overlaps(heads, reps, base, n, lower, percent, bitmaps=False).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("overlap").alias("met"))
    left_over = cross.join(heads, ["u", "v"], "left").filter(
        F.col("met").isNull() | (F.col("met") + F.col("a_beyond") + F.col("b_beyond") >= _needed(F.col("a_size"), F.col("b_size"), percent))
    )
    more = _overlaps(left_over.select("a", "b"), reps, base, n, lower, percent).filter(enough)
    links = found.select("a", "b").unionByName(more.select("a", "b"))
    groups = staged(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")
    dropped(member, bitmaps)

    named = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("size", "d1", "d2", F.coalesce("component", "rep").alias("component_id"), "n_copies")
    out = rows.select("id", "size", "d1", "d2").join(named, ["size", "d1", "d2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )

"""Product codes of vectors: a codebook for each of equal parts, learned in rounds with adaptive distance bounds.

Components become integers (floor of ``SCALE`` times the component), so that sums, distances and codebooks are exact. A
round assigns each part to the nearest entry of its codebook (ties to the lower index) and replaces an entry by the
floored mean of its parts.

The first assignment takes all distances and keeps for each part its ``b`` closest other entries with lower bounds of
their distances, in order, and one bound for all others. When entries have moved, each bound falls by its entry's move (the outer one by
the greatest) and the distance to the part's own entry is taken anew. The bounds below which that distance lies are
certain; the listed entries before them are verified with integers, and only where even the outer bound is not
certain are all distances taken again. Each batch adapts ``b`` to the depth that its parts needed. Bounds are kept as half-precision
numbers rounded down, in one binary value a row; floating point decides only what its margin makes certain.

Each round is one map over the rows and one sum for each part, entry and place; only codebooks come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import textkit
from llm.staging import by_bytes, dropped, sized, staged

SCALE = 256
#: Integer components must be smaller than this, so that distances fit 64 bits.
LIMIT = 1 << 27
#: Relative margin of bounds, far above what square roots and differences of doubles lose.
MARGIN = 1e-9
#: Rows handled in one numpy pass.
ROWS = 1_024


@dataclass
class Lists:
    """Bounds of a batch's parts: own entry (n, parts), listed entries and their lower bounds (n, parts, b), the outer bound (n, parts)."""

    own: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    def packed(self) -> np.ndarray:
        """(n, bytes): the number of listed entries, then all fields."""
        n, _, b = self.near.shape
        fields = (np.full((n, 1), b, np.uint8), self.own, self.near, _floor16(self.lower), _floor16(self.outer))
        return np.concatenate([np.ascontiguousarray(f).reshape(n, -1).view(np.uint8) for f in fields], axis=1)

    @staticmethod
    def unpacked(rows: np.ndarray, parts: int) -> Lists:
        n, b = len(rows), int(rows[0, 0])
        cuts = np.cumsum([1, parts, parts * b, 2 * parts * b])
        _, own, near, lower, outer = np.split(rows, cuts, axis=1)
        half = lambda x: np.ascontiguousarray(x).view(np.float16).astype(np.float64)
        return Lists(own, near.reshape(n, parts, b), half(lower).reshape(n, parts, b), half(outer))


def _floor16(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers not above ``x``."""
    x = np.clip(x, 0, 60_000)
    h = x.astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(-1)), h).astype(np.float16)


def _roots(squares: np.ndarray, margin: float) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + margin)


def _all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, d) to all entries (k, d), exact: through doubles where all terms are whole numbers there."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in book], axis=1)


def _listed(dist: np.ndarray, ids: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances in order of distance, then index, for candidates that come in order of index; ``b`` + 2 at most."""
    order = np.argsort(dist, axis=1, kind="stable")[:, : b + 2]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def first_lists(vectors: np.ndarray, books: np.ndarray, b: int) -> tuple[Lists, np.ndarray]:
    """Assignment by all distances, and the own distances (n, parts)."""
    parts, k, d = books.shape
    n, b = len(vectors), min(b, k - 1)
    own, dist = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
    near, lower, outer = np.zeros((n, parts, b), np.uint8), np.zeros((n, parts, b)), np.zeros((n, parts))
    for j in range(parts):
        ids, far = _listed(_all(vectors[:, j * d : (j + 1) * d], books[j]), np.broadcast_to(np.arange(k), (n, k)), b)
        own[:, j], dist[:, j] = ids[:, 0], far[:, 0]
        near[:, j], lower[:, j] = ids[:, 1 : b + 1], _roots(far[:, 1 : b + 1], -MARGIN)
        outer[:, j] = _roots(far[:, b + 1], -MARGIN) if k > b + 1 else 60_000
    return Lists(own, near, lower, outer), dist


def moved_lists(vectors: np.ndarray, books: np.ndarray, moves: np.ndarray, was: Lists) -> tuple[Lists, np.ndarray, np.ndarray]:
    """Assignment after entries moved by ``moves`` (parts, k) at most: new lists, own distances, and the depth (n, parts)
    to which each part's list had to be verified (b + 1: all distances)."""
    parts, k, d = books.shape
    n, b = len(vectors), was.near.shape[2]
    own, near, depths, dist = was.own.copy(), was.near.copy(), np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    lower, outer = was.lower.copy(), was.outer.copy()
    for j in range(parts):
        x, book = vectors[:, j * d : (j + 1) * d], books[j]
        mine = ((x - book[own[:, j]]) ** 2).sum(axis=1)
        reach = _roots(mine, MARGIN)
        lower[:, j] -= moves[j][near[:, j]]
        outer[:, j] -= moves[j].max()
        bounds = np.concatenate([lower[:, j], outer[:, j : j + 1]], axis=1)
        after = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]  # of all entries from a place of the list on
        depth = (reach[:, None] >= after).sum(axis=1)
        depths[:, j], dist[:, j] = depth, mine
        some = np.flatnonzero((depth > 0) & (depth <= b))
        if len(some):
            ids = np.sort(np.concatenate([own[some, j, None], near[some, j]], axis=1).astype(np.int64), axis=1)
            ids, far = _listed(((x[some, None] - book[ids]) ** 2).sum(axis=2), ids, b)
            own[some, j], dist[some, j] = ids[:, 0], far[:, 0]
            near[some, j], lower[some, j] = ids[:, 1 : b + 1], _roots(far[:, 1 : b + 1], -MARGIN)
        whole = np.flatnonzero(depth > b)
        if len(whole):
            found, far = first_lists(x[whole], books[j : j + 1], b)
            own[whole, j], dist[whole, j] = found.own[:, 0], far[:, 0]
            near[whole, j], lower[whole, j], outer[whole, j] = found.near[:, 0], found.lower[:, 0], found.outer[:, 0]
    return Lists(own, near, lower, outer), dist, depths


def adapted(lists: Lists, depths: np.ndarray, k: int) -> Lists:
    """Lists as long as 95 of 100 uncertain parts needed, or twice as long if more than 5 of 100 went beyond them.

    A longer list repeats the own entry with the outer bound until distances are taken again; a shorter one lowers the outer bound.
    """
    n, parts, b = lists.near.shape
    unsure = np.sort(depths[depths > 0])
    if not len(unsure):
        to = max(1, b // 2)
    elif (depths > b).sum() > 0.05 * depths.size:
        to = 2 * b
    else:
        to = max(1, min(int(unsure[int(0.95 * (len(unsure) - 1))]), b))
    to = min(to, k - 1)
    if to < b:
        outer = np.minimum(lists.outer, lists.lower[:, :, to:].min(axis=2))
        return Lists(lists.own, lists.near[:, :, :to], lists.lower[:, :, :to], outer)
    if to > b:
        near = np.concatenate([lists.near, np.repeat(lists.own[:, :, None], to - b, axis=2)], axis=2)
        return Lists(lists.own, near, np.concatenate([lists.lower, np.repeat(lists.outer[:, :, None], to - b, axis=2)], axis=2), lists.outer)
    return lists


def _binary(rows: list[np.ndarray]) -> pa.Array:
    """Byte rows of one batch (each (n, width)) as a binary column."""
    sizes = np.concatenate([np.full(len(r), r.shape[1]) for r in rows])
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.concatenate([r.reshape(-1) for r in rows]))])


def _same_length(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges of a binary column with values of one length, as byte rows."""
    data, off = textkit.raw(col)
    size = np.diff(off)
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(col)] if len(col) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield lo, hi, data[off[lo] : off[hi]].reshape(hi - lo, -1)


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """Integer components (n, components) of a batch's vectors."""
    x = np.floor(SCALE * batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"components must be smaller than {LIMIT // SCALE}")
    return x.astype(np.int64)


def _moved(batch: pa.RecordBatch, books: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, int, Lists, np.ndarray, np.ndarray]]:
    """Row ranges of a batch of (id, label, v, lists) with their new lists, own distances and depths."""
    for lo, hi, rows in _same_length(batch.column(3)):
        for at in range(lo, hi, ROWS):
            end = min(hi, at + ROWS)
            vectors = textkit.raw(batch.column(2).slice(at, end - at))[0].view("<i4").reshape(end - at, -1).astype(np.int64)
            yield at, end, *moved_lists(vectors, books, moves, Lists.unpacked(rows[at - lo : end - lo], len(books)))


class Codes:
    """Learning and coding over one table."""

    def __init__(self, rows: DataFrame, id_col: str, vector: str, label: str, parts: int, entries: int, b: int):
        self.parts, self.b = parts, b
        v = F.col("v")
        finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        kept = rows.select(rows[id_col].alias("id"), rows[label].alias("label"), rows[vector].cast("array<double>").alias("v")).filter(v.isNotNull() & finite)
        heads = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
        self.width = len(heads[0].v) if heads else parts
        if self.width % parts or not self.width:
            raise ValueError(f"vectors of {self.width} components can't be cut into {parts} equal parts")
        heads = [h for h in heads if len(h.v) == self.width]
        self.kept = kept.filter(F.size("v") == self.width)
        whole = np.array([[math.floor(SCALE * x) for x in h.v] for h in heads], dtype=np.int64).reshape(len(heads), parts, self.width // parts)
        self.books = np.ascontiguousarray(whole.transpose(1, 0, 2))  # (parts, entries, components of a part)
        self.moves = np.zeros(self.books.shape[:2])
        self.schema = f"id {kept.schema['id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}"

    def start(self) -> DataFrame:
        """(id, label, v, lists) of all rows, assigned by all distances."""
        books, b = self.books, self.b

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, len(whole), ROWS):
                    batch = whole.slice(lo, ROWS)
                    vectors = _whole(batch)
                    lists, _ = first_lists(vectors, books, b)
                    made = [_binary([vectors.astype("<i4").view(np.uint8)]), _binary([lists.packed()])]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "label", "v", "lists"])

        return self.kept.mapInArrow(textkit.tidy(run), f"{self.schema}, v binary, lists binary")

    def again(self, table: DataFrame) -> DataFrame:
        """(id, label, v, lists) after the entries moved."""
        books, moves = self.books, self.moves

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [adapted(lists, depths, books.shape[1]).packed() for _, _, lists, _, depths in _moved(batch, books, moves)]
                if made:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _binary(made)], ["id", "label", "v", "lists"])

        return table.mapInArrow(textkit.tidy(run), f"{self.schema}, v binary, lists binary")

    def move(self, table: DataFrame) -> None:
        """Replaces each entry by the floored mean of its parts: sums per task, then per part, entry and place."""
        parts, k, d = self.books.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                vectors = textkit.raw(batch.column(0))[0].view("<i4").reshape(len(batch), parts, d)
                data, off = textkit.raw(batch.column(1))
                own = data[off[:-1, None] + 1 + np.arange(parts)]
                for j in range(parts):
                    np.add.at(total[j], own[:, j], vectors[:, j])
                    n[j] += np.bincount(own[:, j], minlength=k)
            used = np.flatnonzero(np.repeat(n.reshape(-1), d))
            columns = (pa.array(used, pa.int32()), pa.array(total.reshape(-1)[used], pa.int64()), pa.array(np.repeat(n.reshape(-1), d)[used], pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), ["place", "total", "n"])

        sums = table.select("v", "lists").mapInArrow(textkit.tidy(run), "place int, total bigint, n bigint")
        new = self.books.reshape(-1).copy()
        for r in sums.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r.place] = r.total // r.n
        new = new.reshape(self.books.shape)
        self.moves = _roots(((new - self.books) ** 2).sum(axis=2), MARGIN) + MARGIN
        self.books = new

    def finish(self, table: DataFrame) -> DataFrame:
        """(id, label, code, error) by the last codebooks."""
        books, moves = self.books, self.moves

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, end, lists, dist, _ in _moved(batch, books, moves):
                    code = pa.array([row.tobytes().hex() for row in lists.own], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), code, pa.array(dist.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])

        return table.mapInArrow(textkit.tidy(run), f"{self.schema}, code string, error bigint")

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, b: int = 8
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error, codebooks_sha256) of every row that has a whole vector, and the codebooks (parts, entries, components).

    Rows are left out if their vector is null, holds null or a component that isn't finite, or has another length than
    that of the smallest id. The codebooks start with the smallest ids (nulls last, equal ids by vector); with fewer rows than ``entries`` (256 at most)
    there are as many entries as rows. Repeated rows count each time. ``label_error`` sums a label's errors, nulls together. An empty table gives
    no rows. A length that ``parts`` doesn't divide, and components of 2**19 or more, are errors. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256, as an index is one byte")
    by_bytes(rows.sparkSession)
    codes = Codes(rows, id_col, vector, label, parts, entries, b)
    if not codes.books.shape[1]:
        out = codes.kept.limit(0).select("id", "label", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
        return out.withColumnsRenamed({"id": id_col, "label": label}), codes.books
    now = staged(codes.start(), "codes")
    for r in range(rounds):
        codes.move(now)
        if r + 1 < rounds:
            new = staged(codes.again(now), "codes")
            dropped(now)
            now = new
    coded = staged(codes.finish(now), "coded")
    dropped(now)
    sums = sized(staged(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")), "labels"))
    # a label may hold a third of all rows: beyond a broadcast, its rows go to many tasks
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = coded.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts)))
    spread = sums.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    out = both.join(spread, F.col("label").eqNullSafe(F.col("_l")) & (both["_s"] == spread["_s"]))
    out = out.select("id", "label", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
    return out.withColumnsRenamed({"id": id_col, "label": label}), codes.books

"""Benchmark passages inside documents, found by the q-gram lemma and banded alignment.

Texts are compared as UTF-8 bytes with A-Z in lower case and runs of white space as one
blank. An item of ``m`` bytes occurs in a document if some stretch of the document
is at most ``e = floor(EDIT_SHARE * m)`` edits away from it.

Lemma: an occurrence with ``e`` edits shares at least ``T = m + 1 - q * (e + 1)`` of its
q-grams with the item, at positions whose diagonals (document minus item position)
differ by at most ``e``. Diagonals are cut in bands of ``2 * e + 1`` that overlap by half, so one
band holds all of them. Shared q-grams are counted per item and band; bands with
``T`` or more are kept, and only those are aligned, inside the band. An item's ``q`` is ``Q``, or
less where ``T`` would fall below 1 (``m // (e + 1)``), so short items keep their whole budget.

A replaced word is one run of edits and costs few grams: at most its length and ``q`` - 1 more. So an occurrence in which
``WORDS`` words are replaced, by words of about their lengths, shares at least ``m - q + 1`` less those of the item's longest words, though its
edits go beyond the share. Bands, and the budget of the alignment, are wide enough for these too (the longest words' bytes and one for each), and
``T`` is the lesser of both bounds.

Bands of one document and item that touch are aligned as one. A literal copy of the item in
the band needs no alignment; the others of a slice of documents are aligned together, a
row of one array each, and a row ends when all its cells are over the budget.

The benchmark's grams are sent to all tasks in parts of at most ``PART_BYTES`` of items,
each part a map over the documents without a shuffle, however many parts it takes.

Null and blank documents and items match nothing. Repeated documents give repeated
matches; items with equal texts all match. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import textkit
from llm.staging import staged

Q = 10
EDIT_SHARE = 0.08
#: Words that may be replaced, and the greatest share of an item that these may be.
WORDS, WORD_SHARE = 2, 0.25
#: Bytes of items whose grams are held by a task at once.
PART_BYTES = 8 << 20
#: Bits of the first, approximate look-up of a gram.
SIEVE_BITS = 23
#: Shared grams counted at a time, cells of the arrays in which bands are aligned together, and bytes of a slice of documents.
HITS = 1 << 21
CELLS = 1 << 16
SLICE_BYTES = 1 << 19

_U = np.uint64
_CODE = np.arange(256, dtype=np.uint8)
_CODE[ord("A") : ord("Z") + 1] += 32
_CODE[[9, 10, 11, 12, 13]] = 32


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of texts, their offsets, and the original position of each byte."""
    b = _CODE[data]
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    at = np.flatnonzero(keep)
    return b[at], np.searchsorted(at, off), at


def plain(text: str | None) -> bytes:
    """One text, normalised and without outer blanks."""
    return b" ".join((text or "").encode().lower().split())


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q bytes (of up to 8 exactly)."""
    if len(b) < q:
        return np.zeros(0, dtype=np.uint64)
    x = b.astype(np.uint64)
    n = len(b) - q + 1
    # runs of 1, 2, 4 and 8 bytes as numbers; a gram is cut into such runs
    runs = {1: x}
    for k in (1, 2, 4):
        if 2 * k <= q:
            runs[2 * k] = runs[k][:-k] | runs[k][k:] << _U(8 * k)
    out, at = np.zeros(n, dtype=np.uint64), 0
    for k in (8, 4, 2, 1):
        while q - at >= k:
            out = (out ^ runs[k][at : at + n]) * _U(0xBF58476D1CE4E5B9)
            out ^= out >> _U(29)
            at += k
    return out


def _budget(text: bytes, q: int, share: float, words: int) -> tuple[int, int, int]:
    """Edits, gram length and least number of shared grams of an item."""
    m = len(text)
    e = int(share * m)
    q = min(q, m // (e + 1))
    least = m + 1 - q * (e + 1)
    longest = sum(sorted(map(len, text.split()))[-words:]) + words if words else 0
    left = m - q + 1 - longest - words * (q - 1)
    if longest > e and longest <= WORD_SHARE * m and left >= 1:
        return longest, q, min(least, left)
    return e, q, least


class Index:
    """The grams of one length of some items, with their positions."""

    def __init__(self, q: int, numbers: list[int], texts: list[bytes]):
        self.q = q
        found = [grams(np.frombuffer(texts[n], np.uint8), q) for n in numbers]
        code = np.concatenate(found)
        order = np.argsort(code, kind="stable")
        self.item = np.repeat(np.array(numbers), [len(g) for g in found])[order]
        self.pos = np.concatenate([np.arange(len(g)) for g in found])[order]
        self.code, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[self.code >> _U(64 - SIEVE_BITS)] = True

    def hits(self, b: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, item and diagonal of each shared gram, at most about ``HITS`` at a time."""
        g = grams(b, self.q)
        at = np.flatnonzero(self.sieve[g >> _U(64 - SIEVE_BITS)])
        which = np.searchsorted(self.code, g[at])
        which[which == len(self.code)] = 0
        good = self.code[which] == g[at]
        at, which = at[good], which[good]
        text = np.searchsorted(off, at, side="right") - 1
        good = at + self.q <= off[text + 1]
        at, which, text = at[good], which[good], text[good]
        n = self.first[which + 1] - self.first[which]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, side="right")))
            m, w = n[lo:hi], which[lo:hi]
            flat = np.repeat(self.first[w] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.repeat(text[lo:hi], m), self.item[flat], np.repeat(at[lo:hi], m) - self.pos[flat]
            lo = hi


class Items:
    """Benchmark items with the positions of their grams."""

    def __init__(self, ids: list, texts: list[bytes], q: int = Q, share: float = EDIT_SHARE, words: int = 0):
        keep = [n for n, t in enumerate(texts) if t]
        self.ids, self.texts = [ids[n] for n in keep], [texts[n] for n in keep]
        budgets = [_budget(t, q, share, words) for t in self.texts]
        self.edits = np.array([e for e, _, _ in budgets], dtype=np.int64)
        self.least = np.array([t for _, _, t in budgets], dtype=np.int64)
        of: dict[int, list[int]] = {}
        for n, (_, k, _) in enumerate(budgets):
            of.setdefault(k, []).append(n)
        self.indexes = [Index(k, numbers, self.texts) for k, numbers in of.items()]

    def find(self, b: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, edits) of the best occurrence of each item in each text of a batch."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        rest = []
        raw = b.tobytes()
        for index in self.indexes:
            for text, item, low, high in self._bands(index.hits(b, off)):
                e, t = int(self.edits[item]), self.texts[item]
                start, stop = int(off[text]), int(off[text + 1])
                at = raw.find(t, max(low - e, start), min(high + e + len(t), stop))
                if at >= 0:
                    if out.get((text, item), (0, 0, 1))[2]:
                        out[text, item] = (at, at + len(t), 0)
                elif e:
                    rest.append((text, item, start, stop, low, high))
        rest = [r for r in rest if out.get(r[:2], (0, 0, 1))[2]]
        rest.sort(key=lambda r: len(self.texts[r[1]]))
        lo = 0
        while lo < len(rest):  # rows of about one size together
            hi, cells = lo, 0
            while hi < len(rest) and (hi == lo or cells < CELLS):
                _, item, _, _, low, high = rest[hi]
                cells += high - low + 1 + 2 * int(self.edits[item])
                hi += 1
            some = rest[lo:hi]
            found = align([self.texts[i] for _, i, *_ in some], b, *(np.array([r[k] for r in some]) for k in range(2, 6)), self.edits[[i for _, i, *_ in some]])
            for (text, item, *_), at in zip(some, found):
                if at and ((text, item) not in out or at[2] < out[text, item][2]):
                    out[text, item] = at
            lo = hi
        return [(t, i, *v) for (t, i), v in out.items()]

    def _bands(self, hits: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, lowest and highest diagonal of runs of bands with enough shared grams."""
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            text, item, band, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            order = np.lexsort((band, item, text))
            text, item, band, n = text[order], item[order], band[order], n[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
            at = np.flatnonzero(new)
            return text[at], item[at], band[at], np.add.reduceat(n, at) if len(at) else n

        for text, item, diagonal in hits:
            band = np.floor_divide(diagonal, self.edits[item] + 1)
            # a band's diagonals are two halves, so a gram is in the band of its half and the one before
            held.append((np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.ones(2 * len(text), dtype=np.int64)))
            held = [merged()]
        if not held:
            return
        text, item, band, n = held[0]
        keep = n >= self.least[item]
        text, item, band = text[keep], item[keep], band[keep]
        if not len(text):
            return
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 2)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text)) - 1
        half = self.edits[item[first]] + 1
        yield from zip(text[first].tolist(), item[first].tolist(), (band[first] * half).tolist(), ((band[last] + 2) * half - 1).tolist())


def align(items: list[bytes], b: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int] | None]:
    """Best semi-global alignment of each item inside b[start:stop] on diagonals low to high, or None above ``most`` edits.

    One row of an array per item; step i takes byte i of all items. Cell d holds the least edits with
    the item's prefix ending on diagonal low + d. Gains of two edits leave the band only
    beyond ``most``, so the band is widened by ``most`` on both sides.
    """
    big = np.int32(1 << 20)
    low, sizes = low - most, np.array([len(t) for t in items])
    width = high + most - low + 1
    text = np.zeros((len(items), int(sizes.max())), dtype=np.uint8)
    for n, t in enumerate(items):
        text[n, : len(t)] = np.frombuffer(t, np.uint8)
    steps = np.arange(int(width.max()), dtype=np.int32)
    live, out = np.arange(len(items)), [None] * len(items)
    j = low[:, None] + steps  # the byte that the diagonal meets
    cost = np.where((steps < width[:, None]) & (j >= start[:, None]) & (j <= stop[:, None]), 0, big).astype(np.int32)
    begin = j.copy()
    tail = np.full((len(items), 1), big, dtype=np.int32)
    i = 0
    while True:
        ended = (sizes[live] == i) | (cost.min(axis=1) > most[live])
        if ended.any():
            for r in np.flatnonzero(ended & (sizes[live] == i)).tolist():
                k, n = int(cost[r].argmin()), int(live[r])
                if cost[r, k] <= most[n]:
                    out[n] = (int(begin[r, k]), int(low[n]) + k + i, int(cost[r, k]))
            live, cost, begin, j = live[~ended], cost[~ended], begin[~ended], j[~ended]
            tail = tail[: len(live)]
        if not len(live):
            return out
        first, last = start[live][:, None], stop[live][:, None]
        inside = (j >= first) & (j < last) & (steps < width[live][:, None])
        same = b[np.clip(j, 0, len(b) - 1)] != text[live, i][:, None]
        change = np.where(inside, cost + same, big)
        # a byte of the item left out: the next diagonal's cell of the row before
        reach = (j + 1 >= first) & (j < last) & (steps < width[live][:, None])
        skip = np.where(reach, np.concatenate([cost[:, 1:] + 1, tail], axis=1), big)
        left_out = skip < change
        own = np.where(left_out, skip, change)
        own_begin = np.where(left_out, np.concatenate([begin[:, 1:], tail], axis=1), begin)
        # bytes of the document put in: running minimum along the row
        key = own - steps
        at = np.maximum.accumulate(np.where(key == np.minimum.accumulate(key, axis=1), steps, 0), axis=1)
        cost = np.where(reach, np.take_along_axis(key, at, axis=1) + steps, big)
        begin = np.take_along_axis(own_begin, at, axis=1)
        j = j + 1
        i += 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, share: float = EDIT_SHARE, words: int = WORDS) -> DataFrame:
    """One row per document and benchmark item found in it: id, item id, ``begin`` and ``end`` (bytes of the text), ``n_edits``.

    An empty table of either kind gives no rows.
    """
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((docs, id_col), (benchmark, item_col)))
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // PART_BYTES)
    if parts > 1:  # by row, as any number of items may have one text
        items = staged(items.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))), "items")
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text is not null")
    schema = f"id {kind}, item {item_kind}, begin bigint, end bigint, n_edits int"
    out = None
    for part in range(parts):
        chosen = (items.filter(F.col("part") == part).drop("part") if parts > 1 else items).toArrow()
        held = docs.sparkSession.sparkContext.broadcast((chosen["item"].to_pylist(), [plain(t) for t in chosen["text"].to_pylist()]))
        item_type = chosen.schema.field("item").type

        def run(batches: Iterator[pa.RecordBatch], held=held, item_type=item_type) -> Iterator[pa.RecordBatch]:
            known = Items(*held.value, q, share, words)
            for batch in batches:
                for lo, hi in textkit.slices(batch.column(1), SLICE_BYTES):
                    data, off = textkit.raw(batch.column(1).slice(lo, hi - lo))
                    b, where, at = normal(data, off)
                    found = known.find(b, where)
                    at = np.append(at, len(data))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([lo + t for t, *_ in found], pa.int64())),
                            pa.array([known.ids[i] for _, i, *_ in found], item_type),
                            pa.array([int(at[a] - off[t]) for t, _, a, _, _ in found], pa.int64()),
                            pa.array([int(at[z - 1] + 1 - off[t]) if z > 0 else 0 for t, _, _, z, _ in found], pa.int64()),
                            pa.array([e for *_, e in found], pa.int32()),
                        ],
                        ["id", "item", "begin", "end", "n_edits"],
                    )

        found = base.mapInArrow(textkit.tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)

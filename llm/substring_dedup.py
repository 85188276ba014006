"""Removal of long word runs that an earlier document has already.

A window is ``width`` consecutive words of one document. A word goes if a window
over it also starts in a document with a smaller id; windows are judged on the
input. Each window has a Rabin-Karp hash of 64 bits and a second one of 32 (other word
values, same sums), and Spark takes the smallest document id per pair of hashes: with 10**13
windows a false repeat is less likely than one in a thousand.

Windows that occur once are most of a corpus, and are told apart before any window
is shuffled: half of a window's words make a gram, and the gram with the smallest
hash in a window is its anchor. Equal windows have equal anchors, so a window whose
anchor occurs in one document only has no other. Neighbouring windows share their
anchor, so anchors are a few hundredths of the windows. This loses no window.

The windows of one anchor make a stretch of some words. Equal stretches have equal windows, so the
smallest id of each stretch owns all of them, if its anchor has no other stretch; only where an anchor has
stretches that differ are windows taken apart and compared, those of one stretch of each kind. Inside a longer copied
passage all stretches are equal, so mostly its two ends remain.

Jobs: stretches per document, hashed as windows are; the smallest and largest id per anchor; the first of each
stretch among shared anchors; windows of those below anchors with two kinds or more; the smallest id per window hash; removed stretches and windows
merged to maximal intervals per document; the texts without them. A hash in a third
of all documents is combined before its shuffle when counted, and joined back by
broadcast while the repeated hashes take a megabyte, else in parts by Spark's skew join.
Texts are shuffled only where a broadcast sieve of the wanted ones lets them through. Each table is deleted once the next one is written.

Null ids own nothing and lose nothing; null and empty texts have no words; rows
with equal id and text are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import textkit
from llm.staging import dropped, sieved, sized, staged

WIDTH = 50
#: Windows whose grams are compared in one numpy pass.
BLOCK = 1 << 16
#: What makes a word's value for the second hash.
SECOND = np.uint64(0xA0761D6478BD642F)
BATCH_BYTES = 1 << 20
#: Bytes of repeated hashes up to which they are broadcast: few, so that a large run has the plan that a small one is measured by.
FEW = 1 << 20


def _anchors(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and last window (word indexes) of each run of windows with one anchor."""
    gram = width // 2 + 1
    span = width - gram + 1
    grams, at = textkit.window_hashes(hashes, first, gram)
    full = np.zeros(len(hashes), dtype=np.uint64)
    full[at] = grams
    _, starts = textkit.window_hashes(hashes, first, width)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    view = np.lib.stride_tricks.sliding_window_view(full, span)
    chosen = np.concatenate([p + span - 1 - view[p][:, ::-1].argmin(axis=1) for p in np.split(starts, range(BLOCK, len(starts), BLOCK))])
    text = np.searchsorted(first, starts, side="right")
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(starts)) - 1
    return full[chosen[lo]], starts[lo], starts[hi]


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.slices(batch.column(2)):
                data, off = textkit.raw(batch.column(2).slice(lo, hi - lo))
                starts, ends, first = textkit.words(data, off)
                words = textkit.word_hashes(data, starts, ends)
                anchor, a, b = _anchors(words, first, width)
                content = textkit.stretch_hashes(words, a, b + width)
                check = textkit.stretch_hashes(textkit.mix(words ^ SECOND), a, b + width).astype(np.uint32)
                row = np.searchsorted(first, a, side="right") - 1
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        pa.array(check.view(np.int32)),
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array((a - first[row]).astype(np.int32)),
                        pa.array((b - first[row]).astype(np.int32)),
                    ],
                    ["hash", "content", "check", "id", "key", "lo", "hi"],
                )

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.slices(batch.column(2)):
                data, off = textkit.raw(batch.column(2).slice(lo, hi - lo))
                starts, ends, first = textkit.words(data, off)
                words = textkit.word_hashes(data, starts, ends)
                windows, at = textkit.window_hashes(words, first, width)
                checks = textkit.window_hashes(textkit.mix(words ^ SECOND), first, width)[0].astype(np.uint32)
                ranges = batch.column(3).slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), np.diff(ranges.offsets.to_numpy()))
                a, b = (ranges.flatten().field(k).to_numpy() + first[row] for k in (0, 1))
                mark = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(mark, a, 1)
                np.add.at(mark, b + 1, -1)
                keep = mark.cumsum()[at] > 0
                windows, checks, at = windows[keep], checks[keep], at[keep]
                row = np.searchsorted(first, at, side="right") - 1
                a.sort()
                lead = a[np.searchsorted(a, at, side="right") - 1] if len(at) else at  # stretches of one text don't overlap
                for k in range(0, max(len(at), 1), BLOCK):
                    part = slice(k, k + BLOCK)
                    take = pa.array(row[part] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(windows[part].view(np.int64)),
                            pa.array(checks[part].view(np.int32)),
                            batch.column(0).take(take),
                            batch.column(1).take(take),
                            pa.array((lead[part] - first[row[part]]).astype(np.int32)),
                            pa.array((at[part] - lead[part]).astype(np.int32)),
                        ],
                        ["hash", "check", "id", "key", "lo", "pos"],
                    )

    return run


def _intervals(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = []
            for ranges in batch.column(2):
                lo, hi = (ranges.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(lo)
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                cut = np.flatnonzero(lo[1:] - hi[:-1] > width)
                begin, end = lo[np.append(0, cut + 1)], hi[np.append(cut, len(hi) - 1)] + width
                spans.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["id", "key", "removed"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in textkit.slices(batch.column(1), BATCH_BYTES):
            texts = batch.column(1).slice(lo, hi - lo).to_pylist()
            spans = batch.column(2).slice(lo, hi - lo).to_pylist()
            n, gone, kept = [], [], []
            for text, removed in zip(texts, spans):
                words = (text or "").encode().split()
                n.append(len(words))
                gone.append(sum(s["end"] - s["begin"] for s in removed or ()))
                at, parts = 0, []
                for s in removed or ():
                    parts += words[at : s["begin"]]
                    at = s["end"]
                kept.append(b" ".join(parts + words[at:] if removed else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), batch.column(2).slice(lo, hi - lo), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "removed", "kept_text"],
            )


def removed_intervals(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, removed): the maximal intervals of word positions to remove, for texts that have any.

    ``key`` is the text's xxhash64, so that rows that share an id stay apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    base = base.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    stretch = ["hash", "content", "check"]
    anchors = staged(base.mapInArrow(textkit.tidy(_anchor_rows(width)), f"hash bigint, content bigint, check int, id {kind}, key bigint, lo int, hi int"), "anchors")
    shared = anchors.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("hash")
    shared = staged(shared, "shared-anchors")
    stretches = staged(anchors.join(sized(shared, FEW), "hash", "left_semi"), "stretches")
    dropped(anchors, shared)
    # equal stretches have equal windows: one of the smallest id stands for all
    first = stretches.groupBy(*stretch).agg(F.min(F.struct("id", "key", "lo", "hi")).alias("first"))
    first = staged(first.select(*stretch, "first.*"), "contents")
    # windows are compared where an anchor has stretches that differ
    mixed = first.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    mixed = staged(mixed, "mixed-anchors")
    ranges = first.join(sized(mixed, FEW), "hash", "left_semi").groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    ranges = staged(ranges, "ranges")
    near = sieved(base, F.col("key"), ranges.select("key")).filter("maybe").join(ranges, ["id", "key"])
    windows = near.select("id", "key", "text", "ranges").mapInArrow(textkit.tidy(_window_rows(width)), f"hash bigint, check int, id {kind}, key bigint, lo int, pos int")
    windows = staged(windows, "windows")
    owner = windows.groupBy("hash", "check").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner < last").select("hash", "check", "owner")
    owner = staged(owner, "owners")
    lost = windows.join(sized(owner, FEW), ["hash", "check"]).filter("id > owner").select("id", "key", "lo", "pos").distinct()
    lost = staged(lost, "lost")
    dropped(mixed, ranges, windows, owner)
    # a stretch goes whole where a smaller id has it, else without the windows that another stretch of a smaller id has
    whole = stretches.join(sized(first.select(*stretch, F.col("id").alias("least")), FEW), stretch).filter("id > least").select("id", "key", "lo", "hi")
    lost = staged(lost.join(first, ["id", "key", "lo"]).select(*stretch, "id", "pos"), "lost")
    some = stretches.join(sized(lost, FEW), [*stretch, "id"]).select("id", "key", (F.col("lo") + F.col("pos")).alias("lo"), (F.col("lo") + F.col("pos")).alias("hi"))
    gone = whole.unionByName(some).groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    out = staged(gone.mapInArrow(textkit.tidy(_intervals(width)), f"id {kind}, key bigint, removed array<struct<begin:int,end:int>>"), "removed")
    dropped(stretches, first, lost)
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``removed`` (intervals; null: none) and ``kept_text``.

    ``kept_text`` joins the kept words with one blank. With ``carry`` the id column is
    ``row``, a struct of all columns of the input; without, other columns are ignored.
    """
    removed = removed_intervals(docs, width, id_col, text_col)
    out = F.struct(*(docs[c] for c in docs.columns)) if carry else docs[id_col]
    base = docs.select(out.alias("out"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = base.schema["out"].dataType.simpleString()
    base = sieved(base.withColumn("key", F.xxhash64("text")), F.col("key"), removed.select("key"))
    joined = base.filter("maybe").join(removed, ["id", "key"], "left").select("out", "text", "removed")
    joined = joined.unionByName(base.filter("not maybe").select("out", "text", F.lit(None).cast(removed.schema["removed"].dataType).alias("removed")))
    out = joined.mapInArrow(textkit.tidy(_kept), f"id {kind}, n_words bigint, n_removed bigint, removed array<struct<begin:int,end:int>>, kept_text string")
    return out.withColumnRenamed("id", "row" if carry else id_col)

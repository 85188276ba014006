"""Importance resampling toward a target: hashed n-gram features, gains per bucket, draws by Gumbel noise.

A feature is a run of 1 to ``longest`` consecutive words of a text (A-Z in lower case), joined by one blank;
its bucket is the crc32 of its bytes modulo ``buckets``. A bucket's gain is the floored, scaled log ratio of its share of the
target's features to its share of the corpus's, with one feature added to each bucket. A document's weight
is the floored mean gain of its features; its score adds Gumbel noise that its id fixes. The documents with the highest
scores are a sample without replacement by weight.

Inside a task each slice of texts interns its features in an open-addressed table of numpy arrays: xxhash64 keys, linear probing
with all pending occurrences at once, and byte verification against the slot's first occurrence, so that equal
keys of unequal features take separate slots. A slot stores its bucket (crc32 is taken once a slot) and
its count: counting adds slot counts to buckets, weighing gathers gains by the occurrences' slot ids.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import textkit
from llm.staging import by_bytes, sized, staged

#: Buckets of features, words of the longest feature, and the scale of gains and noise.
BUCKETS = 10_000
LONGEST = 1
SCALE = 1000

_U = np.uint64
#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes to word bytes: A-Z in lower case, digits, a-z and bytes of other characters as they are, the rest a blank.
_CLEAN = np.full(256, 0x20, dtype=np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _CLEAN[_low : _high + 1] = np.arange(_low, _high + 1)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of stretches of ``data``: those under 32 bytes by length, a length's together; longer ones singly."""
    out = np.zeros(len(starts), dtype=np.uint64)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for n, lo, hi in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        at = order[lo:hi]
        if n >= 32:
            for k in at.tolist():
                out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + n])
            continue
        h = np.full(len(at), _P5 + _U(n), dtype=np.uint64)
        if n:
            rows = np.lib.stride_tricks.sliding_window_view(data, n)[starts[at]]
            k = 0
            for k in range(8, n + 1, 8):
                lane = np.ascontiguousarray(rows[:, k - 8 : k]).view("<u8")[:, 0]
                h = _turn(h ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            k = n // 8 * 8
            if n - k >= 4:
                lane = np.ascontiguousarray(rows[:, k : k + 4]).view("<u4")[:, 0].astype(np.uint64)
                h = _turn(h ^ (lane * _P1), 23) * _P2 + _P3
                k += 4
            for k in range(k, n):
                h = _turn(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        out[at] = h ^ (h >> _U(32))
    return out


def crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of ``data``: a byte of all stretches of up to 64 bytes at a time; longer ones singly."""
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    long = int(np.searchsorted(-size, -64, side="left"))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + lengths[k]])
    order, size = order[long:], size[long:]
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -k, side="left"))  # those with a byte there
        crc[:m] = _CRC[(crc[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[order] = ~crc
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the stretches at ``a`` and ``b`` (of equal lengths, none empty) hold equal bytes."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    first = np.cumsum(lengths) - lengths
    step = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return np.logical_and.reduceat(data[np.repeat(a, lengths) + step] == data[np.repeat(b, lengths) + step], first)


@dataclass
class Interned:
    """Features of a slice of texts: each occurrence's slot and text, and by slot its bucket and count."""

    slot: np.ndarray
    text: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    words: np.ndarray  # by text


def intern(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch's slot number, and by slot the stretch that stands for it: equal bytes share a slot, others don't.

    All pending occurrences probe at once: an empty place goes to one of them, those whose bytes equal
    the holder's are done, and the rest go to the next place. Equal stretches move together.
    """
    mask = (1 << max(4, int(2 * len(starts)).bit_length())) - 1
    holder = np.full(mask + 1, -1, dtype=np.int64)
    place = (keys & _U(mask)).astype(np.int64)
    pending = np.arange(len(starts))
    while len(pending):
        at = place[pending]
        free = holder[at] < 0
        holder[at[free]] = pending[free]
        held = holder[at]
        same = (keys[held] == keys[pending]) & (lengths[held] == lengths[pending])
        check = np.flatnonzero(same & (held != pending))
        same[check] = _same(data, starts[held[check]], starts[pending[check]], lengths[pending[check]])
        pending = pending[~same]
        place[pending] = (place[pending] + 1) & mask
    used = np.flatnonzero(holder >= 0)
    number = np.zeros(mask + 1, dtype=np.int64)
    number[used] = np.arange(len(used))
    return number[place], holder[used]


def features(data: np.ndarray, off: np.ndarray, longest: int, buckets: int, carried: int = 0) -> Interned:
    """The features of texts that lie end to end in ``data``; those that end in the first ``carried`` words of the first text don't count."""
    clean = _CLEAN[data]
    starts, ends, first = textkit.words(clean, off)
    n = len(starts)
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - (lengths + 1)  # words again, one blank after each
    take = np.arange(int((lengths + 1).sum())) + np.repeat(starts - begin, lengths + 1)
    joined = np.append(clean, np.uint8(0x20))[take]
    joined[begin + lengths] = 0x20
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    from_, size, of = [], [], []
    for m in range(1, longest + 1):
        at = np.arange(max(n - m + 1, 0))
        at = at[(at + m <= first[text[at] + 1]) & (at + m > carried)]
        last = at + m - 1
        from_.append(begin[at])
        size.append(begin[last] + lengths[last] - begin[at])
        of.append(text[at])
    starts, lengths, text = (np.concatenate(x).astype(np.int64) for x in (from_, size, of))
    slot, holder = intern(joined, starts, lengths, xxh64(joined, starts, lengths))
    bucket = (crc32(joined, starts[holder], lengths[holder]) % np.uint32(buckets)).astype(np.int64)
    return Interned(slot, text, bucket, np.bincount(slot, minlength=len(holder)), np.diff(first))


def _slices(texts: pa.Array, longest: int, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Row range, bytes, offsets and carried words of slices of about ``limit`` bytes.

    A longer text comes in pieces that end between words, each with the last ``longest`` - 1 words of
    the one before in front of it, so that a text of any length takes bounded memory.
    """
    for lo, hi in textkit.slices(texts, limit):
        data, off = textkit.raw(texts.slice(lo, hi - lo))
        if len(data) <= 2 * limit:
            yield lo, hi, data, off, 0
            continue
        at, front, carried = 0, data[:0], 0
        while at < len(data):
            end = at + limit
            while end < len(data):
                gap = np.flatnonzero(_CLEAN[data[end : end + limit]] == 0x20)
                if len(gap):
                    end += int(gap[0])
                    break
                end += limit  # inside a word
            end = min(len(data), end)
            piece = np.concatenate([front, data[at:end]])
            yield lo, hi, piece, np.array([0, len(piece)]), carried
            starts, _, _ = textkit.words(_CLEAN[piece], np.array([0, len(piece)]))
            carried = min(longest - 1, len(starts))
            front, at = (piece[starts[-carried] :] if carried else piece[:0]), end


def _counted(rows: DataFrame, text_col: str, longest: int, buckets: int) -> list[int]:
    """Features of all texts by bucket: sums per task, then per bucket; the ``buckets`` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, off, carried in _slices(batch.column(0), longest, textkit.SLICE_BYTES):
                f = features(data, off, longest, buckets, carried)
                total += np.bincount(f.bucket, weights=f.count, minlength=buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    parts = rows.select(rows[text_col].alias("text")).mapInArrow(textkit.tidy(run), "bucket int, n bigint")
    out = [0] * buckets
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain: floor(SCALE * ln of the target's smoothed share over the corpus's)."""
    by_bytes(docs.sparkSession)
    corpus, wanted = _counted(docs, text_col, longest, buckets), _counted(target, target_col, longest, buckets)
    s_all, t_all = float(sum(corpus) + buckets), float(sum(wanted) + buckets)
    return [math.floor(SCALE * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(corpus, wanted)]


def noise(seed: int, key: object) -> int:
    """Floored, scaled Gumbel noise of a row: its uniform number is the head of sha256(seed:id); a null id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = 2024) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row: a map without a shuffle; ``gain`` has a fixed number of entries."""
    kind, buckets = docs.schema[id_col].dataType.simpleString(), len(gain)
    by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, dtype=np.int64)
        for batch in batches:
            n = len(batch)
            words, found, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for lo, hi, data, off, carried in _slices(batch.column(1), longest, textkit.SLICE_BYTES):
                f = features(data, off, longest, buckets, carried)
                words[lo:hi] += f.words
                words[lo] -= carried
                found[lo:hi] += np.bincount(f.text, minlength=hi - lo)
                total[lo:hi] += np.bincount(f.text, weights=table[f.bucket][f.slot], minlength=hi - lo).astype(np.int64)
            weight = np.where(found > 0, total // np.maximum(found, 1), 0)
            score = weight + np.fromiter((noise(seed, k) for k in batch.column(0).to_pylist()), np.int64, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, found, weight, score))], ["id", "n_words", "n_features", "weight", "score"])

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = chosen.mapInArrow(textkit.tidy(run), f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")
    return out.withColumnRenamed("id", id_col)


def _ranked(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... by falling score, then smaller id; range partitions are numbered by themselves and shifted.

    The ranges are cut by a row number too, so that rows of one score and id spread; they are written once,
    so that counts and numbers come from the same ranges. One count a partition is summed up in order.
    """
    order = [F.desc("score"), F.asc(id_col), F.asc("_row")]
    ranged = staged(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sized(counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_o")))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_o")
    return ranged.join(before, "_p").withColumn("rank", place.cast("bigint")).drop("_p", "_o")


def resample(
    docs: DataFrame, target: DataFrame, percent: int, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 2024,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; ``rank`` numbers the draw and is null beyond it.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) with the highest scores are drawn,
    the smaller id first on ties. Null and empty texts have no features, weight 0, and no rank unless ``least_words`` is 0;
    repeated rows are rows of their own with equal scores and consecutive ranks; null ids come first among equal scores;
    an empty table gives no rows, an empty target a gain for few features in the corpus. Other columns are ignored.
    """
    gain = gains(docs, target, text_col, target_col, longest, buckets)
    scored = weights(docs, gain, id_col, text_col, longest, seed)
    rows = staged(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    ranked = _ranked(rows.filter(able), id_col)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))
    return out.drop("_row")


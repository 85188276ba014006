"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), where the pairs
cost linear time: half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor.

Features of a text: its distinct lower-case words by hash (weight 1 / sqrt of their number),
and one bin for each of a list of structure statistics (shares of capitals, digits,
punctuation and white space, words, word length, distinct words and lines, words that
repeat the one before, line length, the commonest word's share) and for the stated number of characters. Labels,
language, source and ids are never read for a score.

Learning reads a bounded sample of labelled rows outside the held-out fold
(``LEARN_DOCS`` per label, weighted to the labels' shares) and runs AdaGrad on the driver
over its features; scoring is a map without a shuffle over all rows.

Null and empty texts have the bins of empty texts. Without labels of both kinds the
score is the share of label 1 (0.5 without any). Repeated rows are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import textkit
from llm.sampling import bounded, held_out

LEARN_DOCS = 3_000
WORD_BITS = 16
FACTORS = 8
EPOCHS = 6
BATCH = 64
RATE = 0.05
DECAY = 1e-5
KEEP_AT = 0.3

_CLASSES = ("upper", "digit", "blank", "newline", "mark", "high")
#: Upper edges of the bins of each statistic; one more bin lies above the last.
_SHARE = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.75, 0.9, 0.98)
_COUNT = (0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1_000, 2_000, 5_000, 10_000, 50_000)
_LENGTH = (0, 2, 3, 4, 5, 6, 7, 8, 10, 14, 20, 40, 80, 160, 320, 640, 1_280)
_STATS = [*((c, _SHARE) for c in _CLASSES), ("distinct", _SHARE), ("top", _SHARE), ("again", _SHARE), ("lines", _SHARE), ("words", _COUNT), ("chars", _COUNT), ("word", _LENGTH), ("line", _LENGTH)]
_FIRST = np.cumsum([0, *(len(edges) + 1 for _, edges in _STATS)])
WORDS = 1 << WORD_BITS
SIZE = WORDS + int(_FIRST[-1])

_KIND = np.full(256, -1, dtype=np.int64)
_KIND[ord("A") : ord("Z") + 1] = 0
_KIND[ord("0") : ord("9") + 1] = 1
_KIND[[9, 11, 12, 13, 32]] = 2
_KIND[10] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KIND[128:] = 5


def features(texts: pa.Array, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and weights of the features of each text, end to end, and their offsets."""
    data, off = textkit.raw(texts)
    starts, ends, first = textkit.words(data, off)
    rows = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    kinds = _KIND[data]
    values = []
    for k in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        values.append((total[off[1:]] - total[off[:-1]]) / size)
        if _CLASSES[k] == "newline":
            lines = total[off[1:]] - total[off[:-1]] + 1
    n = np.diff(first)
    of = np.repeat(np.arange(rows), n)
    hashed = (textkit.word_hashes(data, starts, ends, True) & np.uint64(WORDS - 1)).astype(np.int64)
    same = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    keys, uses = np.unique(of * WORDS + hashed, return_counts=True)
    row = keys >> WORD_BITS
    own = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, uses)
    split = [t.split("\n") if t else [] for t in texts.to_pylist()]
    values += [
        own / np.maximum(n, 1),
        top / np.maximum(n, 1),
        np.bincount(of[1:][same], minlength=rows) / np.maximum(n, 1),
        np.array([len(set(x)) / len(x) if x else 0.0 for x in split]),
        n,
        chars,
        np.bincount(of, weights=ends - starts, minlength=rows) / np.maximum(n, 1),
        np.diff(off) / lines,
    ]
    bins = np.stack([WORDS + at + np.searchsorted(edges, v) for (_, edges), v, at in zip(_STATS, values, _FIRST)], axis=1)
    index = np.concatenate([keys & (WORDS - 1), bins.ravel()])
    weight = np.concatenate([1 / np.sqrt(own[row]), np.full(bins.size, 0.5)])
    owner = np.concatenate([row, np.repeat(np.arange(rows), len(_STATS))])
    order = np.argsort(owner, kind="stable")
    return index[order], weight[order], np.concatenate([[0], np.cumsum(own + len(_STATS))])


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, bias: float):
        rng = np.random.default_rng(11)
        self.bias = bias
        self.linear = np.zeros(SIZE, dtype=np.float32)
        self.factors = rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)
        self.constant: float | None = None

    def raw(self, index: np.ndarray, weight: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's value for each row, and the factor sums, by the sum-of-squares identity."""
        part = self.factors[index] * weight[:, None]
        sums = np.add.reduceat(part, off[:-1], axis=0)
        squares = np.add.reduceat(part * part, off[:-1], axis=0)
        value = self.bias + np.add.reduceat(self.linear[index] * weight, off[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)
        return value, sums

    def scores(self, index: np.ndarray, weight: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(index, weight, off)[0], -30, 30)))

    def fit(self, index: np.ndarray, weight: np.ndarray, off: np.ndarray, label: np.ndarray, importance: np.ndarray) -> None:
        """AdaGrad over shuffled mini-batches."""
        rng = np.random.default_rng(5)
        g_linear, g_factors, g_bias = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, FACTORS), 1e-2, np.float32), 1e-2
        size = np.diff(off)
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                n = size[rows]
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(off[rows] - (ends - n), n)
                i, x = index[at], weight[at].astype(np.float32)
                value, sums = self.raw(i, x, np.concatenate([[0], ends]))
                slope = ((1 / (1 + np.exp(-np.clip(value, -30, 30))) - label[rows]) * importance[rows] / len(rows)).astype(np.float32)
                each = np.repeat(slope, n) * x
                touched, where = np.unique(i, return_inverse=True)
                d_linear = np.bincount(where, weights=each, minlength=len(touched)).astype(np.float32) + DECAY * self.linear[touched]
                slopes = each[:, None] * (np.repeat(sums, n, axis=0) - self.factors[i] * x[:, None])
                d_factors = np.stack([np.bincount(where, weights=slopes[:, f], minlength=len(touched)) for f in range(FACTORS)], axis=1).astype(np.float32)
                d_factors += DECAY * self.factors[touched]
                g_linear[touched] += d_linear**2
                g_factors[touched] += d_factors**2
                self.linear[touched] -= RATE * d_linear / np.sqrt(g_linear[touched])
                self.factors[touched] -= RATE * d_factors / np.sqrt(g_factors[touched])
                g_bias += slope.sum() ** 2
                self.bias -= RATE * slope.sum() / np.sqrt(g_bias)


def _columns(docs: DataFrame, id_col: str, text_col: str, chars_col: str | None) -> DataFrame:
    chars = docs[chars_col].cast("bigint") if chars_col and chars_col in docs.columns else F.lit(None).cast("bigint")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(chars, F.char_length(docs[text_col]), F.lit(0)).cast("bigint").alias("chars"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", label_col: str = "quality", per_label: int = LEARN_DOCS) -> Machine:
    """Fits a machine to a bounded sample of labelled rows outside the held-out fold."""
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    marks = marks.filter(~held_out("id")).dropDuplicates(["id"])
    shares = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(shares) < 2:
        m = Machine(0.0)
        m.constant = float(next(iter(shares), 0.5))
        return m
    chosen = bounded(marks, "label", "id", per_label)
    rows = _columns(docs, id_col, text_col, chars_col).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.slices(batch.column(1)):
                index, weight, off = features(batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).to_numpy())
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v)) for v in (index.astype(np.int32), weight.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), *lists], ["id", "label", "index", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("id", "text", "chars", "label").mapInArrow(textkit.tidy(run), f"id {kind}, label int, index array<int>, weight array<float>").toArrow().sort_by("id").combine_chunks()
    label = found["label"].to_numpy().astype(np.float64)
    if not len(label):
        m = Machine(0.0)
        m.constant = shares[1] / sum(shares.values())
        return m
    lists = [found[c].combine_chunks() for c in ("index", "weight")]
    off = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
    total, have = sum(shares.values()), {v: max((label == v).sum(), 1) for v in (0, 1)}
    importance = np.where(label == 1, shares[1] / have[1], shares[0] / have[0]) * len(label) / total
    m = Machine(float(np.log(shares[1] / shares[0])))
    m.fit(lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy(), off, label, importance)
    return m


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """One row per input row: id, ``score`` and ``predicted`` (1 from a score of 0.3 on)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in textkit.slices(batch.column(1)):
                s = held.value.scores(*features(batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s.astype(np.float64)), pa.array((s >= KEEP_AT).astype(np.int32))], ["id", "score", "predicted"])

    return _columns(docs, id_col, text_col, chars_col).mapInArrow(textkit.tidy(run), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)

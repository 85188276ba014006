"""Exact top-k documents by BM25: block-max WAND over an inverted index per shard, and a merge of all shards.

Terms are lower-case (A-Z) words; a query is the set of its text's terms. With N rows,
df rows holding a term, a row's count tf of it and its words dl (average avgdl):
score = sum of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)).
N, df and avgdl are counted over all rows before any shard is scored, so scores of
different shards are comparable and the merge is exact.

Index. Texts are cut into terms once: a table has each row's words, distinct terms and counts, and all that follows reads
it, however many rounds and blocks of queries there are. A shard is a run of its rows of one task with about ``SHARD_BYTES`` of terms and counts, ordered by length. Each query term has its postings in row order, cut in blocks with the
greatest share of a score in each. Blocks of a list over ``1 / DENSE`` of the shard span
``BLOCK`` rows; in shorter lists every posting is a block of its own.

Search. The threshold of a query is its k-th best score so far. A row is a pivot only if
the maxima of the blocks that cover it, summed over the query's lists, reach the
threshold (maxima are summed for ``GROUP`` queries at a time, as one matrix product); postings of the long lists are read for pivots alone, those of highest bound first,
and the threshold rises after each ``WAVE`` of them. Everything else is skipped unread. Whatever is
below the threshold can't be among the k best, so skipping loses nothing.

Thresholds across shards. Rows are searched in rounds, each several times as large as all
before it: the k-th best rows of the rounds before, best of all shards, are sent with
the next round's queries, so that its shards skip from the start and return only
rows that can still be among the k best. On average a round returns a constant
number of rows a query, whatever the number of its shards.

Queries go to the tasks in blocks of at most ``BLOCK_TERMS`` terms, so what is broadcast is
bounded. Ties go to the smaller id.

Null and blank texts have no terms: as queries they find nothing, as rows they are
never found. Rows that share no term with a query are not returned. Repeated rows
are found once each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import textkit
from llm.staging import staged

K1, B = 1.2, 0.75
TOP = 10
SHARD_BYTES = 32 << 20
BLOCK = 2
DENSE = 16
#: Queries whose maxima are summed together.
GROUP = 64
#: Pivots scored before the threshold is raised.
WAVE = 64
#: Rows of the first round, and how many times as many as all before it a later round has.
FIRST_ROWS = 16_384
GROWTH = 3
#: Rows of a task in all rounds but the last.
TASK_ROWS = 4_096
#: Parts of the rows, by a hash of the id, from which rounds are made.
PARTS = 1 << 20
BLOCK_TERMS = 4_000_000
#: Decimals of a score; rows are ranked by the rounded score.
DECIMALS = 6
#: Distinct terms that a task counts before it hands them on.
COUNTED = 1 << 20


def _terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, then row, term hash and count of each distinct term, and words per row, by slices of a column."""
    for lo, hi in textkit.slices(texts):
        data, off = textkit.raw(texts.slice(lo, hi - lo))
        starts, ends, first = textkit.words(data, off)
        hashes = textkit.word_hashes(data, starts, ends, True).view(np.int64)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        yield lo, r[at], h[at], np.diff(np.append(at, len(h))), np.diff(first)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, words, and the distinct terms (8 bytes each) and counts (4 bytes) of each row."""
    for batch in batches:
        for lo, row, term, tf, words in _terms(batch.column(1)):
            off = np.searchsorted(row, np.arange(len(words) + 1))
            packed = [_packed(off * 8, term.astype("<i8")), _packed(off * 4, tf.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(words)), pa.array(words, pa.int64()), *packed], ["id", "words", "terms", "counts"])


def _packed(off: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows per term of (words, terms), summed over a task as far as memory allows; one row with a null term has the rows and words."""
    rows, length, held, size = 0, 0, [], 0

    def merged():
        term, where = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return term, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        rows += len(batch)
        length += pc.sum(batch.column(0)).as_py() or 0
        held.append(np.unique(textkit.raw(batch.column(1))[0].view("<i8"), return_counts=True))
        size += len(held[-1][0])
        if size > COUNTED:
            held = [merged()]
            size = len(held[0][0])
            if size > COUNTED // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1]), pa.nulls(size, pa.int64())], ["term", "df", "words"])
                held, size = [], 0
    if held:
        term, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n), pa.nulls(len(term), pa.int64())], ["term", "df", "words"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([rows], pa.int64()), pa.array([length], pa.int64())], ["term", "df", "words"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, row, term, _, _ in _terms(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(term)], ["query", "term"])


class Shard:
    """An inverted index of some rows: row, number of the query term, count, and the words of each row."""

    def __init__(self, row: np.ndarray, at: np.ndarray, tf: np.ndarray, words: np.ndarray, idf: np.ndarray, average: float):
        self.n, self.order = len(words), np.argsort(words, kind="stable")  # rows by length, so that a block's rows are alike
        place = np.empty(self.n, dtype=np.int64)
        place[self.order] = np.arange(self.n)
        row = place[row]
        order = np.lexsort((row, at))
        at, self.row, tf = at[order], row[order], tf[order]
        self.share = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[self.order][self.row] / average))
        self.first = np.searchsorted(at, np.arange(len(idf) + 1))
        size = np.diff(self.first)
        long = np.flatnonzero(size * DENSE > self.n)
        self.long = np.full(len(idf), -1, dtype=np.int64)
        self.long[long] = np.arange(len(long))
        blocks = -(-self.n // BLOCK)
        self.dense = np.zeros((len(long), blocks * BLOCK))
        for k, t in enumerate(long.tolist()):
            part = slice(self.first[t], self.first[t + 1])
            self.dense[k, self.row[part]] = self.share[part]
        most = self.dense.reshape(len(long), blocks, BLOCK).max(axis=2)
        self.most = np.nextafter(most.astype(np.float32), np.float32(np.inf)) * (most > 0)
        self.dense = np.ascontiguousarray(self.dense[:, : self.n].T)
        #: Rows scored in the long lists, of all that might have been.
        self.scored = self.seen = 0

    def bounds(self, queries: list[np.ndarray]) -> np.ndarray:
        """By query and block: the maxima of the block, summed over the query's long lists."""
        asked = np.zeros((len(queries), len(self.most)), dtype=np.float32)
        for k, query in enumerate(queries):
            dense = self.long[query]
            asked[k, dense[dense >= 0]] = 1
        return asked @ self.most

    def search(self, query: np.ndarray, top: int, floor: float = 0.0, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows (numbers as given) and rounded scores that may be among the ``top`` best and reach ``floor``; ties with the last are all there."""
        dense = self.long[query]
        short = query[dense < 0]
        dense = dense[dense >= 0]
        n = self.first[short + 1] - self.first[short]
        flat = np.repeat(self.first[short] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(self.row[flat], weights=self.share[flat], minlength=self.n)
        self.seen += self.n
        if len(dense):
            bound = np.repeat(self.bounds([query])[0] if bounds is None else bounds, BLOCK)[: self.n] + score
            slack = 1 - 1e-5 - 2.0**-23 * len(dense)  # sums of 32-bit floats
        else:
            bound, slack = score, 1.0
        least = max(floor - 10.0**-DECIMALS, 1e-300)
        pivots = np.flatnonzero(bound >= least * slack)
        rows, found = [], []
        if len(pivots) > WAVE:
            pivots = pivots[np.argsort(-bound[pivots])]
        wave = WAVE
        while len(pivots):
            some, pivots = pivots[:wave], pivots[wave:]
            self.scored += len(some)
            rows.append(some)
            found.append(score[some] + self.dense[some[:, None], dense].sum(axis=1) if len(dense) else score[some])
            wave *= 2
            if len(pivots):
                best = np.concatenate(found)
                if len(best) >= top:
                    least = max(least, np.partition(best, len(best) - top)[len(best) - top] - 10.0**-DECIMALS)
                pivots = pivots[: np.searchsorted(-bound[pivots], -least * slack, side="right")]
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        rows, full = np.concatenate(rows), np.round(np.concatenate(found), DECIMALS)
        keep = (full > 0) & (full >= floor)
        if keep.sum() > top:
            keep &= full >= np.partition(full, len(full) - top)[len(full) - top]
        return self.order[rows[keep]], full[keep]


def _rounds(rows: int) -> list[int]:
    """The share of rows, in parts of ``PARTS``, up to which each round goes."""
    ends, upto = [], FIRST_ROWS
    while upto * (1 + GROWTH / 2) < rows:
        ends.append(max(1, PARTS * upto // rows))
        upto *= 1 + GROWTH
    return sorted({*ends, PARTS})


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(query_id, rank, id, score): the best ``top`` rows of ``docs`` for each row of ``queries``."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    query_kind = queries.schema[id_col].dataType.simpleString()
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    asked = queries.select(queries[id_col].alias("query"), queries[text_col].alias("text")).filter("query is not null and text is not null")
    asked = staged(asked.mapInArrow(textkit.tidy(_query_terms), f"query {query_kind}, term bigint").distinct(), "query-terms")
    index = staged(base.mapInArrow(textkit.tidy(_indexed), f"id {kind}, words bigint, terms binary, counts binary"), "index")
    counted = staged(index.select("words", "terms").mapInArrow(textkit.tidy(_counts), "term bigint, df bigint, words bigint"), "counts")
    rows, words = counted.filter("term is null").agg(F.sum("df"), F.sum("words")).first()
    schema = f"query {query_kind}, id {kind}, score double"
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    out = None
    if rows and words:
        average = words / rows
        df = counted.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.lit(float(rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = staged(asked.join(df, "term").select("query", "term", idf.alias("idf")), "weighted")
        mark = F.pmod(F.xxhash64("id"), F.lit(PARTS))
        blocks = -(-known.count() // BLOCK_TERMS)
        for block in range(blocks):
            chosen = known.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()
            terms, first = np.unique(chosen["term"].to_numpy(), return_index=True)
            weights = chosen["idf"].to_numpy()[first]
            names = chosen["query"].combine_chunks().dictionary_encode()
            which = names.indices.to_numpy()
            order = np.argsort(which, kind="stable")
            lists = np.searchsorted(terms, chosen["term"].to_numpy()[order]).astype(np.int32)
            ends = np.searchsorted(which[order], np.arange(len(names.dictionary) + 1))
            kept, began = None, 0
            for upto in _rounds(rows):
                held = spark.sparkContext.broadcast((terms, weights, names.dictionary, lists, ends, *_floors(kept, names.dictionary, top)))
                part = index.filter((mark >= began) & (mark < upto))
                if upto < PARTS:  # whole shards, not the shreds of all tasks
                    part = part.repartition(-(-rows * (upto - began) // (PARTS * TASK_ROWS)))
                found = part.mapInArrow(textkit.tidy(_answers(held, average, top)), schema)
                found = found if kept is None else kept.drop("rank").unionByName(found)
                kept = staged(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top), "best")
                began = upto
            out = kept if out is None else out.unionByName(kept)
    if out is None:
        out = spark.createDataFrame([], f"{schema}, rank int")
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def _floors(kept: DataFrame | None, names: pa.Array, top: int) -> tuple[np.ndarray, pa.Array]:
    """Score and id of the k-th best row so far of each query of a block (0 and null where fewer rows are known)."""
    if kept is None:
        return np.zeros(len(names)), None
    last = kept.filter(F.col("rank") == top).select("query", "score", "id").toArrow().combine_chunks()
    at = pc.index_in(names, last["query"].combine_chunks() if len(last) else pa.array([], names.type))
    return pc.fill_null(last["score"].take(at), 0.0).to_numpy(), last["id"].take(at).combine_chunks()


def _answers(held, average: float, top: int):
    """The search of a block of queries in a task's rows, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, names, lists, ends, floors, last = held.value
        floors, last = floors.copy(), last.to_pylist() if last is not None else [None] * len(names)

        def answers(parts: list, ids: list) -> Iterator[pa.RecordBatch]:
            row, at, tf, words = (np.concatenate([p[k] for p in parts]) for k in range(4))
            parts.clear()
            shard, keys = Shard(row, at, tf, words, weights, average), pa.concat_arrays(ids)
            rank = np.empty(len(keys), dtype=np.int64)
            rank[pc.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(keys))
            found = []
            for q in range(len(names)):
                if q % GROUP == 0:
                    bounds = shard.bounds([lists[ends[k] : ends[k + 1]] for k in range(q, min(q + GROUP, len(names)))])
                rows, scores = shard.search(lists[ends[q] : ends[q + 1]], top, floors[q], bounds[q % GROUP])
                if last[q] is not None and (scores == floors[q]).any():  # ties with the k-th best row must have a smaller id
                    keep = (scores > floors[q]) | pc.fill_null(pc.less(keys.take(pa.array(rows)), pa.scalar(last[q], keys.type)), False).to_numpy(zero_copy_only=False)
                    rows, scores = rows[keep], scores[keep]
                if len(rows) >= top:  # the task's later shards start from here
                    best = np.lexsort((rank[rows], -scores))[:top]
                    rows, scores = rows[best], scores[best]
                    floors[q], last[q] = scores[-1], keys[int(rows[-1])].as_py()
                if len(rows):
                    found.append((np.full(len(rows), q), rows, scores))
            if not found:
                return
            q, rows, scores = (np.concatenate([f[k] for f in found]) for k in range(3))
            for k in range(0, len(q), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[part])), keys.take(pa.array(rows[part])), pa.array(scores[part])], ["query", "id", "score"])

        parts, ids, size, n = [], [], 0, 0
        for batch in batches:
            term, off = textkit.raw(batch.column(2))
            tf = textkit.raw(batch.column(3))[0].view("<u4")
            term, off, words = term.view("<i8"), off // 8, np.asarray(batch.column(1))
            lo = 0
            while lo < len(batch):
                hi = min(len(batch), max(lo + 1, int(np.searchsorted(off, off[lo] + (SHARD_BYTES - size) // 12, side="right")) - 1))
                some = slice(off[lo], off[hi])
                at = np.searchsorted(terms, term[some])
                at[at == len(terms)] = 0
                asked = terms[at] == term[some]
                row = np.repeat(np.arange(n, n + hi - lo), np.diff(off[lo : hi + 1]))
                parts.append(tuple(x[asked].astype(np.int32) for x in (row, at, tf[some])) + (words[lo:hi],))
                ids.append(batch.column(0).slice(lo, hi - lo))
                n, size, lo = n + hi - lo, size + 12 * int(off[hi] - off[lo]), hi
                if size >= SHARD_BYTES or (lo < len(batch) and size):
                    yield from answers(parts, ids)
                    parts, ids, size, n = [], [], 0, 0
        if parts:
            yield from answers(parts, ids)

    return run

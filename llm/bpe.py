"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

The vocabulary file is given by path and read once per Python worker. A text is
cut at added special strings, then by the byte-level pattern into words.
Each word is a contiguous array of parts with the merge rank of every adjacent pair
beside it; the lowest rank is found by scanning the array, the boundary inside that
pair is deleted, and the ranks left and right of it are looked up anew. The new
words of a batch take these steps together, a row each. Runs over ``LONG_WORD`` bytes, where a
scan per merge would cost the square of the length, keep their pairs in a heap and their
parts in a linked array instead; the merges are the same.

A text whose white space is single blanks and newlines is cut at those, which
gives pieces that the pattern never crosses; a piece's ids are remembered, so the
pattern and the merges run once per distinct piece. Any other text goes through
the pattern whole. Both give the same ids.

Null and empty texts give no ids and decode to the empty text. Repeated rows are
kept, one result per row; other columns of the input are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm import textkit
from llm.staging import by_bytes

#: The byte-level pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of a word from which on it is merged by a heap.
LONG_WORD = 128
#: Pieces and words remembered per worker before either memory starts anew.
MEMORY_PIECES = 100_000
#: Cells of the arrays in which words are merged together.
ROW_CELLS = 1 << 19
#: Text bytes per batch handed back to Spark.
BATCH_BYTES = 1 << 20

_NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + n)] = b
    return out


class Vocabulary:
    """Token bytes, merge ranks and added strings of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = data["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items() if t not in self.added}
        self.bytes = dict.fromkeys(range(max([*vocab.values(), *self.added.values()]) + 1), b"")
        self.bytes |= {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left, right = ([self.ids[raw(m[k])] for m in pairs] for k in (0, 1))
        keys = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        #: Merges by pair of ids: the sorted pairs, the rank of each, and the id a rank makes.
        self.pairs, self.pair_ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.ids[raw(m[0]) + raw(m[1])] for m in pairs], dtype=np.int64)
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.by_word: dict[str, bytes] = {}
        self.by_piece: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, or the highest number; a negative id has no partner."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words, each a row of part ids with the ranks of adjacent parts beside it.

        Rows of about one length go together: every step takes the lowest rank of
        each row (the leftmost of equals), deletes the boundary inside that pair and
        refreshes the ranks to its left and right.
        """
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        low = 0
        for n in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[n] = self._merge_long(words[n])
        for width in (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, LONG_WORD):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = max(low, width)
            step = max(1, ROW_CELLS // max(width, 1))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                for n, packed in zip(some.tolist(), self._merge_rows([words[n] for n in some.tolist()], sizes[some])):
                    out[n] = packed
        return out

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        width = int(sizes.max())
        flat = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        cols = np.arange(width)
        parts = np.full((len(words), width + 1), -1, dtype=np.int64)
        parts[:, :width][cols < sizes[:, None]] = flat
        ranks = np.full((len(words), width + 1), _NONE, dtype=np.int64)
        ranks[:, :width] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), width)
        live = np.arange(len(words))
        done = np.full((len(words), width), -1, dtype=np.int64)
        p, r = parts, ranks
        while True:
            at = r.argmin(axis=1)
            best = r[np.arange(len(at)), at]
            more = best != _NONE
            if not more.all():
                done[live[~more]] = p[~more, :width]
                live, p, r, at, best = live[more], p[more], r[more], at[more], best[more]
            if not len(live):
                break
            row = np.arange(len(live))
            source = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > at[:, None]), width)
            p = np.take_along_axis(p, source, axis=1)
            r = np.take_along_axis(r, source, axis=1)
            p[:, width], r[:, width] = -1, _NONE
            p[row, at] = self.made[best]
            r[row, at] = self.rank(p[row, at], p[row, np.minimum(at + 1, width)])
            has = at > 0
            before = at[has] - 1
            r[row[has], before] = self.rank(p[row[has], before], p[row[has], at[has]])
        kept = done >= 0
        ends = kept.sum(axis=1).cumsum() * 4
        packed = done[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @functools.cached_property
    def by_pair(self) -> dict[int, int]:
        """Merge rank of each pair of ids."""
        return dict(zip(self.pairs.tolist(), self.pair_ranks.tolist()))

    def _merge_long(self, word: bytes) -> bytes:
        """Packed ids of one long word: the lowest rank, leftmost of equals, comes from a heap."""
        parts = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        end = len(parts)
        ranks = self.rank(parts[:-1], parts[1:])
        at = np.flatnonzero(ranks != _NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist()))
        heapq.heapify(heap)
        now, parts, made, rank_of = ranks.tolist() + [_NONE], parts.tolist(), self.made.tolist(), self.by_pair
        following, before = list(range(1, end + 1)), list(range(-1, end))
        while heap:
            rank, k = heapq.heappop(heap)
            if now[k] != rank:  # the pair is gone
                continue
            gone = following[k]
            parts[k], parts[gone], now[gone] = made[rank], -1, _NONE
            nxt = following[k] = following[gone]
            before[nxt] = k
            now[k] = rank_of.get(parts[k] << 32 | parts[nxt], _NONE) if nxt < end else _NONE
            if now[k] != _NONE:
                heapq.heappush(heap, (now[k], k))
            if (p := before[k]) >= 0:
                now[p] = rank_of.get(parts[p] << 32 | parts[k], _NONE)
                if now[p] != _NONE:
                    heapq.heappush(heap, (now[p], p))
        ids = np.array(parts, dtype=np.int64)
        return ids[ids >= 0].astype("<u4").tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Remembers the packed ids of words not seen before."""
        new = list(set(words) - self.by_word.keys())
        if len(self.by_word) + len(new) > MEMORY_PIECES:
            self.by_word = {w: self.by_word[w] for w in set(words) & self.by_word.keys()}
        self.by_word |= zip(new, self.merge([w.encode() for w in new]))

    def learn_pieces(self, pieces: set[str]) -> None:
        """Remembers the packed ids of pieces: each stands after a blank, or starts with the newline it stands after."""
        new = list(pieces - self.by_piece.keys())
        if len(self.by_piece) + len(new) > MEMORY_PIECES:
            self.by_piece = {w: self.by_piece[w] for w in pieces & self.by_piece.keys()}
        if not new:
            return
        # the pattern always cuts between pieces, so all are read as one text and told apart by length
        whole = [p if p[:1] == "\n" else " " + p for p in new]
        words = self.words.findall("".join(whole))
        self.learn_words(words)
        get, at, out = self.by_word, 0, []
        for p in whole:
            room, first = len(p), at
            while room:
                room -= len(words[at])
                at += 1
            out.append(get[words[first]] if at == first + 1 else b"".join([get[w] for w in words[first:at]]))
        self.by_piece |= zip(new, out)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        runs: list[tuple[int, str]] = []  # the text's number, and a run of it without added strings, or an added string
        for n, t in enumerate(texts):
            if self.cut is not None and any(s in t for s in self.added):
                runs += [(n, p) for p in self.cut.split(t) if p]
            elif t:
                runs.append((n, t))
        heads: list[str] = []
        read: list[tuple[int, list[str] | bytes, list[str]]] = []  # words or ids at the start, then pieces
        for n, t in runs:
            if t in self.added:
                read.append((n, self.added[t].to_bytes(4, "little"), []))
                continue
            flat = t.replace("\n", " ")
            if " ".join(flat.split()) == flat:
                first, *rest = t.replace("\n", " \n").split(" ")
                read.append((n, self.words.findall(first), rest))
            else:
                read.append((n, self.words.findall(t), []))
            heads += read[-1][1]
        self.learn_pieces({p for _, _, pieces in read for p in pieces})
        self.learn_words(heads)
        out: list[list[bytes]] = [[] for _ in texts]
        for n, head, pieces in read:
            out[n] += [head] if isinstance(head, bytes) else map(self.by_word.__getitem__, head)
            out[n] += map(self.by_piece.__getitem__, pieces)
        return [b"".join(x) for x in out]

    def unpack(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", errors="replace")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path, read once per Python process."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``.

    A map over the rows without a shuffle. Null and empty texts give empty ids, 0
    and ''. ``decoded`` is made from ``ids`` alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in textkit.slices(texts, BATCH_BYTES):
                packed = v.packed([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(packed, pa.binary()),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([v.unpack(p) for p in packed], pa.string()),
                    ],
                    ["id", "ids", "n_tokens", "decoded"],
                )
        v.by_word, v.by_piece = {}, {}  # the worker may serve other operators next

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = chosen.mapInArrow(textkit.tidy(run), f"id {kind}, ids binary, n_tokens bigint, decoded string")
    return out.withColumnRenamed("id", id_col)

"""Token counts of whole texts by overlapping chunks that are spliced where they provably agree.

Counts are those of a tokenizer file of the tokenizers library with a byte-level
pattern, without special tokens added; added strings inside texts count as the
library counts them.

A text is encoded in overlapping chunks of ``CHUNK_CHARS`` characters with offsets (a text that fits one
chunk is that chunk). The pattern reads left to right and looks ahead by ``AHEAD`` characters at
most, so a word boundary of a chunk holds for the whole text if the chunk's reading began at
a true boundary and so many characters of the chunk follow the boundary. The next chunk begins
anywhere; from the first word boundary that both chunks name inside their overlap, both read
the same text from the same state, and the rest of the next chunk is the whole text's
reading. The text is spliced there. If the two name no common boundary, the next
chunk starts further left (the overlap doubles) until they do, at worst at the
last splice, which is true by itself. A chunk never ends inside an added string.

A stretch without a common boundary is encoded anew from the last splice, twice as far each time, so that a run of
any length is encoded a bounded number of times. Texts of one chunk are encoded together, longer ones chunk by chunk,
of which only the last is kept.

A chunk is encoded by words: the library's byte-level pattern is run by the ``regex`` package, and the library encodes
each distinct word once, as it merges within words only. Characters that the two patterns read in different ways (the packages' Unicode
versions differ) are found by asking both for each character when it is first met; a stretch with one is cut by the library.
"""

from __future__ import annotations

import functools
import json
import os
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm import textkit
from llm.bpe import PATTERN
from llm.staging import by_bytes

#: Characters of a chunk, and of the first overlap of two chunks.
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 128
#: Characters of short texts that are encoded together.
GROUP_CHARS = 1 << 17
#: Characters of the words that a worker remembers, and what a word counts besides its own, before the memory starts anew.
MEMORY_CHARS = 1 << 25
WORD_CHARS = 64
#: Characters that the pattern reads to end a word (a contraction's).
AHEAD = 3
BATCH_BYTES = 1 << 20


class Chunk:
    """One encoded stretch of a text: where its words begin, and the tokens before each."""

    def __init__(self, start: int, end: int, words: list[str], counts: list[int]):
        self.start, self.end = start, end
        self.words, self.sums = list(accumulate(map(len, words), initial=start)), list(accumulate(counts, initial=0))
        self.tokens = self.sums[-1]

    def before(self, at: int) -> int | None:
        """Tokens of the chunk before a character of the text, if a word begins there."""
        k = bisect_left(self.words, at, 0, len(self.words) - 1)
        return self.sums[k] if self.words[k] == at else None

    def last_word(self) -> int:
        """First character of the chunk's last word, which may go on beyond the chunk."""
        return self.words[-2]


class Counter:
    """Counts of one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.chunk, self.overlap = chunk, overlap
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        plain = data["normalizer"] is None and data["pre_tokenizer"]["type"] == "ByteLevel" and not data["pre_tokenizer"]["add_prefix_space"]
        if not plain or any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: words can't be counted apart")
        self.added = [t["content"] for t in data["added_tokens"]]
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.by_word: dict[str, int] = {}
        self.held = 0
        #: Characters met so far, and those that the library's pattern reads in another way (its Unicode is older).
        self.met, self.odd = set(), set()
        self._meet({chr(n) for n in range(128)})
        #: Texts counted by more than one chunk, and overlaps that had to be widened.
        self.spliced = self.widened = 0

    def _meet(self, chars: set[str]) -> None:
        for c in chars - self.met:
            probe = f"a{c}1{c}!{c} {c}"
            if [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] != [m.span() for m in self.pattern.finditer(probe)]:
                self.odd.add(c)
        self.met |= chars

    def _words(self, text: str) -> list[str]:
        """The words of a stretch, added strings among them, as the library's pattern gives them."""
        if not text.isascii():
            self._meet(set(text))
        out: list[str] = []
        for n, run in enumerate(self.cut.split(text) if self.cut is not None else [text]):
            if n % 2:
                out.append(run)
            elif self.odd.isdisjoint(run):
                out += self.pattern.findall(run)
            else:
                out += [run[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(run)]
        return out

    def _learn(self, words: set[str]) -> None:
        """Has the library encode the words that are not remembered."""
        new = [w for w in words if w not in self.by_word]
        self.held += sum(map(len, new)) + WORD_CHARS * len(new)
        if self.held > MEMORY_CHARS:
            self.by_word = {w: self.by_word[w] for w in words if w in self.by_word}
            self.held = sum(map(len, words)) + WORD_CHARS * len(words)
        self.by_word |= zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)))

    def counts(self, texts: list[str]) -> list[int]:
        """The token count of each text."""
        out, held, chars = [0] * len(texts), [], 0
        for n, text in enumerate(texts):
            if len(text) > self.chunk + self.overlap:
                out[n] = self._long(text)
                continue
            held.append(n)
            chars += len(text)
            if chars >= GROUP_CHARS:
                self._short(texts, held, out)
                held, chars = [], 0
        self._short(texts, held, out)
        return out

    def _short(self, texts: list[str], numbers: list[int], out: list[int]) -> None:
        """Counts of texts that are one chunk each."""
        found = [self._words(texts[n]) for n in numbers]
        self._learn(set().union(*found))
        for n, words in zip(numbers, found):
            out[n] = sum(map(self.by_word.__getitem__, words))

    def _plan(self, text: str, start: int) -> list[tuple[int, int]]:
        """Start and end of the next chunks; each ends ``overlap`` characters after the next one's start."""
        out = []
        for _ in range(max(1, GROUP_CHARS // self.chunk)):
            end = self._end(text, start, min(len(text), start + self.chunk + self.overlap))
            out.append((start, end))
            if end == len(text):
                break
            start = max(start + 1, end - self.overlap)
        return out

    def _end(self, text: str, start: int, end: int) -> int:
        """``end``, or where an added string ends that would be cut there."""
        for s in self.added:
            for k in range(1, len(s)):
                if end - k >= start and text.startswith(s, end - k):
                    return self._end(text, start, end - k + len(s))
        return end

    def _encoded(self, text: str, start: int, end: int) -> Chunk:
        """A stretch encoded anew."""
        return self._chunk(text, start, end)

    def _chunk(self, text: str, start: int, end: int) -> Chunk:
        words = self._words(text[start:end])
        self._learn(set(words))
        return Chunk(start, end, words, list(map(self.by_word.__getitem__, words)))

    def _long(self, text: str) -> int:
        """The count of a text of several chunks."""
        self.spliced += 1
        now, total, splice, done = None, 0, 0, 0  # splice: a true boundary up to which all is counted; done: tokens of the chunk before it
        while now is None or now.end < len(text):
            plan = self._plan(text, 0 if now is None else max(now.start + 1, now.end - self.overlap))
            for a, b in plan:
                if now is None:
                    now = self._chunk(text, a, b)
                    continue
                if b <= now.end:
                    continue
                nxt, overlap = self._chunk(text, a, b), self.overlap
                while (common := self._common(now, nxt, splice)) is None:
                    self.widened += 1
                    overlap *= 2
                    start = max(splice, a - overlap)
                    end = b if start > splice else self._end(text, start, min(len(text), start + 2 * (b - start)))
                    nxt = self._encoded(text, start, end)
                at, mine, its = common
                total += mine - done
                splice, done, now = at, its, nxt
        return total + now.tokens - done

    @staticmethod
    def _common(now: Chunk, nxt: Chunk, splice: int) -> tuple[int, int, int] | None:
        """A boundary that both chunks name and the chunk before proves, with the tokens before it in each."""
        if nxt.start == splice:  # true by itself
            return splice, now.before(splice), 0
        for at in range(max(nxt.start, splice), min(now.end - AHEAD, now.last_word()) + 1):
            if (its := nxt.before(at)) is not None and (at > nxt.start) and (mine := now.before(at)) is not None:
                return at, mine, its
        return None


@functools.cache
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """The counter of a file, made once per Python process."""
    return Counter(path, chunk, overlap)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """One row per input row: its id, ``n_bytes`` (UTF-8) and ``n_tokens``; null and empty texts have 0 of both.

    A map over the rows without a shuffle; repeated rows are kept and other columns ignored;
    an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, chunk, overlap)
        for batch in batches:
            for lo, hi in textkit.slices(batch.column(1), BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                _, off = textkit.raw(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(c.counts(texts), pa.int64())],
                    ["id", "n_bytes", "n_tokens"],
                )

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(textkit.tidy(run), f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)

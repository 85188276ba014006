"""Secrets in texts: fixed patterns, and stretches of high entropy in sliding windows, less what an allow-list explains.

The fixed kinds are ``assign`` (a value given to a name such as password or api_key), ``access`` (access key ids) and ``hex``
(long runs of hexadecimal digits). The method adds, for each character class, the union of all windows of
``Kind.window`` characters of that class, with a digit and a letter in them, whose Shannon entropy reaches ``Kind.bits``.
An added span is left out if it lies inside a fixed one or if the allow-list explains it: an address, a digest or
identifier with its usual mark, a run of the alphabet, a given string. Fixed spans always stay.

Windows are scored by counts kept up incrementally: with c(k) the number of a symbol in its window, the sum of c * log2(c)
changes by g(c) - g(c - 1) as a character enters and by the opposite as one leaves. The changes are integers (g is scaled), so a
running sum gives every window's entropy exactly, over all candidates of a block at once, and a block's place
makes no difference. Texts are scanned as UTF-8 bytes in blocks that overlap by a window less one; offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import textkit
from llm.staging import by_bytes

#: The patterns of the fixed kinds (letters of the names in either case) and the characters that a match must have.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
#: An access key id of 20 characters or more, and hexadecimal runs of 24 or more: shorter runs can't match, as each is taken whole.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
FIXED = ("assign", "access", "hex")

#: Bytes of a block of a text.
BLOCK = 1 << 18
#: Bytes before and after a span in which the allow-list looks.
CONTEXT = 256
SCALE = 1 << 20


@dataclass(frozen=True)
class Kind:
    """A character class with its window and the least entropy of a window in bits a character."""

    name: str
    symbols: bytes
    window: int
    bits: float


_DIGITS, _LOWER, _UPPER = bytes(range(48, 58)), bytes(range(97, 123)), bytes(range(65, 91))
#: A random string of 16 symbols has about 3.1 bits in 20 characters, one of 64 about 4.0; words have 3.5 at most and no digits.
KINDS = (Kind("entropy_hex", _DIGITS + b"abcdefABCDEF", 20, 2.75), Kind("entropy_base64", _DIGITS + _LOWER + _UPPER + b"+/_-", 20, 3.7))
#: What explains a string: addresses, digests with their names, universal identifiers, data addresses' heads, examples.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        rb"(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+",
        rb"(?i)\b(?:www\.|mailto:|data:)[^\s\"'<>]+",
        rb"(?i)\b(?:sha-?(?:1|224|256|384|512)|md5|blake2b?|crc32|integrity|checksum|etag|commit|revision)[\"']?\x20?[-:=]\x20?[\"']?[A-Za-z0-9+/=_-]+",
        rb"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
        rb"(?i)[A-Za-z0-9+/=_-]*(?:example|placeholder|changeme|dummy|sample)[A-Za-z0-9+/=_-]*",
    )
)


class Scanner:
    """Tables of the kinds, made once a process."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS, allowed: tuple[re.Pattern, ...] = ALLOWED, strings: tuple[str, ...] = (), block: int = BLOCK):
        self.kinds, self.allowed, self.block = kinds, allowed, block
        self.strings = {s.encode() for s in strings}
        self.order = {k: n for n, k in enumerate((*FIXED, *(k.name for k in kinds)))}
        self.tables = []
        for k in kinds:
            member = np.full(256, -1, dtype=np.int64)
            member[list(k.symbols)] = np.arange(len(k.symbols))
            c = np.arange(k.window + 1)
            g = np.rint(c * np.log2(np.maximum(c, 1)) * SCALE).astype(np.int64)
            # H = log2(w) - sum(c * log2(c)) / w: the greatest sum that still reaches the bits
            most = int(g[k.window]) - int(np.ceil(k.bits * k.window * SCALE))
            self.tables.append((k, member, np.diff(g, prepend=0), most))

    @staticmethod
    def sums(symbols: np.ndarray, width: int, steps: np.ndarray) -> np.ndarray:
        """Scaled sum of c * log2(c) of the window of ``width`` symbols that ends at each place (of what there is, before a first window)."""
        n = len(symbols)
        at = np.arange(n)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = at
        keys = symbols[order] * n + order
        held = rank - np.searchsorted(keys, symbols * n + np.maximum(at - width + 1, 0)) + 1  # of the symbol in the window that it ends
        ahead = np.searchsorted(keys, symbols * n + np.minimum(at + width, n)) - rank  # of the symbol in the window that it begins
        total = np.cumsum(steps[held])
        total[width:] -= np.cumsum(steps[ahead])[: n - width] if n > width else 0
        return total

    def dense(self, data: np.ndarray) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the unions of windows that reach their kind's bits, in bytes of one text."""
        out = []
        for kind, member, steps, most in self.tables:
            w, spans = kind.window, []
            for lo in range(0, max(len(data) - w + 1, 0), self.block):
                part = data[lo : lo + self.block + w - 1]
                inside = member[part] >= 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                begin, end = edge[::2], edge[1::2]
                long = end - begin >= w
                begin, end = begin[long], end[long]
                if not len(begin):
                    continue
                size = end - begin
                first = np.cumsum(size) - size
                place = np.arange(int(size.sum())) + np.repeat(begin - first, size)
                chosen = part[place]
                score = self.sums(member[chosen], w, steps)
                whole = np.arange(len(place)) - np.repeat(first, size) >= w - 1
                digits = np.concatenate([[0], np.cumsum((chosen >= 48) & (chosen < 58))])
                letters = np.concatenate([[0], np.cumsum(((chosen | 32) >= 97) & ((chosen | 32) < 123))])
                last = np.flatnonzero(whole & (score <= most)) + 1
                last = last[(digits[last] > digits[last - w]) & (letters[last] > letters[last - w])]
                for stop in (place[last - 1] + 1 + lo).tolist():
                    if spans and spans[-1][1] >= stop - w:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([stop - w, stop])
            out += [(kind.name, a, b) for a, b in spans]
        return out

    def explained(self, data: np.ndarray, start: int, end: int) -> bool:
        """Whether the allow-list covers a span, or most of its characters follow on each other."""
        span = data[start:end]
        if span.tobytes() in self.strings or (np.diff(span.astype(np.int16)) == 1).mean() >= 0.5:
            return True
        lo = max(0, start - CONTEXT)
        around = data[lo : end + CONTEXT].tobytes()
        return any(m.start() + lo <= start and m.end() + lo >= end for p in self.allowed for m in p.finditer(around))

    def scan(self, data: np.ndarray) -> list[tuple[str, int, int]]:
        """(kind, start, end) of a text's secrets in code points, by start, then kind."""
        view = memoryview(data)
        fixed = [("assign", *m.span()) for m in ASSIGN.finditer(view) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        fixed += [("access", *m.span()) for m in ACCESS.finditer(view)] + [("hex", *m.span()) for m in HEX.finditer(view)]
        reach = sorted((a, b) for _, a, b in fixed)
        furthest = np.maximum.accumulate([b for _, b in reach]) if reach else np.zeros(0, dtype=np.int64)
        starts = np.array([a for a, _ in reach], dtype=np.int64)
        added = []
        for kind, a, b in self.dense(data):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            if (k < 0 or furthest[k] < b) and not self.explained(data, a, b):
                added.append((kind, a, b))
        found = sorted(fixed + added, key=lambda s: (s[1], self.order[s[0]], s[2]))
        points, seen, before = {}, 0, 0
        for at in sorted({p for _, a, b in found for p in (a, b)}):
            seen += int(np.count_nonzero((data[before:at] & 0xC0) != 0x80))
            points[at], before = seen, at
        return [(kind, points[a], points[b]) for kind, a, b in found]


SPAN = "struct<kind:string,start:int,end:int>"


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, strings: tuple[str, ...] = (), block: int = BLOCK
) -> DataFrame:
    """(id, spans) of every row: an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    A map without a shuffle over whole texts, as their UTF-8 bytes. Null and empty texts have no spans; repeated rows are
    kept; an empty table gives an empty result; other columns are ignored. ``strings`` are allowed as they stand.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    by_bytes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds, strings=strings, block=block)
        for batch in batches:
            out = []
            for lo, hi in textkit.slices(batch.column(1)):
                data, off = textkit.raw(batch.column(1).slice(lo, hi - lo))
                out += [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.scan(data[a:b])] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            made = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["id", "spans"])

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(textkit.tidy(run), f"id {kind}, spans array<{SPAN}>").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, spans: str = "spans", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of column ``spans`` replaced in the text; spans that touch or overlap share one mark."""
    merged = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"]))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    made = F.aggregate(
        merged,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("text"), s["end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, F.char_length(text_col))),
    )
    return docs.withColumn(text_col, made)

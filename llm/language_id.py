"""Language ID by unigram pieces, summed over all segmentations of each word.

A fixed public vocabulary gives the pieces. Each language has a probability per
piece, learned by expectation maximisation from a bounded sample of labelled texts. A
word's probability in a language is the sum over all ways to cut it into pieces,
which the forward algorithm adds up from left to right; a text's is the product over
its words. The prediction is the language of the largest probability, the score its
share among the languages.

Words are runs of letters in lower case, of any length, with the vocabulary's mark for a
word's start in front. All pieces that a word can hold take part; pieces with other
characters occur in no word and change no sum. Letters that are no piece count as one
unknown piece each. Sums are scaled on the way, so long words neither vanish nor tie.

A null text, or one without a letter, is ``und`` with score 0, as is every text if no
language could be learned. Ties go to the first language in order. Repeated rows are
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import textkit
from llm.sampling import bounded, held_out
from llm.staging import by_bytes, staged

#: Labelled documents per language to learn from, at most about so many.
LEARN_DOCS = 1_000
#: Rounds of expectation maximisation.
ROUNDS = 2
SMOOTHING = 0.1
#: Probability of a letter that is no piece.
UNKNOWN = 1e-9
#: Positions after which sums are scaled; in so many, none can vanish.
RESCALE = 16
#: Letters of the words that a worker remembers before its memory starts anew.
MEMORY_LETTERS = 1_000_000
#: Cells of the arrays in which words are cut together, and bytes of text taken at a time.
CELLS = 1 << 19
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"

_LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text that the model reads."""
    return _LETTERS.findall(text.lower())


@functools.cache
def pieces(path: str) -> dict[str, int]:
    """The pieces of a sentencepiece vocabulary that words can hold, numbered."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    mark = "▁"
    keep = [x for x in found if x == x.lower() and x != mark and regex.fullmatch(rf"{mark}?\p{{L}}+", x)]
    return {x: n for n, x in enumerate(sorted(set(keep)))}


class Lattice:
    """Looks up the pieces inside many words at once."""

    def __init__(self, vocabulary: dict[str, int]):
        self.size = len(vocabulary)
        keys = np.array([self._key(x) for x in vocabulary], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(vocabulary.values()))[order]
        self.longest = max(map(len, vocabulary), default=1)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    def edges(self, words: list[str]) -> np.ndarray:
        """[word, start, length - 1] -> piece id, size + 1 where there is none, size for an unknown letter; words of one length."""
        n, width = len(words), len(words[0]) + 1
        code = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(n, width).astype(np.uint64) + np.uint64(1)
        out = np.full((n, width, min(self.longest, width)), self.size + 1, dtype=np.int64)
        h = np.zeros((n, width), dtype=np.uint64)
        for k in range(out.shape[2]):
            h = h[:, : width - k] * _BASE + code[:, k:]
            at = np.searchsorted(self.keys, h.ravel())
            at[at == len(self.keys)] = 0
            out[:, : width - k, k] = np.where(self.keys[at] == h.ravel(), self.ids[at], self.size + 1).reshape(h.shape)
        single = out[:, :, 0]
        single[single == self.size + 1] = self.size
        return out


def forward(edges: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[word, language]: log of the sum over all segmentations of each word.

    Every ``RESCALE`` positions the columns still needed are divided by the last one,
    and the divisors' logs added up.
    """
    n, width, longest = edges.shape
    alpha, log = np.zeros((width + 1, n, p.shape[1])), np.zeros((n, p.shape[1]))
    alpha[0] = 1
    for end in range(1, width + 1):
        for k in range(min(longest, end)):
            alpha[end] += alpha[end - 1 - k] * p[edges[:, end - 1 - k, k]]
        if end % RESCALE == 0:
            scale = alpha[end].copy()
            alpha[max(0, end - longest + 1) : end + 1] /= scale
            log += np.log(scale)
    return np.log(alpha[width]) + log


def expected(edges: np.ndarray, p: np.ndarray, language: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, pieces and expected uses, over all segmentations of words with counts ``n``."""
    count, width, longest = edges.shape
    weight = np.log(np.maximum(p, 1e-300))[edges, language[:, None, None]]
    weight[edges == p.shape[0] - 1] = -np.inf
    alpha, beta = np.full((width + 1, count), -np.inf), np.full((width + 1, count), -np.inf)
    alpha[0] = beta[width] = 0
    for end in range(1, width + 1):
        for k in range(min(longest, end)):
            alpha[end] = np.logaddexp(alpha[end], alpha[end - 1 - k] + weight[:, end - 1 - k, k])
    for start in range(width - 1, -1, -1):
        for k in range(min(longest, width - start)):
            beta[start] = np.logaddexp(beta[start], weight[:, start, k] + beta[start + k + 1])
    uses = np.zeros_like(weight)
    for k in range(longest):
        m = width - k
        uses[:, :m, k] = np.exp(alpha[:m].T + weight[:, :m, k] + beta[k + 1 :].T - alpha[width][:, None])
    uses *= n[:, None, None]
    lang = np.broadcast_to(language[:, None, None], edges.shape)
    keep = (edges < p.shape[0] - 2) & (uses > 0)
    return lang[keep], edges[keep], uses[keep]


def _by_length(words: list[str], longest: int) -> Iterator[np.ndarray]:
    """Indexes of words of one length, in groups of about ``CELLS`` cells."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes).tolist():
        at, most = np.flatnonzero(sizes == size), max(1, CELLS // ((size + 1) * longest))
        yield from (at[k : k + most] for k in range(0, len(at), most))


def _table(counts: np.ndarray) -> np.ndarray:
    """[piece, language] probabilities, with the unknown letter and the absent piece as last rows."""
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)
    return np.vstack([p, np.full(p.shape[1], UNKNOWN), np.zeros(p.shape[1])])


class Model:
    """Languages and piece probabilities."""

    def __init__(self, path: str, languages: list[str], table: np.ndarray):
        self.path, self.languages, self.table = path, languages, table

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language] log probabilities."""
        out = np.zeros((len(words), len(self.languages)))
        lattice = _lattice(self.path)
        for at in _by_length(words, lattice.longest):
            out[at] = forward(lattice.edges([words[n] for n in at.tolist()]), self.table)
        return out


@functools.cache
def _lattice(path: str) -> Lattice:
    return Lattice(pieces(path))


def learn(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = LEARN_DOCS) -> Model:
    """Learns piece probabilities per language from rows outside the held-out fold.

    The words of a bounded sample are counted in Spark; each round's expected uses are
    summed there, and only one number per piece and language comes to the driver.
    """
    known = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[label_col].cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    by_bytes(docs.sparkSession)
    words = bounded(known, "lang", "id", per_language).select("lang", "text").mapInArrow(textkit.tidy(split), "lang string, word string")
    words = staged(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    size = len(pieces(path))
    table = _table(np.ones((size, len(languages)))) if languages else np.zeros((size + 2, 0))
    for _ in range(ROUNDS if languages else 0):
        held = words.sparkSession.sparkContext.broadcast(table)

        def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, p = _lattice(path), held.value
            total = np.zeros((len(languages), size))
            number = {x: n for n, x in enumerate(languages)}
            for batch in batches:
                lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
                text, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for at in _by_length(text, lattice.longest):
                    which, piece, use = expected(lattice.edges([text[k] for k in at.tolist()]), p, lang[at], n[at])
                    np.add.at(total, (which, piece), use)
            which, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[which, piece])], ["lang", "piece", "uses"])

        summed = words.mapInArrow(textkit.tidy(uses), "lang bigint, piece bigint, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        counts = np.zeros((size, len(languages)))
        counts[summed["piece"], summed["lang"]] = summed["uses"]
        table = _table(counts)
    return Model(path, languages, table)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score``; a map without a shuffle.

    With ``carry`` the id column is ``row``, a struct of all columns of the input.
    """
    first = F.struct(*(docs[c] for c in docs.columns)) if carry else docs[id_col]
    chosen = docs.select(first.alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    by_bytes(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        number: dict[str, int] = {}
        scores, letters = np.zeros((0, len(m.languages))), 0
        for batch in batches:
            for lo, hi in textkit.slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                words = [words_of(t) if t else [] for t in texts]
                new = list({w for ws in words for w in ws} - number.keys())
                if letters > MEMORY_LETTERS:
                    number, letters = {}, 0
                    new = list({w for ws in words for w in ws})
                have = len(number)
                number |= zip(new, range(have, have + len(new)))
                letters += sum(map(len, new))
                if len(number) > len(scores):
                    scores = np.concatenate([scores[:have], np.zeros((have + 2 * len(new), len(m.languages)))])
                scores[have : len(number)] = m.word_scores(new)
                flat = np.fromiter(map(number.__getitem__, (w for ws in words for w in ws)), dtype=np.int64)
                ends = np.cumsum([0, *map(len, words)])
                lang, share = [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    if a == b or not m.languages:
                        lang.append(UNDETERMINED)
                        share.append(0.0)
                        continue
                    total = scores[flat[a:b]].sum(axis=0)
                    total = np.exp(total - total.max())
                    best = int(total.argmax())
                    lang.append(m.languages[best])
                    share.append(float(total[best] / total.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(share, pa.float64())], ["id", "lang_pred", "score"])

    return chosen.mapInArrow(textkit.tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", "row" if carry else id_col)


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Learns from the labelled rows of ``docs`` and predicts all: id, ``held_out``, ``lang_pred``, ``score``."""
    out = predict(docs, learn(docs, path, id_col, text_col, label_col), id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")

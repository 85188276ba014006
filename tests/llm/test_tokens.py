"""Token counts and BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"aeth ion\n\n  '\t.,!19éß  \x1c\x85日本🎉$", " the", " don't", " we'll", "<|endoftext|>", "<|endof"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def noise(n, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, longest))) for _ in range(n)]


def test_encoding_equals_library(library):
    texts = noise(4000, 60, 1) + ["", " ", "a" * 500, "the\nthe", "\n", "x  y"]
    v = bpe.Vocabulary(PATH)
    for text, packed, known in zip(texts, v.packed(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(packed, "<u4").tolist() == known.ids, text
        assert v.unpack(packed) == library.decode(known.ids, skip_special_tokens=False) == text


def test_invalid_bytes_decode_as_library(library):
    v = bpe.Vocabulary(PATH)
    ids = library.encode("é🎉").ids[:1] + library.encode("abc").ids
    assert v.unpack(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 3)
    v = bpe.Vocabulary(PATH)
    for texts in (["ab cd ef", "gh ij"], ["kl mn op qr"], ["ab gh"]):
        assert [np.frombuffer(p, "<u4").tolist() for p in v.packed(texts)] == [library.encode(t).ids for t in texts]


def test_chunked_counts_equal_library(library):
    c = token_counts.Counter(PATH, chunk=64, overlap=8)
    texts = noise(1500, 700, 2) + ["a" * 1000, " " * 1000, "<|endoftext|>" * 60, "ab " * 400, "\n \n" * 200]
    texts += [a + b for a in ("it", "!", "9 ", "\n") for b in ("'re so" * 60, "'ve'll" * 60, "don't  " * 50)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, got, n in zip(texts, c.counts(texts), want):
        assert got == n, text
    assert c.widened > 0 and c.spliced > 1000
    c = token_counts.Counter(PATH)
    assert c.counts(["the cat's hat, " * 1000, "x" * 9000]) == [len(library.encode(t).ids) for t in ("the cat's hat, " * 1000, "x" * 9000)] and c.spliced == 2


def test_long_runs_equal_library(library):
    r = random.Random(4)
    texts = ["".join(r.choices(a, k=4000)) for a in ("etaoinshrdlu", "的一是不了人我在有他", "ab")] + ["a" * 5000, "!" * 3000]
    v = bpe.Vocabulary(PATH)
    for text, packed in zip(texts, v.packed(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text).ids


def test_frames(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat", None), (3, "the cat", None), (4, "ß " * 50_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counts = sorted(token_counts.token_counts(docs, PATH).collect())
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t, _ in rows)
    assert [tuple(r) for r in counts] == want
    got = bpe.encode_decode(docs, PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in got) == sorted((i, n, t or "") for (i, t, _), (_, _, n) in zip(sorted(rows, key=lambda r: (r[0], r[1] or "")), want))
    assert token_counts.token_counts(docs.limit(0), PATH).count() == bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_runs_without_a_boundary_are_encoded_a_bounded_number_of_times(monkeypatch):
    import random

    from llm.token_counts import Counter

    seen = []

    class Counting(Counter):
        def _encoded(self, text, start, end):
            seen.append(end - start)
            return super()._encoded(text, start, end)

    text = "".join(random.Random(1).choices("abcdefghij", k=60_000))
    for n in (15_000, 60_000):
        seen.clear()
        c = Counting(PATH, 500, 50)
        assert c.counts(["go " + text[:n] + " on"]) == [len(c.tokenizer.encode("go " + text[:n] + " on", add_special_tokens=False))]
        assert c.widened and sum(seen) <= 9 * n


def test_each_word_is_encoded_once(library):
    """Before, the library encoded every word of every text (979 CPU seconds a GB)."""
    c, asked = token_counts.Counter(PATH), []

    class Asked:
        pre_tokenizer = c.tokenizer.pre_tokenizer

        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return library.encode_batch_fast(words, **options)

    c.tokenizer = Asked()
    texts = ["the cat's hat, " * 20, "the cat's hat " * 2000, "<|endoftext|>a hat"]
    assert c.counts(texts) == [len(library.encode(t).ids) for t in texts]
    assert c.spliced == 1 and len(asked) == len(set(asked)) < 30


def test_newer_characters_and_small_memory(monkeypatch, library):
    """Letters that the library's Unicode doesn't know are cut as the library does; the words' memory starts anew."""
    monkeypatch.setattr(token_counts, "MEMORY_CHARS", 500)
    odd = "".join(map(chr, (0x558, 0x58B, 0x88F, 0x323B0, 0x11DE0, 0x10940)))
    texts = [f"a{c}b 1{c}2 !{c}" for c in odd] + [f"go {odd} on{odd[0]}é 日本 " * n for n in (1, 9, 900)] + noise(200, 300, 5)
    c = token_counts.Counter(PATH, chunk=64, overlap=8)
    assert c.counts(texts) == [len(library.encode(t).ids) for t in texts]
    assert set(odd) <= c.met and c.odd and c.odd <= set(odd)

"""Rows of the registered queries without SQL: the whole tables' rows, and tokens by the library."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.queries import BYTE_BPE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_tokens_by_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    counts, digests = [], []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        counts.append((r.doc_id, len((r.text or "").encode()), len(ids), len(ids) > 512))
        digests.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    got = QUERIES["op2_token_counts"](spark, DATA).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got)) == sorted(counts)
    got = QUERIES["op7_bpe_round_trip"](spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(digests)


@pytest.mark.parametrize("name, of, key", [("op5_quality_classifier", "documents", ["doc_id"]), ("op10_language_id", "documents", ["doc_id"]), ("op8_chat_quotation", "conversations", ["conv_id", "turn", "role"])])
def test_one_row_each(spark, name, of, key):
    known = spark.read.parquet(f"{DATA}/{of}.parquet").select(*key).collect()
    assert sorted(map(tuple, QUERIES[name](spark, DATA).select(*key).collect())) == sorted(map(tuple, known))

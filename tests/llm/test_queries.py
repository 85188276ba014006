"""The operators' registered queries against their SQL, and their contracts' columns."""

import os

import pytest

from llm.queries import ORACLES, QUERIES
from tests.against_sql import connect, rows_of, sql_rows

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_shingles component_id",
    "op2": "doc_id n_bytes n_tokens over_limit",
    "op4": "page_id payload_bytes payload_digest record_type refers_to",
    "op5": "doc_id held_out score predicted",
    "op6": "doc_id n_words n_removed kept_sha256",
    "op7": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10": "doc_id held_out lang_pred score",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    columns, rows = rows_of(QUERIES[name](spark, DATA))
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(columns)
    if name in ORACLES:
        known_columns, known = sql_rows(connect(DATA), ORACLES[name])
        assert columns == known_columns and rows == known

"""From raw documents to token ids: language, near copies, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of ``docs``; the last returns token ids. Stages work on all rows that the one
before kept; :func:`run` writes each stage's rows and reads them again.

In every stage null values of other columns, repeated rows and columns of any name go through as they are, texts of any
length are read whole, and an empty table gives an empty table with the same columns. Null and empty texts have no language, so the first
stage drops them; a null id is no one's copy and owns no passage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, decontamination, language_id, ngram_join, substring_dedup
from llm.staging import sized, staged

#: Share of the predicted language among all below which a text has no clear language.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a predicted language; null texts, texts without letters and those without a clear language go."""
    model = language_id.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = language_id.predict(docs, model, carry=True)
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more), with all of its repeated rows."""
    groups = ngram_join.similarity_classes(docs, n=5, percent=80, lower=True)
    gone = sized(staged(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, without its 50-word windows that one with a smaller id has; rows that share an id keep what they share."""
    found = substring_dedup.remove_repeats(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*(columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; all of them, if the benchmark is empty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = sized(staged(decontamination.contaminated(docs, benchmark).select("doc_id").distinct(), "leaks"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit) and their number; a null text has none."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", known_language),
    ("near_copies", first_of_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_leaks),
    ("bpe", token_ids),
]

#: Language ID and tokenisation have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = staged(docs, name)
    return docs

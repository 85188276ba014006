"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.staging import sized, staged


def held_out(id_col: str) -> Column:
    """True for the fold that no learning may read: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded(rows: DataFrame, label: str, id_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label (all, if there are fewer), chosen by a hash of the id.

    The share kept of a label follows from its count, so the sample's size is bounded
    however large the table is; counts join back by label, and none comes to the driver.
    Rows without a label are left out.
    """
    counts = sized(staged(rows.groupBy(label).agg(F.count("*").alias("_n")), "labels"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30))
    return rows.join(counts, label).filter(draw * F.col("_n") < F.lit((1 << 30) * per_label)).select(rows.columns)

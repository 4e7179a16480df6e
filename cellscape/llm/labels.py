"""Labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no fit may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label (0 or 1) of all labelled ids that are not held out; NULL ids and labels are left out."""
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", F.col(label).cast("int").alias("label")).distinct()

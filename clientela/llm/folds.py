"""Held-out documents: one in five, by the checksum of the id as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether models must not learn from a document; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))

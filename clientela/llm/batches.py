"""Helpers: slices of Arrow batches, new names, values computed once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 1 << 20


def text_chunks(batch: pa.RecordBatch | pa.Table, column: str, size: int = CHUNK_BYTES) -> Iterator:
    """Slices of ``batch`` with about ``size`` bytes of text, one row at least.

    What a function builds for a slice is then bounded by ``size`` or by the
    longest text, whatever the size of Spark's batches.
    """
    lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy()
    start = filled = 0
    for row, length in enumerate(lengths):
        if row > start and filled + length > size:
            yield batch.slice(start, row - start)
            start, filled = row, 0
        filled += int(length)
    if start < len(lengths):
        yield batch.slice(start)


def texts_of(rows: pa.RecordBatch | pa.Table, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column, empty for null."""
    return [text or b"" for text in rows[column].cast(pa.binary()).to_pylist()]


def as_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [pa.array(c, type=field.type) for c, field in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to be new in ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used.

    A lambda that names a column may see its definition instead, once the
    optimiser has moved it, and compute it anew for every element.
    """
    return F.element_at(F.transform(F.array(value), then), 1)

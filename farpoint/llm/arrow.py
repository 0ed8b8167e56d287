"""Arrow batches in tasks: columns as Python or NumPy values, and rows regrouped by a sorted key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL counts as the empty text."""
    large = pa.types.is_large_string(column.type)
    raw = column.cast(pa.large_binary() if large else pa.binary())
    return [b"" if value is None else value for value in raw.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that few long texts are unpacked at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``work`` to slices of Arrow batches; the output is bounded by what one slice gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield work(batch)

    return df.mapInArrow(run, schema)


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of consecutive rows, cut only where the key changes; the input is sorted by ``key``.

    Each piece has about ``rows`` rows, or one key's rows if those are more.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        return {name: table.column(name).to_numpy() for name in table.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield columns(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
    if held:
        yield columns(pa.Table.from_batches(held))

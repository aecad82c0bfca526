"""Columns computed from Arrow batches, a few hundred rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROWS_PER_BATCH = 256
BYTES_PER_BATCH = 1 << 20


def small_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most 256 rows and about a megabyte of texts, or of one longer row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BYTES_PER_BATCH, side="right")))
        stop = min(stop, start + ROWS_PER_BATCH, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(frame: DataFrame, made: dict[str, T.DataType],
                work: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``frame`` with the columns ``made``, computed by ``work()`` for a few hundred rows at a time, without those of ``drop``."""
    kept = [c for c in frame.columns if c not in made and c not in drop]
    types = {f.name: f for f in frame.schema.fields}
    schema = T.StructType([types[c] for c in kept] + [T.StructField(c, t) for c, t in made.items()])
    names = kept + list(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in small_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + each(part), names=names)

    return frame.mapInArrow(run, schema)

"""Exact counts of all values that make up at least a given share of a corpus, in two map-side passes.

First pass: each task counts what it reads in blocks and names the values that reach half the share within
a block. Every value that reaches the share in the corpus is named, with counts that add up to over half of
it; so at most 2 * (values per unit) / share candidates are left after one small aggregation, however
large the corpus. Second pass: the candidates are counted exactly. Nothing else is shuffled or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .words import Members

BLOCK_VALUES = 1_000_000

#: From the texts of a batch: arrays of values, each with the number of units (documents, words) it covers.
Extract = Callable[[pa.Array], Iterator[tuple[np.ndarray, int]]]


def count_rows(counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    values, numbers = counts
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(numbers.astype(np.int64))],
                                      names=["value", "n"])


def local_counts(texts: DataFrame, make_extract: Callable[[], Extract], share: float) -> DataFrame:
    """``value, n`` of the values that reach half the share in a block of a task; the units at a NULL value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, parts, held, units = make_extract(), [], 0, 0

        def flush() -> pa.RecordBatch:
            values, numbers = np.unique(np.concatenate(parts), return_counts=True)
            enough = numbers >= share / 2 * units
            return pa.RecordBatch.from_arrays([
                pa.array(np.append(values[enough].view(np.int64), 0), mask=np.append(np.zeros(enough.sum(), bool), True)),
                pa.array(np.append(numbers[enough].astype(np.int64), units))], names=["value", "n"])

        for batch in batches:
            for values, covered in extract(batch.column(0)):
                parts.append(values)
                held, units = held + len(values), units + covered
                if held >= BLOCK_VALUES:
                    yield flush()
                    parts, held, units = [], 0, 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "value long, n long")


def member_counts(texts: DataFrame, make_extract: Callable[[], Extract], candidates: np.ndarray) -> DataFrame:
    """``value, n`` of the candidates, one row per value and task."""
    shared = texts.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, members = make_extract(), Members(shared.value)
        numbers = np.zeros(len(members.values), np.int64)
        for batch in batches:
            for values, _ in extract(batch.column(0)):
                numbers += np.bincount(members.find(values)[1], minlength=len(numbers))
        seen = np.flatnonzero(numbers)
        yield count_rows((members.values[seen], numbers[seen]))

    return texts.mapInArrow(run, "value long, n long")


def named_candidates(texts: DataFrame, make_extract: Callable[[], Extract], share: float) -> tuple[np.ndarray, int]:
    """A sorted superset of the frequent values, and the number of units in all texts.

    There are at most ``2 * (values per unit) / share`` of them.
    """
    summed = stage(local_counts(texts, make_extract, share).groupBy("value").agg(F.sum("n").alias("n")))
    units = summed.where("value IS NULL").first()
    units = int(units["n"]) if units else 0
    rows = summed.where(F.col("value").isNotNull() & (F.col("n") >= share / 2 * units)).select("value").toArrow()
    return np.sort(rows["value"].to_numpy().view(np.uint64)), units


def frequent(texts: DataFrame, make_extract: Callable[[], Extract], share: float,
             units: int) -> tuple[np.ndarray, np.ndarray]:
    """The values with a count of at least ``share * units``, sorted, and their exact counts.

    ``texts`` has one text column; ``units`` is the number of units in all of it.
    """
    least = max(1, math.ceil(share * units))
    total = F.sum("n").alias("n")
    named = local_counts(texts, make_extract, share).groupBy("value").agg(total) \
        .where(F.col("value").isNotNull() & (F.col("n") >= share / 2 * units))
    candidates = named.select("value").toArrow()["value"].to_numpy().view(np.uint64)
    if not len(candidates):
        return candidates, np.empty(0, np.int64)
    exact = member_counts(texts, make_extract, np.sort(candidates)).groupBy("value").agg(total).where(F.col("n") >= least)
    rows = exact.toArrow()
    values, numbers = rows["value"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(values)
    return values[order], numbers[order]

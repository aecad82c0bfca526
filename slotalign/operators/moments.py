"""Counts and moments per slot: exact sums made where the samples are, or a grouped aggregation in SQL."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_present, number_array
from .exact import SlotSums, digest, slack_bin


@dataclass(frozen=True)
class SlotMoments:
    """Counts and moments of the S slots, held on the driver.

    ``present`` counts samples whose parameter 0 is there; ``valid`` counts entries that have all
    of the fitted parameters, and the moments are over those. ``scatter`` is the sum of outer
    products of deviations from the mean.
    """

    samples: int
    present: np.ndarray
    valid: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray
    score: float
    layout: int

    def pooled(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Count, mean and scatter over all slots together."""
        count = int(self.valid.sum())
        if count == 0:
            width = self.mean.shape[1]
            return 0, np.full(width, np.nan), np.full((width, width), np.nan)
        filled = self.valid > 0
        weight, mean = self.valid[filled], self.mean[filled]
        centre = weight @ mean / count
        shift = mean - centre
        return count, centre, self.scatter[filled].sum(axis=0) + (shift.T * weight) @ shift


def labelled_entries(frame: DataFrame, num_sources: int, params: Sequence[int]) -> DataFrame:
    """One row per entry: ``sample_id, label, source, score, present`` and the parameters ``v0 ..``.

    ``frame`` is a chain by parameter, with ``labels`` and ``scores`` per entry if it was assigned.
    ``source`` is the slot that holds the entry in ``frame``; without labels it is the label.
    """
    names = sorted({0, *params})
    assigned = [c for c in ("labels", "scores") if c in frame.columns]
    slots = ", ".join(str(s) for s in range(num_sources))
    rows = frame.selectExpr("sample_id", *[f"p{p}" for p in names], *assigned, f"explode(array({slots})) AS source")
    return rows.selectExpr(
        "sample_id",
        f"{'get(labels, source)' if assigned else 'source'} AS label",
        "source",
        f"{'get(scores, source)' if assigned else 'double(NULL)'} AS score",
        "get(p0, source) IS NOT NULL AS present",
        *[f"get(p{p}, source) AS v{i}" for i, p in enumerate(params)],
    )


def moments_by_slot(labelled: DataFrame, centre: np.ndarray) -> DataFrame:
    """Counts, sums and sums of products of the deviations of ``v0 ..`` from ``centre``, per label, as a DataFrame.

    For use in SQL; fits and the loop take exact sums (``measure_entries``). Plain sums keep the aggregation in short compiled code; at most one row per label and task is
    shuffled.
    """
    width = range(centre.shape[1])
    complete = all_present([f"v{i}" for i in width])
    deviations = [f"CASE WHEN {complete} THEN v{i} - get({number_array(centre[:, i])}, label) END AS d{i}"
                  for i in width]
    entry = labelled.selectExpr("sample_id", "label", "source", "score", "present", f"{complete} AS valid",
                                *deviations)
    sums = [f"sum(d{i}) AS s{i}" for i in width]
    products = [f"sum(d{i} * d{j}) AS s{i}_{j}" for i in width for j in width if i <= j]
    return entry.sparkSession.sql(f"""
        SELECT label, count(*) AS samples, count_if(present) AS present, count_if(valid) AS valid,
               sum(score) AS score, {', '.join(sums + products)},
               bit_xor(CASE WHEN valid THEN xxhash64(sample_id, source, label) END) AS layout
        FROM {{entry}} GROUP BY label""", entry=entry)


# States of so many tasks are merged by the driver or one group; more meet in groups first.
FAN_IN = 256


@dataclass
class Layout:
    """What one pass yields: exact sums, and per slot the state of an estimator that looks at the entries."""

    sums: SlotSums
    states: list | None = None

    @cached_property
    def moments(self) -> SlotMoments:
        sums = self.sums
        return SlotMoments(sums.samples, sums.present, sums.valid, *sums.central(), sums.mean_score() * sums.samples, sums.layout)


class EntryState(Protocol):
    """The part of an entry estimator that tasks run."""

    init: Callable[[int], object]
    update: Callable[[object, np.ndarray], object]
    merge: Callable[[object, object], object]


def measure_entries(frame: DataFrame, num_sources: int, params: Sequence[int], matcher: Callable | None = None,
                    matched: Sequence[int] = (), estimator: EntryState | None = None, sum_scores: bool = False,
                    limit: float | None = None, keeps: Callable | None = None, tasks: int | None = None) -> Layout:
    """Match the samples of a chain by parameter, if a ``matcher`` is given, and sum up their entries in one map.

    ``matcher`` takes the ``matched`` parameters of a block of samples (an array of parameters, samples, slots) and returns
    labels, scores and, if it knows them, slacks. Without one, entries count for the slot they are in, or for the labels of
    a written assignment. With a ``limit`` only samples of at most this slack are matched, and the sums are those of their new labels
    less those of the written ones; ``keeps`` tells which of these need no matching. ``frame`` has a row per sample, or packed blocks.
    ``tasks`` is how many read ``frame`` at most, if that is known.
    With an ``estimator`` its states are built instead of products of parameters. States travel as plain arrays and numbers.
    """
    names = [f"p{p}" for p in sorted({0, *params, *matched})]
    block, written = "ids" in frame.columns, "labels" in frame.columns
    extra = WRITTEN if block and written else ()
    at = {name: i for i, name in enumerate(names)}
    order, first = [at[f"p{p}"] for p in params], at["p0"]
    needs = [at[f"p{p}"] for p in matched]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = SlotSums(num_sources, len(order))
        states = [estimator.init(len(order)) for _ in range(num_sources)] if estimator else None
        chosen = None if limit is None else may_move(limit, keeps, needs)
        for samples, cube, labels, slacks in samples_of(batches, names, num_sources, chosen):
            sums.samples += len(samples) if limit is None else 0
            sums.read += len(samples)
            scores, before = None, labels
            if labels is None:
                labels = np.broadcast_to(np.arange(num_sources), cube.shape[1:])
            if matcher:
                labels, scores, slacks = matcher(cube[needs])
            if limit is not None:
                add_moves(sums, states, estimator, samples, cube[order], ~np.isnan(cube[first]), before, labels)
                continue
            add_block(sums, states, estimator, samples, cube[order], ~np.isnan(cube[first]), labels)
            if scores is not None and sum_scores:
                sums.add_scores(scores[~np.isnan(scores)])
            if slacks is not None:
                sums.slacks += np.bincount(slack_bin(slacks), minlength=len(sums.slacks))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([state_of(sums, states)])], names=["task", "state"])

    wanted = frame.select("ids" if block else "sample_id", *names, *extra)
    tasks = wanted.rdd.getNumPartitions() if tasks is None else tasks
    return collect_states(wanted.mapInArrow(run, "task long, state binary"), tasks, num_sources, len(order), estimator)


def state_of(sums: SlotSums, states: list | None = None) -> bytes:
    return pickle.dumps((vars(sums.close()), states))


def collect_states(rows: DataFrame, tasks: int, num_sources: int, num_params: int, estimator: EntryState | None = None) -> Layout:
    """The sum of the ``state`` of every ``task``."""

    def merged(contents: Iterable[bytes]) -> tuple[SlotSums, list | None]:
        total, states = SlotSums(num_sources, num_params), None
        for content in contents:
            sums, other = pickle.loads(content)
            total.merge(SlotSums(**sums))
            states = other if states is None or other is None else [estimator.merge(a, b) for a, b in zip(states, other)]
        if estimator and states is None:
            states = [estimator.init(num_params) for _ in range(num_sources)]
        return total, states

    if tasks > FAN_IN:
        def meet(table: pa.Table) -> pa.Table:
            sums, states = merged(table["state"].to_pylist())
            return pa.table([pa.array([state_of(sums, states)])], names=["state"])

        rows = rows.groupBy((F.col("task") % FAN_IN).alias("branch")).applyInArrow(meet, "state binary")
    return Layout(*merged(row["state"] for row in rows.select("state").collect()))


# Samples of one packed block, and how many are worked on at a time.
PACKED_SAMPLES = 4096
CHUNK_SAMPLES = 16_384


def packed(frame: DataFrame) -> DataFrame:
    """A chain by parameter in blocks of samples: binary ``ids`` and ``p0 ..`` with the numbers of a block one after another.

    The loop reads its samples many times; a block passes from the file to a task's arrays as it is, not number by number.
    """
    names = [c for c in frame.columns if c != "sample_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = pc.fill_null(batch.column("sample_id"), 0).to_numpy(zero_copy_only=False)
                cells = [batch.column(n).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False) for n in names]
                yield pack({"ids": ids} | {n: c.reshape(len(ids), -1) for n, c in zip(names, cells)})

    return frame.select("sample_id", *names).mapInArrow(run, ", ".join(f"{n} binary" for n in ("ids", *names)))


def pack(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Blocks of the rows of ``columns``, each a column of binaries."""
    starts = range(0, len(next(iter(columns.values()))), PACKED_SAMPLES)
    blocks = [pa.array([c[at:at + PACKED_SAMPLES].tobytes() for at in starts], pa.binary()) for c in columns.values()]
    return pa.RecordBatch.from_arrays(blocks, names=list(columns))


def unpack(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """The numbers of all blocks of a batch, not copied."""
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[places[0]:places[-1]].view(kind)


# Further columns of a written layout.
WRITTEN = ("there", "labels", "slack", "prices")


@dataclass
class WrittenBlock:
    """Samples of a written layout: which entries are there, their ``values`` (parameters, entries), labels of all slots, prices (labels, samples)."""

    samples: np.ndarray
    there: np.ndarray
    values: np.ndarray
    labels: np.ndarray
    slack: np.ndarray
    prices: np.ndarray

    @classmethod
    def of(cls, samples: np.ndarray, cube: np.ndarray, labels: np.ndarray, slack: np.ndarray, prices: np.ndarray) -> WrittenBlock:
        there = ~np.isnan(cube).all(axis=0)
        return cls(samples, there, cube[:, there], labels.astype(label_kind(labels.shape[1])), slack, np.ascontiguousarray(prices.T, np.float32))

    def row(self, names: Sequence[str]) -> dict[str, object]:
        values = {name: value.tobytes() for name, value in zip(names, self.values)}
        rest = {name: getattr(self, name).tobytes() for name in WRITTEN}
        return {"ids": self.samples.tobytes()} | values | rest | {"low": float(self.slack.min(initial=np.inf))}

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """The cube (parameters, samples, slots) of the samples that ``rows`` (a truth value each) names."""
        there = self.there[rows]
        cube = np.full((len(self.values), *there.shape), np.nan)
        cube[:, there] = self.values[:, np.repeat(rows, self.there.sum(axis=1))]
        return cube


def label_kind(num_sources: int) -> type:
    """The numbers that labels are written as."""
    return np.int8 if num_sources <= 128 else np.int64


def written_blocks(batch: pa.RecordBatch, names: Sequence[str], num_sources: int) -> Iterator[WrittenBlock]:
    def numbers(name: str, at: int, kind: type) -> np.ndarray:
        return np.frombuffer(batch.column(name)[at].as_buffer(), kind)

    for at in range(batch.num_rows):
        samples = numbers("ids", at, np.int64)
        if not samples.size:
            continue
        yield WrittenBlock(samples, numbers("there", at, np.bool_).reshape(-1, num_sources), np.stack([numbers(n, at, np.float64) for n in names]),
                           numbers("labels", at, label_kind(num_sources)).reshape(-1, num_sources), numbers("slack", at, np.float64),
                           numbers("prices", at, np.float32).reshape(num_sources, -1))


def may_move(limit: float, keeps: Callable | None, needs: Sequence[int]) -> Callable[[WrittenBlock], np.ndarray]:
    """Which samples of a written block may move: those of at most this slack that ``keeps`` does not hold by their prices."""

    def chosen(block: WrittenBlock) -> np.ndarray:
        may = block.slack <= limit
        if keeps is None or not may.any():
            return may
        flat = np.flatnonzero(block.there & may[:, None])
        values = block.values[needs]
        values = values if may.all() else values[:, np.repeat(may, block.there.sum(axis=1))]
        complete = ~np.isnan(values).any(axis=0)
        if not complete.all():
            flat, values = flat[complete], values[:, complete]
        return may & ~keeps(values, flat // block.there.shape[1], block.labels.ravel()[flat], block.prices)

    return chosen


def samples_of(batches: Iterator[pa.RecordBatch], names: Sequence[str], num_sources: int,
               chosen: Callable[[WrittenBlock], np.ndarray] | None = None, size: int = CHUNK_SAMPLES) -> Iterator[tuple]:
    """Ids, a cube (parameters, samples, slots), and labels and slacks of a written layout (else None), of rows or packed blocks.

    Of written blocks the samples that are ``chosen``.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        if "ids" not in batch.schema.names:
            cube, samples = cube_of([batch.column(n) for n in names], num_sources), batch.column("sample_id").to_numpy(zero_copy_only=False)
            yield samples, cube, None, None
            continue
        if "labels" in batch.schema.names:
            for block in written_blocks(batch, names, num_sources):
                rows = np.ones(len(block.samples), bool) if chosen is None else chosen(block)
                if chosen is None or rows.any():
                    yield block.samples[rows], block.dense(rows), block.labels[rows], block.slack[rows]
            continue
        samples, cells = unpack(batch.column("ids"), np.int64), [unpack(batch.column(n)).reshape(-1, num_sources) for n in names]
        for at in range(0, len(samples), size):
            part = slice(at, at + size)
            yield samples[part], np.stack([c[part] for c in cells]), None, None


def cube_of(columns: Sequence[pa.Array], num_sources: int) -> np.ndarray:
    """Lists of a value per slot as (columns, samples, slots); NULL becomes NaN."""
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns]
    return np.stack(flat).reshape(len(columns), -1, num_sources)


def add_block(sums: SlotSums, states: list | None, estimator: EntryState | None, samples: np.ndarray, values: np.ndarray,
              present: np.ndarray, labels: np.ndarray, sign: int = 1) -> None:
    """A block of samples: ``values`` are (parameters, samples, slots), ``present`` and ``labels`` (samples, slots)."""
    sums.present += sign * np.bincount(labels[present], minlength=sums.num_sources)
    row, source = np.nonzero(~np.isnan(values).any(axis=0))
    given = labels[row, source]
    sums.layout ^= digest(samples[row], source, given)
    by_label = np.argsort(given, kind="stable")
    entries, given = np.ascontiguousarray(values[:, row[by_label], source[by_label]].T), given[by_label]
    if estimator is None:
        sums.add_entries(given, entries, sign)
        return
    bounds = np.searchsorted(given, np.arange(sums.num_sources + 1))
    sums.valid += np.diff(bounds)
    for label in range(sums.num_sources):
        states[label] = estimator.update(states[label], entries[bounds[label]:bounds[label + 1]])


def add_moves(sums: SlotSums, states: list | None, estimator: EntryState | None, samples: np.ndarray, values: np.ndarray,
              present: np.ndarray, before: np.ndarray, labels: np.ndarray) -> None:
    """As ``add_block``, less what the samples added under the labels before; only those that moved count."""
    moved = np.flatnonzero((labels != before).any(axis=1))
    for given, sign in ((before, -1), (labels, 1)):
        add_block(sums, states, estimator, samples[moved], values[:, moved], present[moved], given[moved], sign)


def collect_all_values(frame: DataFrame) -> tuple[int, float, float]:
    """Count, mean and ddof-1 deviation of every value of every slot and parameter together."""
    values = [F.col(c) for c in frame.columns if c != "sample_id"]
    value = frame.select(F.explode_outer(F.concat(*values)).alias("value"))
    row = value.agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                    F.stddev_samp("value").alias("std")).first()
    nan = float("nan")
    return row["n"], nan if row["mean"] is None else row["mean"], nan if row["std"] is None else row["std"]

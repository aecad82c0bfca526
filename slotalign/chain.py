"""The chain of posterior samples as a DataFrame handle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import nan_to_null, null_entry
from .storage import number_ids, stage


# Up to so many cells per sample, a chain from long rows is one aggregation.
MAX_PIVOT_CELLS = 128


def slot_numbers(num_sources: int) -> Column:
    return F.array(*[F.lit(s) for s in range(num_sources)])


def param_of_entries(param: int) -> Column:
    return F.transform("entries", lambda entry: F.get(entry, param))


def gather_entries(places: Column, num_params: int) -> Column:
    """Entries from the arrays ``p0 ..`` in the order of ``places``."""
    return F.transform(places, lambda place: F.array(*[F.get(f"p{p}", place) for p in range(num_params)]))


def split_entries(values: Column, num_sources: int, num_params: int) -> Column:
    """Entries from one array of parameters, slot by slot; NaN becomes NULL."""
    return F.transform(slot_numbers(num_sources), lambda slot: F.transform(
        F.slice(values, slot * num_params + 1, num_params), nan_to_null))


def single_rows(most: Column, entries: Column) -> Column:
    """``entries``, unless a slot had several rows."""
    return F.when(most <= 1, entries).otherwise(F.raise_error(F.concat(
        F.lit("several rows for one slot of sample "), F.col("sample_id").cast("string"), F.lit("; give a merge function"))))


class ChainRows(Protocol):
    """A chain's files, if their format lets parts of them be read."""

    def read(self, columns: Sequence[int] | None = None, first: int = 0) -> DataFrame: ...

    def by_param(self, params: Sequence[int], first: int = 0) -> DataFrame: ...


@dataclass(frozen=True)
class PosteriorChain:
    """N samples of S slots with P parameters each.

    ``frame`` has one row per sample: ``sample_id BIGINT, entries ARRAY<ARRAY<DOUBLE>>`` with S
    entries of P parameters. A missing parameter is NULL. ``dense_ids`` says whether the ids are
    0..N-1, which burn and thin need. ``ids`` may hold the same sample ids, each once or more often, at less cost;
    ``rows`` may read single parameters and later samples of the same chain.
    """

    frame: DataFrame
    num_sources: int
    num_params_per_source: int
    trans_dimensional: bool = False
    prob_in_model: tuple[float, ...] | None = None
    cost_by_width: Mapping[int, float] = field(default_factory=dict)
    dense_ids: bool = True
    columns: DataFrame | None = None
    stored: bool = False
    trace: tuple = ()
    ids: DataFrame | None = None
    rows: ChainRows | None = None

    # ---- constructors -------------------------------------------------------------------

    @classmethod
    def from_array(cls, spark: SparkSession, values: np.ndarray, num_sources: int,
                   num_params_per_source: int, **metadata) -> PosteriorChain:
        """A chain from an in-memory array whose size is a multiple of S*P; NaN is missing."""
        cube = np.asarray(values, dtype=float).reshape(-1, num_sources, num_params_per_source)
        flat = pa.array(cube.ravel(), mask=np.isnan(cube.ravel()))
        entries = pa.FixedSizeListArray.from_arrays(flat, num_params_per_source)
        samples = pa.FixedSizeListArray.from_arrays(entries, num_sources)
        table = pa.table({"sample_id": np.arange(len(cube), dtype="int64"),
                          "entries": samples.cast(pa.list_(pa.list_(pa.float64())))})
        return cls(spark.createDataFrame(table), num_sources, num_params_per_source, **metadata)

    @classmethod
    def from_flat(cls, frame: DataFrame, sample_id: Column, values: Column, num_sources: int,
                  num_params_per_source: int, **metadata) -> PosteriorChain:
        """A chain from rows that carry the S*P parameters in one array column."""
        width = num_sources * num_params_per_source
        checked = F.when(F.size(values) == width, values).otherwise(
            F.raise_error(F.lit(f"a sample does not have {width} values")))
        flat = frame.select(sample_id.cast("long").alias("sample_id"), checked.alias("_values"))
        entries = split_entries(F.col("_values"), num_sources, num_params_per_source)
        return cls(flat.select("sample_id", entries.alias("entries")),
                   num_sources, num_params_per_source, **metadata)

    @classmethod
    def from_long(cls, frame: DataFrame, sample_id: Column, slot: Column, params: Sequence[Column],
                  num_sources: int, merge: Callable[[Column], Column] | None = None,
                  divide_by: Sequence[float] | None = None, **metadata) -> PosteriorChain:
        """A chain from one row per (sample, slot); a NULL or other slot raises.

        ``merge`` combines several rows of one slot, which raise without it; ``divide_by`` scales the
        merged parameters. The aggregation has map-side partials: a key that holds a large part of the
        rows is reduced to one fixed-width buffer per slot and task before the shuffle.
        """
        known = slot.between(0, num_sources - 1)
        checked = F.when(known, slot.cast("int")).otherwise(F.raise_error(F.concat(
            F.lit(f"slots must be 0 to {num_sources - 1}, found "), F.coalesce(slot.cast("string"), F.lit("NULL")))).cast("int"))
        values = [p.cast("double").alias(f"v{i}") for i, p in enumerate(params)]
        rows = frame.select(sample_id.cast("long").alias("sample_id"), checked.alias("slot"), *values)
        rows = rows.select("sample_id", "slot", *[nan_to_null(F.col(f"v{i}")).alias(f"v{i}") for i in range(len(params))])
        divisors = [1.0] * len(params) if divide_by is None else divide_by
        gathered = (cls._pivot if num_sources * len(params) <= MAX_PIVOT_CELLS else cls._gather)(
            rows, num_sources, len(params), merge or F.max, merge is None)
        entries = F.transform("entries", lambda entry: F.array(*[
            F.get(entry, i) / F.lit(float(d)) for i, d in enumerate(divisors)]))
        metadata = {"trans_dimensional": True, "dense_ids": False, "ids": rows.select("sample_id")} | metadata
        return cls(gathered.select("sample_id", entries.alias("entries")), num_sources, len(params), **metadata)

    @staticmethod
    def _pivot(rows: DataFrame, num_sources: int, num_params: int, merge: Callable, once: bool) -> DataFrame:
        """One aggregation with a buffer per cell."""
        cells = [merge(F.expr(f"CASE WHEN slot = {s} THEN v{i} END")).alias(f"s{s}p{i}")
                 for s in range(num_sources) for i in range(num_params)]
        counts = [F.expr(f"count_if(slot = {s})").alias(f"n{s}") for s in range(num_sources)] if once else []
        pivoted = rows.groupBy("sample_id").agg(*cells, *counts)
        entries = F.array(*[F.array(*[F.col(f"s{s}p{i}") for i in range(num_params)]) for s in range(num_sources)])
        most = F.array_max(F.array(*[f"n{s}" for s in range(num_sources)])) if once else F.lit(1)
        return pivoted.select("sample_id", single_rows(most, entries).alias("entries"))

    @staticmethod
    def _gather(rows: DataFrame, num_sources: int, num_params: int, merge: Callable, once: bool) -> DataFrame:
        """Wide chains: the slots of a sample first, with a buffer per parameter, then its at most S entries."""
        cells = [merge(f"v{i}").alias(f"v{i}") for i in range(num_params)]
        slots = rows.groupBy("sample_id", "slot").agg(*cells, F.count("*").alias("n"))
        packed = slots.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(
            "slot", F.array(*[f"v{i}" for i in range(num_params)])))).alias("by_slot"), F.max("n").alias("n"))
        entries = F.transform(slot_numbers(num_sources), lambda s: F.coalesce(
            F.try_element_at("by_slot", s), null_entry(num_params)))
        return packed.select("sample_id", single_rows(F.col("n") if once else F.lit(1), entries).alias("entries"))

    # ---- views --------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def shape(self) -> tuple[int, int, int]:
        return (self.frame.count(), self.num_sources, self.num_params_per_source)

    def by_param(self, params: Sequence[int] | None = None) -> DataFrame:
        """One row per sample with an array over the slots for each parameter: ``sample_id, p0 ..``.

        Jobs work on this form: it keeps expressions short however wide the chain is, and of a
        staged chain only the parameters that a job uses are read. ``params`` names those that are needed,
        for files that have to be told.
        """
        if self.columns is not None:
            return self.columns
        if self.rows is not None:
            return self.rows.by_param(range(self.num_params_per_source) if params is None else sorted(set(params)))
        return self.frame.select("sample_id", *[
            param_of_entries(p).alias(f"p{p}") for p in range(self.num_params_per_source)])

    def long(self) -> DataFrame:
        """One row per entry: ``sample_id, slot, params``."""
        columns = [F.col(f"p{p}") for p in range(self.num_params_per_source)]
        return self.long_columns().select("sample_id", "slot", F.array(*columns).alias("params"))

    def long_columns(self) -> DataFrame:
        """One row per entry with the parameters as ``p0 .. p{P-1}``."""
        names = [f"p{p}" for p in range(self.num_params_per_source)]
        rows = self.by_param().select("sample_id", *names, F.explode(slot_numbers(self.num_sources)).alias("slot"))
        return rows.select("sample_id", "slot", *[F.get(name, "slot").alias(name) for name in names])

    def values(self, slot: int, param: int) -> DataFrame:
        """One parameter of one slot for every sample."""
        if not (0 <= slot < self.num_sources and 0 <= param < self.num_params_per_source):
            raise IndexError(f"no parameter {param} of slot {slot}")
        if self.rows is not None:
            cell = self.rows.read([slot * self.num_params_per_source + param])
            return cell.select("sample_id", nan_to_null(F.get("values", F.lit(0))).alias("value"))
        return self.by_param([param]).select("sample_id", F.get(f"p{param}", slot).alias("value"))

    # ---- transformations ----------------------------------------------------------------

    def with_frame(self, frame: DataFrame, **changes) -> PosteriorChain:
        return replace(self, **({"frame": frame, "columns": None, "stored": False, "ids": None, "rows": None} | changes))

    def staged(self) -> PosteriorChain:
        """The same chain backed by a written table with a column per parameter."""
        if self.stored:
            return self
        return self.with_columns(stage(self.by_param()), stored=True, ids=self.ids)

    def with_columns(self, columns: DataFrame, **changes) -> PosteriorChain:
        """The chain that ``columns`` holds by parameter."""
        entries = gather_entries(slot_numbers(self.num_sources), self.num_params_per_source)
        frame = columns.select("sample_id", entries.alias("entries"))
        return self.with_frame(frame, columns=columns, **changes)

    def with_dense_ids(self) -> PosteriorChain:
        """Replace the sample ids by 0..N-1 in ascending id order."""
        if self.dense_ids:
            return self
        return self.with_frame(number_ids(self.frame, self.ids), dense_ids=True)

    def get_chain(self, burn: int = 0, thin: int = 1) -> PosteriorChain:
        """Drop the first ``burn`` samples, then keep every ``thin``-th one."""
        if burn < 0 or thin < 1:
            raise ValueError("burn must not be negative and thin must be at least 1")
        if burn == 0 and thin == 1:
            return self
        dense = self.with_dense_ids()
        later = F.col("sample_id") - burn
        if dense.rows is not None and burn:
            dense = dense.with_frame(dense.rows.by_param(range(self.num_params_per_source), burn).select(
                "sample_id", gather_entries(slot_numbers(self.num_sources), self.num_params_per_source).alias("entries")))
        kept = dense.frame.where((F.col("sample_id") >= burn) & (later % thin == 0))
        return dense.with_frame(kept.withColumn("sample_id", F.floor(later / thin)))

    def expand_chain(self, max_num_sources: int) -> PosteriorChain:
        """Append missing entries until every sample has ``max_num_sources`` slots."""
        extra = max_num_sources - self.num_sources
        if extra < 0:
            raise ValueError("cannot expand to fewer sources than the chain has")
        padding = F.array(*[null_entry(self.num_params_per_source)] * extra) if extra else None
        entries = F.concat("entries", padding) if extra else F.col("entries")
        return self.with_frame(self.frame.select("sample_id", entries.alias("entries")),
                               num_sources=max_num_sources, trans_dimensional=True, ids=self.ids)

    def randomize_entries(self, seed: int | None = None) -> PosteriorChain:
        """Put the entries of every sample into an independent pseudo-random order.

        The order depends only on seed, sample id and slot, so it does not change with the
        partitioning or when a task is repeated. Without a seed one is drawn here, once.
        """
        if seed is None:
            seed = int(np.random.default_rng().integers(2**63))
        keyed = F.transform("entries", lambda entry, slot: F.struct(
            F.md5(F.concat_ws(":", F.lit(seed), "sample_id", slot)).alias("key"), entry.alias("entry")))
        shuffled = self.frame.select("sample_id", F.sort_array(keyed).getField("entry").alias("entries"))
        return self.with_frame(shuffled, ids=self.ids)

    def reorder(self, labels: Column) -> PosteriorChain:
        """Move every entry to the slot that ``labels`` (one label per entry, a permutation) names."""
        valid = F.coalesce(F.sort_array(labels.cast("array<int>")) == slot_numbers(self.num_sources), F.lit(False))
        checked = F.when(valid, labels).otherwise(F.raise_error(F.concat(
            F.lit(f"labels must be a permutation of 0 to {self.num_sources - 1}, found "),
            F.coalesce(F.array_join(labels.cast("array<string>"), ",", "NULL"), F.lit("NULL")))))
        return self.with_labels(self.by_param().withColumn("labels", checked))

    def with_labels(self, labelled: DataFrame) -> PosteriorChain:
        """The chain in the order of ``labelled``, its by-parameter form with a ``labels`` column."""
        names = [f"p{p}" for p in range(self.num_params_per_source)]
        places = F.transform(slot_numbers(self.num_sources),
                             lambda label: (F.array_position("labels", label) - 1).cast("int"))
        placed = labelled.select("sample_id", *names, places.alias("places"))
        return self.with_columns(placed.selectExpr(
            "sample_id", *[f"transform(places, place -> get({name}, place)) AS {name}" for name in names]))

    # ---- files --------------------------------------------------------------------------

    def to_parquet(self, path: str, mode: str = "errorifexists") -> None:
        from .sources.tables import write_parquet

        write_parquet(self, path, mode)

    @staticmethod
    def read_parquet(spark: SparkSession, path: str) -> PosteriorChain:
        from .sources.tables import read_parquet

        return read_parquet(spark, path)

    def to_feather(self, path: str) -> None:
        from .sources.feather import write_feather

        write_feather(self, path)

    @staticmethod
    def read_feather(spark: SparkSession, path: str) -> PosteriorChain:
        from .sources.feather import read_feather

        return read_feather(spark, path)

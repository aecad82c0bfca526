"""Chains in Feather files: a wide table with columns ``0 .. S*P-1`` and three metadata columns.

A chain is written as a folder of part files, each of which is a complete file of this layout. A
single file is read in parallel by record batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..chain import PosteriorChain
from ..functions.columns import nan_to_null
from ..storage import add_offsets, stage

# Fixed values of the file layout.
SOURCES, PARAMS, TRANSDIMENSIONAL = "num_sources", "num_params_per_source", "transdimensional"
METADATA = [SOURCES, PARAMS, TRANSDIMENSIONAL]

MAX_READ_TASKS = 100_000
UNITS = pa.schema([("file", pa.int32()), ("path", pa.string()), ("batch", pa.int32()), ("_size", pa.int64()),
                   *[(name, pa.int32()) for name in METADATA]])
ROWS_PER_BATCH = 65_536


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a full URI that tasks can open; a bare path belongs to the cluster's default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        if not path.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{path!r} is on the disk of each machine; name a shared folder, or file:// for a shared mount")
        return f"file:///{rest.lstrip('/')}"
    return f"s3:{rest}" if scheme in ("s3a", "s3n") else uri


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _open(path: str, only: list[str] | None = None) -> pa.ipc.RecordBatchFileReader:
    files, name = _filesystem(path)
    reader = pa.ipc.open_file(files.open_input_file(name))
    if only is None:
        return reader
    fields = [reader.schema.get_field_index(c) for c in only]
    return pa.ipc.open_file(files.open_input_file(name), options=pa.ipc.IpcReadOptions(included_fields=fields))


def _data_files(uri: str) -> list[str]:
    """The file, or all files of the folder in the order of their names; names with ``_`` or ``.`` in front are not data."""
    files, name = _filesystem(uri)
    if files.get_file_info(name).type != pafs.FileType.Directory:
        return [uri]
    listed = sorted((f for f in files.get_file_info(pafs.FileSelector(name)) if f.base_name[0] not in "_."),
                    key=lambda f: f.base_name)
    for found in listed:
        if not found.is_file:
            raise ValueError(f"{uri!r} holds the folder {found.base_name!r} beside its files")
    return [f"{uri.rstrip('/')}/{f.base_name}" for f in listed]


def _list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, size and shape of every record batch that has rows."""
    for listed in batches:
        for file in listed.to_pylist():
            reader = _open(file["path"], METADATA)
            rows = []
            for i in range(reader.num_record_batches):
                batch = reader.get_batch(i)
                shapes = set(zip(*(batch.column(name).to_pylist() for name in METADATA)))
                if len(shapes) > 1:
                    raise ValueError(f"{file['path']!r} mixes shapes: {sorted(shapes)}")
                rows += [{**file, "batch": i, "_size": batch.num_rows, **dict(zip(METADATA, map(int, shape)))} for shape in shapes]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=UNITS)


@dataclass(frozen=True)
class FeatherRows:
    """The rows of a chain in Feather files: what is asked for decides which columns and record batches are opened.

    ``units`` is a written table with one row per record batch and the number of rows before it.
    """

    units: DataFrame
    num_sources: int
    num_params: int

    def read(self, columns: Sequence[int] | None = None, first: int = 0) -> DataFrame:
        """``sample_id, values``: the cells ``columns`` of the samples from number ``first`` on; all cells by default."""
        names = None if columns is None else [str(c) for c in columns]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for units in batches:
                for unit in units.to_pylist():
                    block = _open(unit["path"], names).get_batch(unit["batch"])
                    skipped = max(0, first - unit["_before"])
                    wanted = [n for n in block.schema.names if n not in METADATA] if names is None else names
                    values = np.stack([block.column(n).to_numpy(zero_copy_only=False).astype(float) for n in wanted], axis=1)[skipped:]
                    ids = pa.array(unit["_before"] + skipped + np.arange(len(values)), pa.int64())
                    cells = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * len(wanted), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays([ids, cells], ["sample_id", "values"])

        needed = self.units.where(F.col("_before") + F.col("_size") > first)
        tasks = max(1, min(needed.count(), MAX_READ_TASKS))
        return needed.repartitionByRange(tasks, "file", "batch").mapInArrow(rows, "sample_id long, values array<double>")

    def by_param(self, params: Sequence[int], first: int = 0) -> DataFrame:
        """``sample_id, p..``: an array over the slots for each of ``params``."""
        cells = [slot * self.num_params + param for param in params for slot in range(self.num_sources)]
        rows = self.read(cells, first)
        parts = [F.transform(F.slice("values", i * self.num_sources + 1, self.num_sources), nan_to_null).alias(f"p{param}")
                 for i, param in enumerate(params)]
        return rows.select("sample_id", *parts)


def read_feather(spark: SparkSession, path: str) -> PosteriorChain:
    """Read one file or all files of a folder; sample ids follow file names and row order.

    The driver lists the files; tasks read footers, shapes and batches. Files of different shapes raise. Single values,
    fits and burning open only the columns and record batches that they need.
    """
    files = [(i, uri) for i, uri in enumerate(_data_files(qualified(spark, path)))]
    tasks = max(1, min(len(files), MAX_READ_TASKS))
    listed = spark.createDataFrame(files, "file int, path string").repartitionByRange(tasks, "file")
    sized = listed.mapInArrow(_list_batches, "file int, path string, batch int, _size long, " + ", ".join(f"{n} int" for n in METADATA))
    placed = stage(add_offsets(stage(sized), ["file", "batch"]))
    shapes = [tuple(row) for row in placed.select(*METADATA).distinct().limit(2).collect()]
    if len(shapes) != 1:
        raise ValueError(f"{path!r} holds chains of different shapes: {shapes}" if shapes else f"{path!r} holds no samples")
    [(num_sources, num_params, flag)] = shapes
    rows = FeatherRows(placed, num_sources, num_params)
    return PosteriorChain.from_flat(rows.read(), F.col("sample_id"), F.col("values"), num_sources, num_params,
                                    trans_dimensional=bool(flag), rows=rows)


def write_feather(chain: PosteriorChain, path: str) -> None:
    """Write part files in sample order, one per range of sample ids."""
    chain.spark.dataSource.register(FeatherChainSource)
    path = qualified(chain.spark, path)
    # Range partitioning reads its input twice, so an unwritten chain is written first.
    ordered = chain.staged().frame.select("sample_id", F.flatten("entries").alias("values"))
    ordered = ordered.repartitionByRange("sample_id").sortWithinPartitions("sample_id")
    (ordered.write.format(FeatherChainSource.name()).mode("append")
     .option(SOURCES, chain.num_sources).option(PARAMS, chain.num_params_per_source)
     .option(TRANSDIMENSIONAL, int(chain.trans_dimensional)).save(path))


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    first_id: int | None


class FeatherChainSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather_chain"

    def schema(self) -> str:
        return "sample_id long, values array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FeatherChainWriter(dict(self.options))


class FeatherChainWriter(DataSourceArrowWriter):
    """Each task attempt writes its own temporary file; the commit names the successful ones."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.shape = [int(options[name]) for name in METADATA]
        files, name = _filesystem(self.path)
        if files.get_file_info(name).type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path!r} already exists")
        self.attempts = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        files.create_dir(_filesystem(self.attempts)[1], recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        files, folder = _filesystem(self.attempts)
        name, first_id, sink = f"{uuid.uuid4().hex}.feather", None, None
        width = self.shape[0] * self.shape[1]
        for batch in iterator:
            if not batch.num_rows:
                continue
            table = self._wide(batch.column("values"), width)
            if sink is None:
                first_id = batch.column("sample_id")[0].as_py()
                sink = pa.ipc.new_file(files.open_output_stream(f"{folder}/{name}"), table.schema)
            sink.write_table(table, max_chunksize=ROWS_PER_BATCH)
        if sink is None:
            return _Part(None, None)
        sink.close()
        return _Part(name, first_id)

    def _wide(self, values: pa.Array, width: int) -> pa.Table:
        block = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        columns = {str(i): block[:, i] for i in range(width)}
        columns |= {name: np.full(len(block), value) for name, value in zip(METADATA, self.shape)}
        return pa.table(columns)

    def commit(self, messages: list[_Part | None]) -> None:
        files, folder = _filesystem(self.path)
        _, attempts = _filesystem(self.attempts)
        written = sorted((m for m in messages if m and m.name), key=lambda m: m.first_id)
        for number, part in enumerate(written):
            files.move(f"{attempts}/{part.name}", f"{folder}/part-{number:06d}.feather")
        files.delete_dir(attempts)

    def abort(self, messages: list[_Part | None]) -> None:
        files, attempts = _filesystem(self.attempts)
        files.delete_dir(attempts)

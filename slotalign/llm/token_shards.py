"""Token sequences in training order, as shards of fixed-stride records.

* **Sequences.** Texts are encoded, ended by a separator each, and cut into records of ``length`` tokens; only
  the last record of a task is filled up with separators. Records are written once, so that their places
  (task, then place within it) are pinned; the numbers of records before each task make them dense numbers.
* **Order.** A keyed Feistel permutation of a power of four at least as large as the number of sequences, walked
  along its cycle until it comes back into range, gives each sequence its slot: a bijection, computed row
  by row, without a sort key to store or a shuffle to draw.
* **Shards.** A range partition holds whole shards of ``per_shard`` consecutive slots and joins their records.
  Slot ``s`` is at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``, so readers seek, read on
  sequentially, and resume at any slot.

Defined results: NULL and empty texts give no tokens and no separator. Repeated rows are encoded each time
they stand. Ids of the separator must be free in the vocabulary. An empty table gives no shards. Other
columns play no part.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .bpe import make_encoder, parse_ranks, read_ranks
from .words import mix

LENGTH = 2048
PER_SHARD = 2048
ROUNDS = 6
FLUSH_RECORDS = 64


def feistel_slots(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """A keyed permutation of ``0 .. count - 1`` at ``numbers``."""
    half = np.uint64(max(1, math.ceil(max(1, count - 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    values = numbers.astype(np.uint64)
    walking = np.arange(len(values))
    while len(walking):
        left, right = values[walking] >> half, values[walking] & mask
        for round_key in keys:
            left, right = right, left ^ (mix(right ^ round_key) & mask)
        values[walking] = (left << half) | right
        walking = walking[values[walking] >= count]
    return values.astype(np.int64)


def pack_sequences(documents: DataFrame, rank_file: str, pattern: str, text: str, separator: int, length: int) -> DataFrame:
    """``part, place, record`` of all sequences; ids are little-endian, 2 bytes wide if they fit, else 4."""
    content = documents.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = parse_ranks(content.value)
        if separator in ranks.values():
            raise ValueError(f"id {separator} is a token of the vocabulary")
        encode, width = make_encoder(ranks, pattern), "<u2" if max(max(ranks.values()), separator) < 1 << 16 else "<u4"
        part, place, held = TaskContext.get().partitionId(), 0, array("I")

        def cut(tokens: array) -> pa.RecordBatch:
            nonlocal place
            records = np.frombuffer(tokens, np.uint32).astype(width).reshape(-1, length)
            places = np.arange(place, place + len(records))
            place += len(records)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(records), part, np.int32)), pa.array(places),
                pa.array([r.tobytes() for r in records], pa.binary())], names=["part", "place", "record"])

        for batch in batches:
            for value in batch.column(0):
                if value.is_valid and (text_value := value.as_py()):
                    held.extend(encode(text_value))
                    held.append(separator)
                    if len(held) >= FLUSH_RECORDS * length:
                        full = len(held) // length * length
                        yield cut(held[:full])
                        held = held[full:]
        if held:
            held.extend([separator] * (-len(held) % length))
            yield cut(held)

    return documents.select(text).mapInArrow(run, "part int, place long, record binary")


def training_shards(documents: DataFrame, rank_file: str, pattern: str, key: int, separator: int, text: str = "text",
                    length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``shard, first_slot, n_sequences, stride, payload``: one row per shard, in the order of slots."""
    packed = stage(pack_sequences(documents, rank_file, pattern, text, separator, length))
    # One row per task that wrote records: small, whatever the number of sequences.
    sizes = stage(packed.groupBy("part").agg(F.count("*").alias("n")))
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("long")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel_slots(numbers.to_numpy(), total, key))

    def join_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, records = None, 0, []

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([shard]), pa.array([first]), pa.array([len(records)]), pa.array([len(records[0])], pa.int32()),
                pa.array([b"".join(records)], pa.binary())], names=["shard", "first_slot", "n_sequences", "stride", "payload"])

        for batch in batches:
            for number, slot, record in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "record"))):
                if number != shard:
                    if records:
                        yield finished()
                    shard, first, records = number, slot, []
                records.append(record)
        if records:
            yield finished()

    placed = packed.join(F.broadcast(offsets), "part").withColumn("slot", slot_of(F.col("before") + F.col("place")))
    numbered = placed.select(F.floor(F.col("slot") / per_shard).alias("shard"), "slot", "record")
    shards = max(1, math.ceil(total / per_shard))
    ordered = numbered.repartitionByRange(min(shards, 100_000), "shard").sortWithinPartitions("slot")
    return ordered.mapInArrow(join_records, "shard long, first_slot long, n_sequences long, stride int, payload binary")


def read_sequences(shards: DataFrame, first_slot: int = 0, count: int | None = None) -> DataFrame:
    """``slot, record`` from ``first_slot`` on, by offsets into the payloads; shards before it are not read."""
    wanted = shards.where(F.col("first_slot") + F.col("n_sequences") > first_slot)
    if count is not None:
        wanted = wanted.where(F.col("first_slot") < first_slot + count)
    slots = wanted.select("first_slot", "stride", "payload", F.explode(F.sequence(
        F.greatest("first_slot", F.lit(first_slot)),
        F.least(F.col("first_slot") + F.col("n_sequences"), F.lit(first_slot + count if count is not None else 2**62)) - 1)).alias("slot"))
    at = ((F.col("slot") - F.col("first_slot")) * F.col("stride")).cast("int") + 1
    return slots.select("slot", F.substring("payload", at, F.col("stride")).alias("record"))


def write_binary_shards(shards: DataFrame, uri: str) -> DataFrame:
    """Write each payload as ``shard-<number>.bin`` under ``uri`` (file, s3, gs, hdfs); returns ``shard, path``.

    A file appears under its name only when complete, and a repeated task writes the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        attempt = TaskContext.get().taskAttemptId()
        store.create_dir(root, recursive=True)
        for batch in batches:
            for number, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                path = f"{root}/shard-{number:09d}.bin"
                with store.open_output_stream(f"{path}.{attempt}") as out:
                    out.write(payload.as_buffer())
                store.move(f"{path}.{attempt}", path)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path])], names=["shard", "path"])

    return stage(shards.select("shard", "payload").mapInArrow(run, "shard long, path string"))

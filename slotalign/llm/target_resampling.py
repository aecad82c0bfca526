"""Drawing documents whose features are distributed like those of a target (Gumbel top-k on importance weights).

Features are runs of words hashed into a fixed number of buckets. One map-side count of the corpus and one of the
target give an array with the gain of every bucket; a document's weight is the floored mean gain of its features, and its
score the weight plus Gumbel noise that depends on its id alone. Drawing the highest scores then is drawing without
replacement in proportion to the weights.

The draw is a distributed quickselect on the key (score, id, row number): every round picks pivot keys at random from the
range that is left and counts exactly how many keys lie between them and on them, which leaves one range between two
pivots, until a pivot is the k-th key itself. A round brings a fixed number of counts to the driver, and the rounds grow
with the logarithm of the rows. Only the documents up to that key are sorted and ranked; no other row is moved.

Defined results: a NULL or empty text has no features and weight 0. A NULL id has the noise of an empty id and comes after
the others among equal scores. Repeated rows are scored and drawn each. An empty target leaves gains by the corpus alone;
an empty table gives no rows. Columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import number_rows, stage
from .arrow import add_columns, small_slices
from .slices import Block, blocks, runs

BUCKETS = 10_000
MIN_WORDS = 20
PIVOTS = 64
# Hashed together by their next byte; what is longer goes to the library one by one.
LOCKSTEP_BYTES = 48
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"  # of lower-cased bytes
CUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


class FeatureHasher:
    """Buckets of all runs of 1 to ``longest`` words; make one per task."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest, self.table = buckets, longest, crc_table()
        codes = np.arange(256)
        self.is_word = ((codes >= 48) & (codes < 58)) | ((codes >= 97) & (codes < 123)) | (codes >= 128)
        other = rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
        self.ahead = re.compile(rb"(?:%s*[0-9A-Za-z\x80-\xFF]+){0,%d}" % (other, longest - 1))

    def crc32(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of many stretches of ``data``, byte by byte for all of them together."""
        values, lengths = np.frombuffer(data, np.uint8), ends - starts
        order = np.argsort(-np.minimum(lengths, LOCKSTEP_BYTES + 1).astype(np.int8), kind="stable")
        at, left = starts[order], lengths[order]
        state = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for step in range(min(LOCKSTEP_BYTES, int(left[0]) if left.size else 0)):
            active = int(np.searchsorted(-np.minimum(left, LOCKSTEP_BYTES + 1), -step))
            now = state[:active]
            state[:active] = self.table[(now ^ values[at[:active] + step]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        state = ~state
        for i in range(int(np.searchsorted(-np.minimum(left, LOCKSTEP_BYTES + 1), -LOCKSTEP_BYTES))):
            state[i] = zlib.crc32(data[at[i]:at[i] + left[i]])
        found = np.empty_like(state)
        found[order] = state
        return found

    def features(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run length, the text number and the bucket of every feature."""
        data = block.data.translate(UPPER_TO_LOWER)
        is_word = self.is_word[np.frombuffer(data, np.uint8)]
        starts, ends = runs(is_word)
        piece = np.searchsorted(block.starts, starts, side="right") - 1
        own = starts < block.owned[piece]
        # Words with one space behind each, so that a run of words is one stretch.
        lengths = ends - starts
        packed_ends = np.cumsum(lengths + 1) - 1
        keep = is_word.copy()
        keep[ends[ends < len(keep)]] = True
        packed = np.frombuffer(data, np.uint8)[keep].copy()
        packed[packed_ends[packed_ends < len(packed)]] = 32
        content, packed_starts = packed.tobytes(), packed_ends - lengths
        for size in range(1, self.longest + 1):
            first = np.flatnonzero(own[:len(own) - size + 1])
            first = first[piece[first] == piece[first + size - 1]]
            crc = self.crc32(content, packed_starts[first], packed_ends[first + size - 1])
            yield block.texts[piece[first]], (crc % np.uint32(self.buckets)).astype(np.int64)

    def of_texts(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(run length, text numbers, buckets)`` a block at a time."""
        for block in blocks(texts, CUT, self.ahead):
            for size, (numbers, found) in enumerate(self.features(block), 1):
                yield size, numbers, found


def bucket_counts(frame: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How often each bucket occurs in all texts; at most one row per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = FeatureHasher(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in small_slices(batch):
                for _, _, found in hasher.of_texts(part.column(0).to_pylist()):
                    counts += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    counted = frame.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(buckets, np.int64)
    for row in counted.collect():
        totals[row["bucket"]] = row["n"]
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored thousandfold log ratio of its smoothed shares in the target and in the corpus."""
    size, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_corpus + size) / ((s + 1.0) * (all_target + size))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def with_weights(frame: DataFrame, gains: np.ndarray, text: str = "text", longest: int = 1) -> DataFrame:
    """``frame`` with ``n_words, n_features, weight`` of each text."""
    shared = frame.sparkSession.sparkContext.broadcast(gains)

    def work():
        hasher = FeatureHasher(len(shared.value), longest)

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            rows = part.num_rows
            words, features, total = (np.zeros(rows, np.int64) for _ in range(3))
            for size, numbers, found in hasher.of_texts(part.column(text).to_pylist()):
                each_text = np.bincount(numbers, minlength=rows)
                features += each_text
                words += each_text if size == 1 else 0
                # Whole numbers far below 2^53, so the doubles are exact.
                total += np.bincount(numbers, shared.value[found], rows).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            return [pa.array(words), pa.array(features), pa.array(weight)]

        return each

    return add_columns(frame, {n: T.LongType() for n in ("n_words", "n_features", "weight")}, work)


def gumbel(ids: Column, seed: int) -> Column:
    """Floored thousandfold Gumbel noise from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


Key = tuple


def kth_key(keyed: DataFrame, key: list[str], rank: int, pivots: int = PIVOTS, seed: int = 0) -> Key | None:
    """The ``rank``-th smallest of the distinct keys (columns ``key``, ascending) of a written table, by quickselect.

    A round is one scan: exact counts between and on the pivots, and the pivots of the next round, which are
    random keys (smallest hashes) of every range.
    """
    if rank < 1:
        return None
    types = [keyed.schema[c].dataType for c in key]
    whole = F.struct(*key)

    def constant(values: Key) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(values, types, key)])

    low: Key | None = None
    high: Key | None = None
    chosen: list[Key] = []
    for turn in range(1, 1000):
        rows = keyed if low is None else keyed.where(whole > constant(low))
        rows = rows if high is None else rows.where(whole < constant(high))
        marks = F.array(*map(constant, chosen)) if chosen else None
        below = F.size(F.filter(marks, lambda p: p < whole)) if chosen else F.lit(0)
        on = F.array_contains(marks, whole) if chosen else F.lit(False)
        draw = F.xxhash64(F.lit(seed + turn), *key)
        counted = rows.select(below.alias("below"), on.alias("on"), F.pmod(draw, F.lit(pivots)).alias("slot"), draw.alias("draw"),
                              whole.alias("key")) \
            .groupBy("below", "on", "slot").agg(F.count("*").alias("n"), F.min_by("key", "draw").alias("pick")).collect()
        sizes: dict[tuple[int, bool], int] = {}
        for row in counted:
            place = (row["below"], row["on"])
            sizes[place] = sizes.get(place, 0) + row["n"]
        # The keys between two pivots come before the upper one of them.
        for place in sorted(sizes):
            if rank <= sizes[place]:
                break
            rank -= sizes[place]
        else:
            return None
        number, is_pivot = place
        if is_pivot:
            return chosen[number]
        low, high = (chosen[number - 1] if number else low), (chosen[number] if number < len(chosen) else high)
        chosen = sorted(tuple(row["pick"]) for row in counted if (row["below"], row["on"]) == place)
    raise RuntimeError("the range did not narrow")


def resample(frame: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, id: str = "doc_id", text: str = "text",
             target_text: str = "text", buckets: int = BUCKETS, longest: int = 1, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is NULL unless it is drawn.

    Of the documents with at least ``min_words`` words, ``percent`` of a hundred are drawn, rounded down.
    """
    gains = bucket_gains(bucket_counts(frame, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    weighted = with_weights(frame.select(F.col(id).alias("_id"), F.col(text).alias("_text")), gains, "_text", longest)
    scored = stage(weighted.select("_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("_id"), seed)).alias("score"))
                   .withColumns({"_row": F.monotonically_increasing_id(), "_low": -F.col("score"),
                                 "_no_id": F.col("_id").isNull().cast("int")}))
    key = ["_low", "_no_id", "_id", "_row"]
    eligible = scored.where(F.col("n_words") >= min_words)
    last = kth_key(eligible, key, percent * eligible.count() // 100, seed=seed)
    columns = [F.col("_id").alias(id), "n_words", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    bound = F.struct(*[F.lit(v).cast(scored.schema[c].dataType).alias(c) for v, c in zip(last, key)])
    drawn = (F.col("n_words") >= min_words) & (F.struct(*key) <= bound)
    ranked = number_rows(scored.where(drawn), key, into="_place")
    return ranked.select(*columns, (F.col("_place") + 1).alias("rank")).unionByName(
        scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))

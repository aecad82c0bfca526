"""Benchmark decontamination by spaced-seed hashing.

A seed hashes a few words of a window and ignores the others, by fixed masks, so that it still meets its
counterpart when an ignored word was changed. Seeds of the benchmark are joined with those at every place
of every document. Around each hit the two texts are aligned without gaps. Of all stretches there with at least
``MIN_IDENTITY`` equal words, that with most equal words is an overlap if these are enough.

The benchmark goes to all tasks in blocks of bounded size, one pass over the documents for each block; the
documents are never shuffled.

Defined results: NULL or empty texts on either side overlap with nothing, and so do items of fewer than
``MIN_ITEM_WORDS`` words, which identify nothing. Items shorter than the widest mask are
looked up with any one word left out.
Repeated document rows are each reported; repeated items once. Of equally good overlaps of one document and
item the first in the document is reported. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Members, WordHasher, Words, mix

# Fixed masks: weight 5, so common words hardly meet by chance; windows of 7 to 9 words.
MASKS = ("1101011", "1110011", "11001011", "101100101")
MIN_ITEM_WORDS = 5
MIN_MATCHED = 10
MIN_IDENTITY = 0.8
# With 1 for an equal word, a stretch adds up to 0 at exactly ``MIN_IDENTITY``.
MISMATCH = -4
BLOCK_CHARS = 8_000_000
ALIGNED_CELLS = 4_000_000
# Pairs of places that are held at a time; more are worked off one part after another.
HITS = 4_000_000


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed that starts at each word; the last ``len(mask) - 1`` places are left out."""
    size = len(hashes) - len(mask) + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for place, letter in enumerate(mask):
        if letter == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[place:place + size]
    return mix(total ^ np.uint64(int(mask, 2)))


def one_left_out(size: int) -> list[str]:
    """Masks that meet in ``size`` words if any one of them was changed, and if none was."""
    return ["1" * (size - 1)] + ["1" * k + "0" + "1" * (size - 1 - k) for k in range(1, size - 1)]


def seeds_within(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that lie inside one text, and the word at which each begins."""
    seeds = seed_hashes(words.hashes, mask)
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))[:len(seeds)]
    inside = np.flatnonzero(np.arange(len(seeds)) + len(mask) <= ends)
    return seeds[inside], inside


def distinct_triples(rows: np.ndarray) -> np.ndarray:
    """Distinct rows of three whole numbers in ascending order."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]


class Postings:
    """The places of all items where each seed of one mask begins, told apart by the seed one word before."""

    def __init__(self, seeds: np.ndarray, places: np.ndarray, owner: np.ndarray) -> None:
        joint, _ = self.joint(seeds, places, owner, np.arange(len(seeds)))
        order = np.lexsort((joint, seeds))
        self.places = places[order]
        values, self.first = np.unique(seeds[order], return_index=True)
        self.end = np.append(self.first[1:], len(order))
        self.members = Members(values)
        # Equal joint seeds have equal seeds, so they stand together.
        at = np.flatnonzero(np.append(True, joint[order][1:] != joint[order][:-1]))
        by_value = np.argsort(joint[order][at])
        self.joint_members = Members(joint[order][at])
        self.joint_first, self.joint_end = at[by_value], np.append(at[1:], len(order))[by_value]

    @staticmethod
    def joint(seeds: np.ndarray, places: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each seed ``at`` and the one a word before it in the same text, and whether there is one."""
        last = np.maximum(at - 1, 0)
        follows = (places[at] == places[last] + 1) & (owner[at] == owner[last])
        before = np.where(follows, mix(seeds[last] + np.uint64(1)), np.uint64(0))
        return mix(seeds[at] * np.uint64(0x9E3779B97F4A7C15) + before), follows

    def first_hits(self, seeds: np.ndarray, places: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a text's and an item's place with equal seeds, without those that also have equal seeds a word before.

        What is left out lies on a diagonal that an earlier pair is on, so no diagonal is lost, and a repeated word
        meets its like at as many places as both runs have words, not at all pairs of them.
        """
        found, which = self.members.find(seeds)
        if not len(found):
            return
        joint, follows = self.joint(seeds, places, owner, found)
        low, high = np.zeros((2, len(found)), np.int64)
        at, same = self.joint_members.find(joint)
        low[at], high[at] = self.joint_first[same], self.joint_end[same]
        high[~follows] = low[~follows]
        # The places from ``low`` to ``high`` continue what began a word before.
        first, skipped = self.first[which], high - low
        many = self.end[which] - first - skipped
        place, total = places[found], np.cumsum(many)
        start = 0
        while start < len(found):
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + HITS, side="right")))
            part = slice(start, stop)
            inner = np.arange(many[part].sum()) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            other = np.repeat(first[part], many[part]) + inner
            beyond = np.repeat(skipped[part], many[part])
            other += np.where((beyond > 0) & (other >= np.repeat(low[part], many[part])), beyond, 0)
            yield np.repeat(place[part], many[part]), self.places[other]
            start = stop


class BenchmarkSeeds:
    """The seeds of a block of items."""

    def __init__(self, texts: pa.Array) -> None:
        hasher, parts = WordHasher(), []
        for words in hasher.chunks(texts):
            parts.append(words)
        self.hashes = np.concatenate([w.hashes for w in parts]) if parts else np.empty(0, np.uint64)
        sizes = np.concatenate([np.diff(w.bounds) for w in parts]) if parts else np.empty(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        widest = max(map(len, MASKS))
        items = Words(0, self.hashes, self.bounds)
        owner = items.owner()
        by_mask = {mask: sizes >= widest for mask in MASKS}
        for n in range(MIN_ITEM_WORDS, widest):
            for mask in one_left_out(n):
                by_mask[mask] = by_mask.get(mask, False) | (sizes == n)
        self.owner = owner
        self.tables = {}
        for mask, wanted in by_mask.items():
            seeds, places = seeds_within(items, mask)
            use = wanted[owner[places]]
            if use.any():
                self.tables[mask] = Postings(seeds[use], places[use], owner[places[use]])

    def diagonals(self, words: Words) -> np.ndarray:
        """Rows of text, item and shift, once each, of all places that begin equal seeds."""
        owner, known = words.owner(), np.empty((0, 3), np.int64)
        for mask, postings in self.tables.items():
            seeds, at = seeds_within(words, mask)
            for place, other in postings.first_hits(seeds, at, owner[at]):
                rows = np.stack([owner[place], self.owner[other], place - other], axis=1)
                known = distinct_triples(np.concatenate([known, rows]))
        return known

    def overlaps(self, words: Words) -> np.ndarray:
        """Rows of text, item, first word in the text, first word in the item, length, equal words."""
        diagonals = self.diagonals(words)
        if not len(diagonals):
            return np.empty((0, 6), np.int64)
        sizes = np.diff(self.bounds)[diagonals[:, 1]]
        needed = np.minimum(MIN_MATCHED, np.ceil(MIN_IDENTITY * np.diff(self.bounds)))
        rows = []
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            width = max(1, int(sizes[order[start]]))
            stop = start + max(1, min(len(order) - start, ALIGNED_CELLS // width))
            stop = start + max(1, int(np.searchsorted(sizes[order[start:stop]], 2 * width, side="right")))
            made = self.align(words, diagonals[order[start:stop]])
            rows.append(made[made[:, 5] >= needed[made[:, 1]]])
            start = stop
        found = np.concatenate(rows)
        found = found[np.lexsort((found[:, 2], -found[:, 5], found[:, 1], found[:, 0]))]
        return found[np.unique(found[:, :2], axis=0, return_index=True)[1]]

    def align(self, words: Words, diagonals: np.ndarray) -> np.ndarray:
        """Of each diagonal the stretch with most equal words among those with at least ``MIN_IDENTITY`` of them."""
        text, item, shift = diagonals.T
        low, high = self.bounds[item], self.bounds[item + 1]
        count, size = len(diagonals), int((high - low).max())
        equal = np.zeros((size + 1, count), np.int32)
        for k in range(size):
            here, there = low + k, low + k + shift
            valid = (here < high) & (there >= words.bounds[text]) & (there < words.bounds[text + 1])
            equal[k + 1] = equal[k] + (valid & (self.hashes[np.minimum(here, len(self.hashes) - 1)]
                                                == words.hashes[np.clip(there, 0, len(words.hashes) - 1)]))

        def score(k, rows=slice(None)):
            return (1 - MISMATCH) * equal[k, rows] + MISMATCH * k

        # The last place from each on with the highest score before it.
        top = np.empty_like(equal)
        top[size] = size
        rows = np.arange(count)
        for k in range(size - 1, -1, -1):
            top[k] = np.where(score(k) > score(top[k + 1], rows), k, top[k + 1])
        # Both ends move on only: the end while the stretch is good enough, else the begin.
        begin, least, end = np.zeros((3, count), np.int32)
        best, best_begin, best_end = np.zeros((3, count), np.int32)
        while len(rows):
            last = top[end[rows], rows]
            good = score(last, rows) >= score(least[rows], rows)
            found = equal[last, rows] - equal[least[rows], rows]
            better = good & (found > best[rows])
            at = rows[better]
            best[at], best_begin[at], best_end[at] = found[better], least[at], last[better]
            end[rows[good]] = last[good] + 1
            at = rows[~good]
            begin[at] += 1
            lower = at[score(begin[at], at) < score(least[at], at)]
            least[lower] = begin[lower]
            rows = rows[(end[rows] <= size) & (begin[rows] < size)]
        # Without unequal words at the ends.
        rows = np.arange(count)
        first = (equal <= equal[best_begin, rows]).sum(axis=0) - 1
        last = (equal < equal[best_end, rows]).sum(axis=0)
        return np.stack([text, item, low + first + shift - words.bounds[text], first, last - first, best], axis=1)


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The items in blocks of about ``BLOCK_CHARS`` characters."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    items = items.distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    if blocks <= 1:
        return [items] * blocks
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return [numbered.where(F.col("_block") == b).drop("_block") for b in range(blocks)]


def share_block(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast(block.orderBy("item_id", "text").toArrow())


def seeds_of(shared) -> BenchmarkSeeds:
    texts = shared.value["text"].combine_chunks()
    return BenchmarkSeeds(texts)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: both ids, where, how long, and how many words are equal."""
    id_type, item_type = documents.schema[doc_id].dataType, benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField(doc_id, id_type), T.StructField("item_id", item_type)] + [
        T.StructField(c, T.LongType()) for c in ("doc_word", "item_word", "n_words", "n_equal")])
    parts = []
    for block in benchmark_blocks(benchmark, item_id, item_text):
        shared = share_block(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds, hasher, item_ids = seeds_of(shared), WordHasher(), shared.value["item_id"].combine_chunks()
            for batch in batches:
                ids = batch.column(doc_id)
                for words in hasher.chunks(batch.column(text)):
                    rows = seeds.overlaps(words)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(rows[:, 0] + words.first)), item_ids.take(pa.array(rows[:, 1]))]
                            + [pa.array(rows[:, c]) for c in range(2, 6)], names=schema.names)

        parts.append(documents.select(doc_id, text).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], schema)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text",
                        item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` without the rows that overlap with an item; a map-side filter, nothing is shuffled."""
    kept = documents
    for block in benchmark_blocks(benchmark, item_id, item_text):
        shared = share_block(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds, hasher = seeds_of(shared), WordHasher()
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for words in hasher.chunks(batch.column(text)):
                    clean[seeds.overlaps(words)[:, 0] + words.first] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, kept.schema)
    return kept

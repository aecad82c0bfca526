"""Cross-entropy difference of texts under a target and a background language model.

Both models are word bigram models over one vocabulary: all words of the documents, and one entry for words that only
the target has. All bigrams count, and all counts are exact, so both models grow with the corpus.

``p(w | v) = (c(v, w) + (c(v) - kept(v) + MU) p(w)) / (c(v) + MU)``, where ``kept(v)`` adds up the bigrams that
begin with ``v``; unigrams get half a count extra. Background counts are scaled to the target's number of words, so that
both are smoothed alike. A text scores the mean over its words of the loss (natural log) under the target
less that under the background: the lower, the nearer to the target.

No task holds a whole model, and nothing is one row per occurrence. Texts are written once as blocks of about
``BLOCK_WORDS`` words: the block's different words and, word by word, which of them it is. A block sends each of its
different words and bigrams once, with its own count, packed by ranges of hashes. What meets in a range is counted
there, and the counts of both sides go back to the block in the order it sent them. So a frequent word is one entry a
block, like any other, and each text's losses are added up in one place, as whole numbers; the layout of the files
has no effect. A range holds about ``RANGE_VALUES`` entries at most, so both blocks and ranges grow in number with the
words, not in size.

``share`` is for callers who want smaller models: words and bigrams below half that share of all words are then
left out (words as one entry for all others, bigrams with a count of 0). It is 0 unless given. ``hot_share`` has no
effect any more: no entry needs a way of its own.

Defined results: a text without words (NULL, empty) has 0 words and NULL losses. NULL ids are scored like
others. If the target is empty, both models are uniform over what is left of the vocabulary and the
background. Repeated rows count and score as often as they stand. Other columns pass through; columns named
like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .frequent import named_candidates
from .joins import join_counted
from .words import Members, WordHasher, Words, mix

HOT_SHARE = 2e-6
MU = 20.0
ONE = np.uint64(1)
#: Losses are whole multiples of one part in ``UNITS``.
UNITS = float(1 << 26)
SUMS = "key long, words long, b long, t long"
SIDES = ("b", "t")
#: What a block of documents learns of each of its words and bigrams; ``ends`` counts words that no other one follows.
COUNTS = ("b", "b_ends", "t", "t_ends")
BLOCK_WORDS = 1 << 20
RANGE_VALUES = 1 << 22


def word_values(words: Words) -> np.ndarray:
    """Words as even values."""
    return words.hashes & ~ONE


def second_places(words: Words) -> np.ndarray:
    """The places of all words that follow another one of their text."""
    second = np.ones(len(words.hashes), bool)
    second[words.bounds[:-1][np.diff(words.bounds) > 0]] = False
    return np.flatnonzero(second)


def bigram_values(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams inside a text as odd values, and the place of each second word."""
    places = second_places(words)
    return mix(words.hashes[places - 1] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[places]) | ONE, places


def model_extract():
    hasher = WordHasher()

    def extract(texts: pa.Array):
        for words in hasher.chunks(texts):
            yield np.concatenate([word_values(words), bigram_values(words)[0]]), len(words.hashes)

    return extract


class Vocabulary:
    """Places of words and bigrams in sorted arrays; the place after the last word stands for all other words."""

    def __init__(self, values: np.ndarray) -> None:
        even = (values & ONE) == 0
        self.words, self.bigrams = Members(values[even]), Members(values[~even])
        self.size = len(self.words.values)

    def word_places(self, values: np.ndarray) -> np.ndarray:
        ids = np.full(len(values), self.size)
        at, which = self.words.find(values)
        ids[at] = which
        return ids

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word places, bigram places (-1 for none) by second word, and which words have one before them."""
        values, places = bigram_values(words)
        pairs = np.full(len(words.hashes), -1)
        at, which = self.bigrams.find(values)
        pairs[places[at]] = which
        return self.word_places(word_values(words)), pairs, places


def count_model(texts: DataFrame, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of words (others last) and bigrams, and the kept bigrams by first word, over all ``texts``."""
    shared = texts.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, hasher = Vocabulary(shared.value), WordHasher()
        counts = [np.zeros(n, np.int64) for n in (vocabulary.size + 1, len(vocabulary.bigrams.values), vocabulary.size + 1)]
        for batch in batches:
            for words in hasher.chunks(batch.column(0)):
                ids, pairs, _ = vocabulary.read(words)
                at = np.flatnonzero(pairs >= 0)
                for total, seen in zip(counts, (ids, pairs[at], ids[at - 1])):
                    total += np.bincount(seen, minlength=len(total))
        for kind, total in enumerate(counts):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int64)),
                                              pa.array(total[at])], names=["kind", "place", "n"])

    rows = texts.mapInArrow(run, "kind int, place long, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    words = int(((values & ONE) == 0).sum())
    found = []
    for kind, size in enumerate((words + 1, len(values) - words, words + 1)):
        mine = rows.filter(pc.equal(rows["kind"], kind))
        total = np.zeros(size, np.float64)
        total[mine["place"].to_numpy()] = mine["n"].to_numpy()
        found.append(total)
    return tuple(found)


@dataclass
class Smoothing:
    """The sizes of both sides: entries of the vocabulary, and words of the documents and of the target."""

    entries: int
    totals: tuple[int, int]

    def losses(self, words: np.ndarray, before: np.ndarray, joint: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Losses in ``UNITS`` for both sides, by the counts of words, of those before them and of both together.

        ``words`` and ``before`` have two rows for each side: how often a word stands, and how often with a kept bigram.
        """
        goal, found = self.totals[1] or self.totals[0], []
        for side, total in enumerate(self.totals):
            scale = goal / max(1, total)
            single = (words[2 * side] * scale + 0.5) / (total * scale + 0.5 * self.entries)
            below = before[2 * side] * scale + MU
            rest = (before[2 * side] - before[2 * side + 1]) * scale + MU
            chance = np.where(first, single, (joint[side] * scale + rest * single) / below)
            found.append(np.rint(-np.log(chance) * UNITS).astype(np.int64))
        return found


@dataclass
class Models(Smoothing):
    """Models of a bounded number of words and bigrams, which go to all tasks.

    ``words`` has the rows that ``losses`` takes, and a last column for all other words; ``bigrams`` has one row for each side.
    """

    values: np.ndarray
    words: np.ndarray
    bigrams: np.ndarray


def text_sums(losses: list[np.ndarray], bounds: np.ndarray) -> list[pa.Array]:
    """The losses of each side added up text by text."""
    sums = []
    for each in losses:
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        sums.append(pa.array(upto[bounds[1:]] - upto[bounds[:-1]]))
    return sums


def pruned_sums(documents: DataFrame, models: Models) -> DataFrame:
    """``key, words, b, t`` of each text: its words and their losses."""
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, hasher = shared.value, WordHasher()
        vocabulary = Vocabulary(models.values)
        for batch in batches:
            for words in hasher.chunks(batch.column(1)):
                ids, pairs, places = vocabulary.read(words)
                first = np.ones(len(ids), bool)
                first[places] = False
                before = ids[np.maximum(np.arange(len(ids)) - 1, 0)]
                joint = np.zeros((2, len(ids)))
                joint[:, pairs >= 0] = models.bigrams[:, pairs[pairs >= 0]]
                sums = text_sums(models.losses(models.words[:, ids], models.words[:, before], joint, first), words.bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.texts),
                                                  pa.array(np.diff(words.bounds).astype(np.int64)), *sums], names=["key", "words", *SIDES])

    return documents.mapInArrow(run, SUMS)


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all lowest bytes first, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def packed_blocks(texts: DataFrame, side: int) -> DataFrame:
    """``key, _text`` as blocks of whole texts: the different words, each word's place among them, words of each text, keys."""
    size = BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, sizes, keys, held = WordHasher(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            values, ids = np.unique(np.concatenate(parts), return_inverse=True)
            row = [[side], [len(ids)], [pack_sorted(values)], [pack(ids.astype(np.int64))],
                   [pack(np.concatenate(sizes).astype(np.int64))], [pack(np.concatenate(keys))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(row, (
                pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["side", "words", "vocabulary", "ids", "sizes", "keys"])

        for batch in batches:
            for words in hasher.chunks(batch.column(1)):
                parts.append(word_values(words))
                sizes.append(np.diff(words.bounds))
                keys.append(np.asarray(batch.column(0).slice(words.first, words.texts)))
                held += len(words.hashes)
                if held >= size:
                    yield flush()
                    parts, sizes, keys, held = [], [], [], 0
        if parts:
            yield flush()

    return texts.mapInArrow(run, "side int, words long, vocabulary binary, ids binary, sizes binary, keys binary")


class Block:
    """The words of a packed block and its entries: different words and bigrams, sorted."""

    def __init__(self, vocabulary: bytes, ids: bytes, sizes: bytes) -> None:
        words, self.ids, sizes = unpack_sorted(vocabulary), unpack(ids), unpack(sizes)
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.first = np.zeros(len(self.ids), bool)
        self.first[self.bounds[:-1][sizes > 0]] = True
        at = np.flatnonzero(~self.first)
        self.last = self.bounds[1:][sizes > 0] - 1
        pairs, self.pair_ids = np.unique(
            mix(words[self.ids[at - 1]] * np.uint64(0x9E3779B97F4A7C15) + words[self.ids[at]]) | ONE, return_inverse=True)
        self.values = np.concatenate([words, pairs])
        self.order = np.argsort(self.values, kind="stable")
        self.values, self.words = self.values[self.order], len(words)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each entry stands, and how often as the last word of a text."""
        times = np.concatenate([np.bincount(self.ids, minlength=self.words),
                                np.bincount(self.pair_ids, minlength=len(self.values) - self.words)])
        ends = np.bincount(self.ids[self.last], minlength=len(self.values))
        return times[self.order], ends[self.order]

    def losses(self, smoothing: Smoothing, found: np.ndarray) -> list[np.ndarray]:
        """The losses of all words by the ``COUNTS`` of the entries."""
        placed = np.empty(found.shape)
        placed[:, self.order] = found
        placed[1, :self.words] = placed[0, :self.words] - placed[1, :self.words]  # from ends to words that another one follows
        placed[3, :self.words] = placed[2, :self.words] - placed[3, :self.words]
        joint = np.zeros((2, len(self.ids)))
        joint[:, ~self.first] = placed[::2, self.words + self.pair_ids]
        before = self.ids[np.maximum(np.arange(len(self.ids)) - 1, 0)]
        return smoothing.losses(placed[:, self.ids], placed[:, before], joint, self.first)


def entries(packed: DataFrame, ranges: int) -> DataFrame:
    """``range, block, side`` and the entries of a block in that range of values, with their counts in the block."""
    starts = np.array([-((-k << 64) // ranges) for k in range(ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, side, *fields in zip(*[column.to_pylist() for column in batch.columns]):
                block = Block(*fields)
                cuts = np.append(np.searchsorted(block.values, starts), len(block.values)).tolist()
                times, ends = block.counts()
                full = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
                part = [slice(cuts[k], cuts[k + 1]) for k in full]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array([side] * len(full), pa.int32()),
                    pa.array([pack_sorted(block.values[p]) for p in part], pa.binary()),
                    pa.array([pack(times[p]) for p in part], pa.binary()), pa.array([pack(ends[p]) for p in part], pa.binary()),
                ], names=["range", "block", "side", "entries", "times", "ends"])

    return packed.select("block", "side", "vocabulary", "ids", "sizes").mapInArrow(
        run, "range int, block long, side int, entries binary, times binary, ends binary")


def counted(sent: DataFrame) -> DataFrame:
    """``block, range`` and ``COUNTS`` of what each block of documents sent; each range's number of words of documents at no block."""

    def run(table: pa.Table) -> pa.Table:
        values = [unpack_sorted(x.as_buffer()) for x in table["entries"]]
        bounds = np.cumsum([0, *map(len, values)])
        found, which = np.unique(np.concatenate(values), return_inverse=True)
        side = np.repeat(np.asarray(table["side"]), np.diff(bounds))
        values = None
        times, ends = (np.concatenate([unpack(x.as_buffer()) for x in table[c]]) for c in ("times", "ends"))
        totals = [np.bincount(which[mine], n[mine], len(found)).astype(np.int64) for mine in (side == 0, side == 1) for n in (times, ends)]
        own = np.flatnonzero(np.asarray(table["side"]) == 0).tolist()
        known = int(np.count_nonzero((totals[0] > 0) & ((found & ONE) == 0)))
        rows = [which[bounds[k]:bounds[k + 1]] for k in own]
        columns = [pa.array([None, *[pack(total[at]) for at in rows]], pa.binary()) for total in totals]
        return pa.table([pa.concat_arrays([pa.array([None], pa.int64()), table["block"].take(pa.array(own, pa.int64())).combine_chunks()]),
                         pa.array([table["range"][0].as_py()] * (len(own) + 1), pa.int32()),
                         pa.array([known] + [0] * len(own), pa.int64()), *columns], names=["block", "range", "known", *COUNTS])

    return sent.groupBy("range").applyInArrow(run, "block long, range int, known long, " + ", ".join(f"{c} binary" for c in COUNTS))


def block_sums(packed: DataFrame, replies: DataFrame, smoothing: Smoothing) -> DataFrame:
    """``key, words, b, t`` of each text of the documents' blocks."""
    fields = ("vocabulary", "ids", "sizes", "keys")
    own = packed.where("side = 0").select("block", F.lit(-1).alias("range"), *fields, *[F.lit(None).cast("binary").alias(c) for c in COUNTS])
    told = replies.where("block IS NOT NULL").select("block", "range", *[F.lit(None).cast("binary").alias(c) for c in fields], *COUNTS)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        block = Block(*[table[c][0].as_buffer() for c in fields[:-1]])
        found = np.empty((len(COUNTS), len(block.values)))
        for row, name in zip(found, COUNTS):
            row[:] = np.concatenate([np.empty(0), *[unpack(x.as_buffer()) for x in table[name][1:]]])
        sums = text_sums(block.losses(smoothing, found), block.bounds)
        return pa.table([pa.array(unpack(table["keys"][0].as_buffer())), pa.array(np.diff(block.bounds)), *sums], names=["key", "words", *SIDES])

    return own.unionByName(told).groupBy("block").applyInArrow(run, SUMS)


def pruned_models(background: DataFrame, target: DataFrame, share: float) -> Models:
    """Models of the words and bigrams with half of ``share`` or more; all other words are one entry."""
    # Candidates for half of a share hold all that reach it, however the rows lie.
    values, units = named_candidates(background, model_extract, share / 2)
    exact = count_model(background, values)
    enough = np.concatenate([exact[0][:-1], exact[1]]) >= share / 2 * units
    even = (values & ONE) == 0
    values = np.concatenate([values[even], values[~even]])[enough]
    sides = [count_model(texts, values) for texts in (background, target)]
    words = np.stack([counts for single, _, kept in sides for counts in (single, kept)])
    return Models(words.shape[1], tuple(int(single.sum()) for single, _, _ in sides), values, words,
                  np.stack([double for _, double, _ in sides]))


def whole_sums(keyed: DataFrame, target: DataFrame) -> DataFrame:
    """``key, words, b, t`` of each text of ``keyed`` under models of all words and bigrams."""
    goal = target.select(F.lit(0).cast("long").alias("key"), "_text")
    packed = stage(packed_blocks(keyed, 0).unionByName(packed_blocks(goal, 1)).withColumn("block", F.monotonically_increasing_id()))
    held = {r["side"]: r["words"] for r in packed.groupBy("side").agg(F.sum("words").alias("words")).collect()}
    totals = (held.get(0, 0), held.get(1, 0))
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replies = stage(counted(entries(packed, max(tasks, -(-2 * sum(totals) // RANGE_VALUES)))))
    known = replies.agg(F.sum("known")).first()[0] or 0
    return block_sums(packed, replies, Smoothing(known + 1, totals))


def cross_entropy_difference(documents: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
                             share: float = 0.0, hot_share: float = HOT_SHARE) -> DataFrame:
    """``documents`` with ``n_words``, ``target_loss``, ``background_loss`` and ``difference``.

    The background model covers all of ``documents``, the target model all of ``target`` (a written table).
    """
    documents = documents.drop(*[c for c in ("n_words", "target_loss", "background_loss", "difference") if c != text])
    background, goal = documents.select(F.col(text).alias("_text")), target.select(F.col(target_text).alias("_text"))
    keyed = background.select(F.xxhash64("_text").alias("key"), "_text")
    sums = pruned_sums(keyed, pruned_models(background, goal, share)) if share else whole_sums(keyed, goal)
    # Equal texts have equal losses.
    summed = sums.groupBy("key").agg(F.count("*").alias("rows"), *[F.max(c).alias(c) for c in ("words", *SIDES)])
    loss = {c: F.when(F.col("words") > 0, F.col(c) / (F.lit(UNITS) * F.col("words"))) for c in SIDES}
    scores = stage(summed.select(F.col("key").cast("string").alias("_key"), F.col("rows").alias("_rows"), F.col("words").alias("n_words"),
                                 loss["t"].alias("target_loss"), loss["b"].alias("background_loss")))
    rows = scores.agg(F.sum("_rows")).first()[0] or 0
    made = documents.withColumn("_key", F.xxhash64(text).cast("string"))
    return join_counted(made, scores, "_key", "_rows", rows).drop("_key") \
        .withColumn("difference", F.col("target_loss") - F.col("background_loss"))

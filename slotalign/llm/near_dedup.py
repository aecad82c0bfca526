"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard.

* **Weights.** A shingle is a run of five words (a shorter text is one shingle). It weighs
  ``(1 + ln tf) * idf`` with an augmented idf between 1/2 and 1: ``1/2 + ln(N/df) / (2 ln N)`` for a shingle in
  ``df`` of the ``N`` documents, so 1 for one document and 1/2 for all. ``df`` is exact for every shingle.
* **Document frequencies.** Texts are written once as blocks of about ``BLOCK_WORDS`` words. A block sends each of
  its different shingles once, with the number of its texts that hold it, packed by ranges of hashes; what meets
  in a range is added up there, and the sums return in the order sent. So a frequent shingle is one entry a
  block, like any other, and blocks and ranges grow in number, not in size. A text keeps the frequencies of its shingles.
* **Samples.** Improved consistent weighted sampling: per hash, two texts draw the same sample with a
  probability equal to their weighted Jaccard similarity. Its three random numbers come from a table of
  2^16 triples, addressed by a hash of the shingle; the rest of the hash tells shingles apart.
* **Candidates.** 12 bands of 4 samples: a pair at 0.8 shares a band with a probability of 0.998. Texts of a
  band are compared with one leader; texts that are then still in different classes are compared too, in
  large bands after an exact filter on their rarest shingles. So a band of n copies costs about n
  comparisons, and no link between classes is lost however large the band.
* **Verification.** Exact weighted Jaccard of whole texts, at least 0.8. Classes are connected components.

Defined results: equal texts are one node from the start, so repeated rows and copies are in one class.
NULL and empty texts, and NULL ids, are in a class of their own (``class_id`` is the row's own id). Texts
without words are only in one class with equal texts. Ties go to the smallest id. Other columns pass
through; columns named like the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stage
from .components import connected_components
from .joins import join_counted
from .lm_score import pack, pack_sorted, unpack, unpack_sorted
from .words import Members, WordHasher, Words, distinct, mix, shingles

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles from this share of the documents on are few; ``frequent`` counts them alone. No weight depends on it.
SHARE = 0.01
BANDS, ROWS = 12, 4
TABLE_BITS = 16
SMALL_BUCKET = 8
RARER = 4
#: Pairs whose vectors a task holds at once.
PAIRS_HELD = 64
#: Words of a block, entries that meet in a range of hashes, and shingles that are sampled at once.
BLOCK_WORDS = 1 << 20
RANGE_VALUES = 1 << 21
SAMPLED = 1 << 15


def shingle_extract():
    """Distinct shingles per document, for the document frequencies."""
    hasher = WordHasher()

    def extract(texts: pa.Array):
        for words in hasher.chunks(texts):
            yield distinct(*shingles(words, SHINGLE))[0], words.texts

    return extract


class Weights:
    """Weights of shingles by their document frequencies: those that are told with a text, else the ones given here, else 1."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, documents: int) -> None:
        self.members, self.counts = Members(values), np.asarray(counts)
        self.scale = 2 * np.log(max(2, documents))

    def of(self, hashes: np.ndarray, times: np.ndarray, frequencies: np.ndarray | None = None) -> np.ndarray:
        weights = np.ones(len(hashes))
        repeated = np.flatnonzero(times > 1)
        weights[repeated] += np.log(times[repeated])
        if frequencies is None:
            places, which = self.members.find(hashes)
            counts = self.counts[which]
        else:
            places = np.flatnonzero(frequencies > 1)
            counts = frequencies[places]
        weights[places] *= 1 - np.log(counts) / self.scale
        return weights

    def vectors(self, words: Words, told: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct shingles, their weights and the bounds of each text; ``told`` has the packed frequencies of the texts."""
        hashes, times, bounds = distinct(*shingles(words, SHINGLE))
        known = told is not None and not told.null_count
        frequencies = np.concatenate([np.empty(0, np.int64), *[unpack(x.as_buffer()) for x in told]]) if known else None
        return hashes, self.of(hashes, times, frequencies), bounds


class Sampler:
    """Consistent weighted samples of weighted shingles, hashed band by band."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        rng = np.random.default_rng(2010)  # a fixed value, the same in all tasks
        size = 1 << TABLE_BITS
        self.r, self.beta = rng.gamma(2.0, 1.0, size), rng.random(size)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size))
        self.bands, self.rows = bands, rows
        self.multipliers = rng.integers(0, 1 << 63, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.unit_keys = self.sample_keys(np.arange(size), np.zeros(size))[0]

    def sample_keys(self, places: np.ndarray, log_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The quantity to minimise in the upper half of a key, and the quantised weight ``t``."""
        r, beta = self.r[places], self.beta[places]
        t = np.floor(log_weights / r + beta)
        log_a = (self.log_c[places] - r * (t - beta + 1)).astype(np.float32)
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # sorts like the numbers
        return ordered.astype(np.uint64) << np.uint64(32), t

    def bands_of(self, hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row of band hashes per text that has shingles."""
        starts = bounds[:-1][np.diff(bounds) > 0]
        heavy = np.flatnonzero(weights != 1.0)
        log_weights = np.log(weights[heavy])
        low_half, shift = np.uint64(0xFFFFFFFF), np.uint64(64 - TABLE_BITS)
        out = np.empty((len(starts), self.bands), np.uint64)
        for band in range(self.bands):
            total = np.full(len(starts), band, np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                spread = hashes * self.multipliers[k]
                keys = self.unit_keys[spread >> shift]
                if len(heavy):
                    keys[heavy], t = self.sample_keys((spread[heavy] >> shift).astype(np.int64), log_weights)
                    spread[heavy] ^= mix(t.astype(np.int64).view(np.uint64))
                keys |= spread & low_half
                total = mix(total ^ np.minimum.reduceat(keys, starts))
            out[:, band] = total
        return out


def with_node(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with ``node``, the MD5 of a text with any content, else NULL."""
    return documents.withColumn("node", F.when(F.length(text) > 0, F.unhex(F.md5(F.col(text).cast("binary")))))


def packed_blocks(texts: DataFrame) -> DataFrame:
    """``node, _text`` as blocks of whole texts: the different words, each word's place among them, words of each text, nodes."""
    size = BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, sizes, nodes, held = WordHasher(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            values, ids = np.unique(np.concatenate(parts), return_inverse=True)
            row = [[len(ids)], [pack_sorted(values)], [pack(ids.astype(np.int64))],
                   [pack(np.concatenate(sizes).astype(np.int64))], [b"".join(nodes)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(row, (pa.int64(), *[pa.binary()] * 4))],
                                              names=["words", "vocabulary", "ids", "sizes", "nodes"])

        for batch in batches:
            for words in hasher.chunks(batch.column("_text")):
                parts.append(words.hashes)
                sizes.append(np.diff(words.bounds))
                nodes += batch.column("node").slice(words.first, words.texts).to_pylist()
                held += len(words.hashes)
                if held >= size:
                    yield flush()
                    parts, sizes, nodes, held = [], [], [], 0
        if held:
            yield flush()

    return texts.select("node", "_text").mapInArrow(run, "words long, vocabulary binary, ids binary, sizes binary, nodes binary")


class Block:
    """The different shingles of a packed block: of each text, and of all of them, sorted, with the texts that hold them."""

    def __init__(self, vocabulary: bytes, ids: bytes, sizes: bytes) -> None:
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(unpack(sizes))])
        words = Words(0, unpack_sorted(vocabulary)[unpack(ids)], bounds)
        self.hashes, self.times, self.bounds = distinct(*shingles(words, SHINGLE))
        self.values, self.which, self.texts = np.unique(self.hashes, return_inverse=True, return_counts=True)


def entries(packed: DataFrame, ranges: int) -> DataFrame:
    """``range, block`` and the shingles of a block in that range of hashes, with the number of its texts that hold them."""
    starts = np.array([-((-k << 64) // ranges) for k in range(ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *fields in zip(*batch.columns):
                block = Block(*[x.as_buffer() for x in fields])
                cuts = np.append(np.searchsorted(block.values, starts), len(block.values)).tolist()
                full = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
                part = [slice(cuts[k], cuts[k + 1]) for k in full]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([number.as_py()] * len(full), pa.int64()),
                    pa.array([pack_sorted(block.values[p]) for p in part], pa.binary()),
                    pa.array([pack(block.texts[p]) for p in part], pa.binary())], names=["range", "block", "entries", "texts"])

    return packed.select("block", "vocabulary", "ids", "sizes").mapInArrow(run, "range int, block long, entries binary, texts binary")


def counted(sent: DataFrame) -> DataFrame:
    """``block, range, frequencies``: over all blocks, of what each block sent."""

    def run(table: pa.Table) -> pa.Table:
        values = [unpack_sorted(x.as_buffer()) for x in table["entries"]]
        bounds = np.cumsum([0, *map(len, values)]).tolist()
        found, which = np.unique(np.concatenate(values), return_inverse=True)
        values = None
        texts = np.concatenate([unpack(x.as_buffer()) for x in table["texts"]])
        totals = np.bincount(which, texts, len(found)).astype(np.int64)
        return pa.table([table["block"], table["range"],
                         pa.array([pack(totals[which[i:j]]) for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())],
                        names=["block", "range", "frequencies"])

    return sent.groupBy("range").applyInArrow(run, "block long, range int, frequencies binary")


def signatures(texts: DataFrame, share_weights) -> DataFrame:
    """``node, bands, frequencies`` of every text of ``node, _text`` that has words, by the frequencies over all of them."""
    packed = stage(packed_blocks(texts).withColumn("block", F.monotonically_increasing_id()))
    number = packed.agg(F.sum("words")).first()[0] or 0
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    replies = stage(counted(entries(packed, max(tasks, -(-number // RANGE_VALUES)))))
    fields = ("vocabulary", "ids", "sizes", "nodes")
    own = packed.select("block", F.lit(-1).alias("range"), *fields, F.lit(None).cast("binary").alias("frequencies"))
    told = replies.select("block", "range", *[F.lit(None).cast("binary").alias(c) for c in fields], "frequencies")
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
                           T.StructField("frequencies", T.BinaryType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        block, nodes = Block(*[table[c][0].as_buffer() for c in fields[:-1]]), table["nodes"][0].as_py()
        frequencies = np.concatenate([unpack(x.as_buffer()) for x in table["frequencies"][1:]])[block.which]
        weights, sampler = Weights(*share_weights.value).of(block.hashes, block.times, frequencies), Sampler()
        full, bands = np.flatnonzero(np.diff(block.bounds) > 0).tolist(), []
        start, texts = 0, len(block.bounds) - 1
        while start < texts:
            stop = max(start + 1, int(np.searchsorted(block.bounds, block.bounds[start] + SAMPLED, side="right")) - 1)
            low, high = block.bounds[start], block.bounds[stop]
            if high > low:
                bands.append(sampler.bands_of(block.hashes[low:high], weights[low:high], block.bounds[start:stop + 1] - low))
            start = stop
        bands = np.concatenate(bands).view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.ravel()))
        return pa.table([pa.array([nodes[16 * d:16 * d + 16] for d in full], pa.binary()), lists,
                         pa.array([pack(frequencies[block.bounds[d]:block.bounds[d + 1]]) for d in full], pa.binary())],
                        names=["node", "bands", "frequencies"])

    return own.unionByName(told).groupBy("block").applyInArrow(run, schema)


def with_frequencies(texts: DataFrame) -> DataFrame:
    """``texts`` with ``frequencies``, which are NULL where ``texts`` has none."""
    return texts if "frequencies" in texts.columns else texts.withColumn("frequencies", F.lit(None).cast("binary"))


def weighted_jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights of two sorted vectors."""
    _, at, other = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    shared = np.minimum(left[1][at], right[1][other]).sum()
    total = left[1].sum() + right[1].sum() - shared
    return float(shared / total) if total > 0 else 0.0


def verify(pairs: DataFrame, texts: DataFrame, share_weights) -> DataFrame:
    """The similarity of pairs ``a, b`` (``a`` may be in very many of them, ``b`` in few)."""
    texts = with_frequencies(texts)
    left = texts.select(F.col("node").alias("a"), F.col("_text").alias("_left"), F.col("frequencies").alias("_left_told"))
    right = texts.select(F.col("node").alias("b"), F.col("_text").alias("_right"), F.col("frequencies").alias("_right_told"))
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()),
                           T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hasher = Weights(*share_weights.value), WordHasher()

        def vectors(texts: pa.Array, told: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            found = []
            for words in hasher.chunks(texts):
                hashes, each, bounds = weights.vectors(words, told.slice(words.first, words.texts))
                found += [(hashes[i:j], each[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
            return found

        for batch in batches:
            for start in range(0, batch.num_rows, PAIRS_HELD):
                part = batch.slice(start, PAIRS_HELD)
                values = [weighted_jaccard(x, y) for x, y in zip(
                    vectors(part.column("_left"), part.column("_left_told")), vectors(part.column("_right"), part.column("_right_told")))]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(values, pa.float64())],
                                                 names=schema.names)

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_left", "_right", "_left_told", "_right_told") \
        .mapInArrow(run, schema)


def weighted_shingles(texts: DataFrame, share_weights) -> DataFrame:
    """``node, shingle, weight`` of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hasher = Weights(*share_weights.value), WordHasher()
        for batch in batches:
            for words in hasher.chunks(batch.column("_text")):
                hashes, each, bounds = weights.vectors(words, batch.column("frequencies").slice(words.first, words.texts))
                owner = words.first + np.repeat(np.arange(words.texts), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(owner)), pa.array(hashes.view(np.int64)),
                                                  pa.array(each)], names=["node", "shingle", "weight"])

    return with_frequencies(texts).select("node", "_text", "frequencies").mapInArrow(run, "node binary, shingle long, weight double")


def prefix_pairs(texts: DataFrame, placed: DataFrame, share_weights, similarity: float) -> DataFrame:
    """All pairs of ``placed`` (``node, component``) in different classes that can reach ``similarity``.

    Shingles are put in one order, rarest first. If two texts are similar enough, what is left of both from
    their first common shingle on must weigh at least the overlap that this takes. So only the first few
    shingles of a text are joined, those with enough weight left; a shingle of one text only meets nothing and is left
    out. Of a shingle's texts those in its most frequent class need not meet each other and are only on one side of the join.
    """
    rows = stage(weighted_shingles(texts.join(placed.select("node"), "node", "left_semi"), share_weights))
    ranked = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("df")), "shingle")
    own = Window.partitionBy("node")
    commonest = own.orderBy(F.desc("df"), F.desc("shingle"))
    rest = F.sum("weight").over(commonest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = ranked.select("node", "shingle", "df", F.sum("weight").over(own).alias("total"), rest.alias("rest"))
    first = sums.where((F.col("rest") >= (similarity - 1e-9) * F.col("total")) & (F.col("df") > 1))
    # The next rarer shingles of the text, a bounded number whatever its length.
    rarer = F.collect_list("shingle").over(commonest.rowsBetween(1, RARER))
    prefix = stage(first.withColumn("rarer", rarer).drop("df").join(placed, "node"))
    by_class = prefix.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    main = by_class.groupBy("shingle").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("all"))
    shared = prefix.join(main.where("all > 1"), "shingle")
    right = prefix.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "total", "rest", "rarer")])
    enough = F.least("rest", "rest_b") >= (F.col("total") + F.col("total_b")) * (similarity / (1 + similarity) - 1e-9)
    # A pair with a common shingle just before this one is found there; the few that are found again fall to distinct().
    here = ~F.arrays_overlap("rarer", "rarer_b")
    return shared.where("component != main").join(right, "shingle").where("component != component_b").where(enough & here) \
        .select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def verified_links(buckets: DataFrame, texts: DataFrame, share_weights, similarity: float) -> DataFrame:
    """``node, component`` of linked texts: the classes that all similar pairs of each bucket (``bucket, node``) make.

    First, all texts of a bucket meet its leader, the one that shares most buckets with others: the
    original of a group of altered copies, as a rule. Then small buckets compare what is still apart, and
    texts of larger buckets that are still apart go through ``prefix_pairs``, which misses none.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    degrees = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = buckets.join(degrees, "node").groupBy("bucket").agg(
        F.count("*").alias("n"), F.max(F.struct("degree", "node"))["node"].alias("leader"))
    pairs = buckets.join(leaders, "bucket").where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    compared = stage(verify(pairs.distinct(), texts, share_weights))
    links = compared.where(F.col("similarity") >= similarity).select("a", "b")
    classes = connected_components(links)
    placed = buckets.join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    still_apart = placed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 AND low < high")
    members = stage(placed.join(still_apart.select("bucket", "n"), "bucket"))
    small = members.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("node").alias("b"), F.col("component").alias("component_b"))
    crossing = small.join(other, "bucket").where("node < b AND component != component_b").select(F.col("node").alias("a"), "b").distinct()
    large = members.where(F.col("n") > SMALL_BUCKET).select("node", "component").distinct()
    if large.take(1):
        crossing = crossing.unionByName(prefix_pairs(texts, stage(large), share_weights, similarity)).distinct()
    known = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = stage(verify(crossing.join(known, ["a", "b"], "left_anti"), texts, share_weights))
    more = fresh.where(F.col("similarity") >= similarity).select("a", "b")
    return connected_components(links.unionByName(more)) if more.take(1) else classes


def node_classes(documents: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """``node, class_id, text_id`` of every text with content."""
    context = documents.sparkSession.sparkContext
    plain = documents.select(F.col(text).alias("_text")).where(F.length("_text") > 0)
    number = plain.count()
    share_weights = context.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64), number))
    signed = stage(signatures(with_node(plain, "_text"), share_weights))
    unique = signed.dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket"))
    shared = unique.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    buckets = stage(unique.join(shared, "bucket"))
    told = signed.select("node", "frequencies").join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    texts = stage(with_node(plain, "_text").join(told, "node").dropDuplicates(["node"]))
    classes = verified_links(buckets, texts, share_weights, similarity)

    rows = with_node(documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text").where("node IS NOT NULL")
    nodes = rows.groupBy("node").agg(F.min("_id").alias("text_id"), F.count("*").alias("_rows"))
    joined = nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("text_id").alias("class_id"))
    return stage(joined.join(smallest, "component").select("node", "class_id", "text_id", "_rows"))


def near_duplicate_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           similarity: float = SIMILARITY) -> DataFrame:
    """The ids and other columns of ``documents`` with ``class_id``, the smallest id of the class, and
    ``text_id``, the smallest id with an equal text."""
    named = node_classes(documents, doc_id, text, similarity)
    rows = with_node(documents.drop("class_id", "text_id", "node"), text).drop(text)
    joined = join_counted(rows, named, "node", "_rows", documents.count())
    own = F.col(doc_id)
    return joined.drop("node").withColumns({
        c: F.when(own.isNotNull(), F.coalesce(c, own)) for c in ("class_id", "text_id")})


def keep_one_of_each_class(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row of each class: that of the smallest id, or of a NULL id if there is no other."""
    named = node_classes(documents, doc_id, text, similarity)
    ids = with_node(documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text") \
        .where("node IS NOT NULL").select("_id", "node")
    later = join_counted(ids, named, "node", "_rows", documents.count()).where(
        "_id > class_id OR (_id IS NULL AND class_id IS NOT NULL)").select(F.struct("_id", "node").alias("_row")).distinct()
    # One key for both steps, so that whole documents move once.
    keyed = with_node(documents.withColumn("_id", F.col(doc_id)), text).withColumn("_row", F.struct("_id", "node"))
    return keyed.join(later, "_row", "left_anti").dropDuplicates(["_row"]).select(*documents.columns)

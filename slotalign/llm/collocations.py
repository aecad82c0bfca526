"""Collocations: phrases that occur more often than their parts suggest, per language, by top-order marginalisation.

Only the longest windows are counted: at every word, the word and the ones that lead it by one, two and three, padded
at the end of a piece. Every shorter phrase is a prefix of such windows, so its count is a sum over them, which Spark's
ROLLUP forms level by level. No n-grams of other lengths are ever made.

Windows are many and mostly different, so they travel packed: a task counts equal windows of a block and writes, per
part, one record with the block's words and the windows as compressed numbers (a few bytes each). Parts are told by the
first two words, so a part knows its pairs' and triples' full counts, and folds windows whose prefix stays rare into a padded one
before the ROLLUP. Pairs and triples that would make up a great share of a part are found first (``frequent``); their
windows are spread by a further word each and not folded at that level. Parts are as many as the corpus needs, so a group is bounded.

Defined results: a NULL or empty text has no words; a NULL language counts as ``und``, as one named so does; repeated rows
count each; ties go to the smaller phrase; empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .arrow import small_slices
from .frequent import named_candidates
from .joins import join_counted
from .slices import Block, blocks, runs
from .words import BASE, Members, mix, powers_of

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
FACTOR = 2_000_000
# A candidate goes if a longer one around it is at least this many hundredths as frequent.
COVERED = 80
UNKNOWN = "und"
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CUT = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
AHEAD = re.compile(rb"(?:[\x20\x09]*[^\x20\x09.,;:!?\x0A-\x0D]+){0,%d}" % (LONGEST - 1))
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

# Windows of a block that are packed together, and windows of a part.
BLOCK_WINDOWS = 1 << 20
PART_WINDOWS = 1 << 20
# Pairs and triples with this share of a part's windows are spread, and some less frequent ones; a few dozen per part at most.
HOT_SHARE = 0.5
HOT_BASE = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """Lead windows of blocks of text: word numbers of a dictionary, 0 for padding; make one per task."""

    def __init__(self) -> None:
        kind = np.zeros(256, np.int8)
        kind[list(BLANKS)] = 1
        kind[list(BREAKS)] = 2
        self.kind = kind

    def words(self, block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Words, the piece between breaks of each, its text, and whether its window is the block's own."""
        data = block.data.translate(UPPER_TO_LOWER)
        values = np.frombuffer(data, np.uint8)
        kind = self.kind[values]
        starts, ends = runs(kind == 0)
        segment = np.cumsum(kind == 2)[starts] if len(starts) else starts
        piece = np.searchsorted(block.starts, starts, side="right") - 1
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        content = values[kind == 0].tobytes()
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(content))
        return words, segment, block.texts[piece], starts < block.owned[piece]

    def leads(self, block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words, the windows (one row per lead) and the text of each window."""
        words, segment, text, own = self.words(block)
        encoded = words.dictionary_encode()
        numbers = np.asarray(encoded.indices) + np.int32(1)
        columns = np.zeros((LONGEST, len(numbers)), np.int32)
        for step in range(min(LONGEST, len(numbers))):
            stop = len(numbers) - step
            columns[step, :stop] = np.where(segment[step:] == segment[:stop], numbers[step:], 0)
        return encoded.dictionary, columns[:, own], text[own]


def word_hashes(words: pa.Array, used: np.ndarray | None = None) -> np.ndarray:
    """A hash per dictionary word (of the ``used`` numbers only, if given) that is the same in all tasks; 0 stands for padding.

    Equal hashes of different words only bring their windows to the same part.
    """
    made = np.full(len(words) + 1, mix(np.ones(1, np.uint64))[0])
    used = np.arange(1, len(words) + 1) if used is None else used
    chosen = words.take(pa.array(used - 1))
    offsets = np.frombuffer(chosen.buffers()[1], np.int32)[chosen.offset:chosen.offset + len(chosen) + 1].astype(np.int64)
    if not len(chosen) or offsets[-1] == offsets[0]:
        return made
    data = np.frombuffer(chosen.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers_of(BASE, len(data)), out=sums[1:])
    back = powers_of(pow(BASE, -1, 1 << 64), len(data) + 1)
    made[used] = mix((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]])
    return made


def prefix_hashes(hashed: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first two, three and four words of windows, given those of the words."""
    pair = mix(hashed[columns[0]] * HOT_BASE + hashed[columns[1]])
    triple = mix(pair * HOT_BASE + hashed[columns[2]])
    return pair, triple, mix(triple * HOT_BASE + hashed[columns[3]])


def pairs_and_triples():
    """For ``frequent``: the hashes of the first two and three words of all windows; the windows are the units."""
    windows = Windows()

    def extract(texts: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
        for block in blocks(texts.to_pylist(), CUT, AHEAD):
            words, columns, _ = windows.leads(block)
            pair, triple, _ = prefix_hashes(word_hashes(words), columns)
            full = columns[2] > 0
            yield np.concatenate([pair[columns[1] > 0], triple[full]]), columns.shape[1]

    return extract


# ---- packed windows -------------------------------------------------------------------------


def squeeze(numbers: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(content: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(content, decompressed_size=4 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, count).T).view("<u4").ravel().astype(np.int64)


def sort_keys(columns: np.ndarray) -> list[np.ndarray]:
    """Columns of small numbers as few numbers that sort like them, the most significant last."""
    bits = int(columns.max(initial=0)).bit_length()
    each = max(1, 63 // max(bits, 1))
    keys = []
    for at in range(0, len(columns), each):
        key = columns[at].astype(np.int64)
        for column in columns[at + 1:at + each]:
            key <<= bits
            key |= column
        keys.append(key)
    return keys[::-1]


def distinct_rows(columns: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a (rows, n) array of small numbers in ascending order, and their summed weights."""
    if columns.shape[1] == 0:
        return columns, np.empty(0, np.int64)
    keys = sort_keys(columns)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for key in keys:
        ordered = key[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    at = np.flatnonzero(fresh)
    summed = np.diff(at, append=len(order)) if weights is None else np.add.reduceat(weights[order], at)
    return columns[:, order[at]], summed


def packed_part(part: int, lang: str, words: pa.Array, columns: np.ndarray) -> dict:
    """One record; its words are numbered by how often they are used, so the numbers are small."""
    if len(words) < 4 * columns.size:
        often = np.bincount(columns.ravel(), minlength=len(words) + 1)
        often[0] = 0
        used = np.flatnonzero(often)
        used = used[np.argsort(-often[used], kind="stable")]
        renamed = np.zeros(len(words) + 1, np.int64)
        renamed[used] = np.arange(1, len(used) + 1)
        columns = renamed[columns]
    else:
        used, inverse = np.unique(columns, return_inverse=True)
        columns, used = inverse.reshape(columns.shape) + (used[0] > 0), used[used > 0]
    columns, counts = distinct_rows(columns)
    text = "\n".join(words.take(pa.array(used - 1)).to_pylist()).encode()
    return {"part": part, "lang": lang, "n": columns.shape[1], "size": len(text), "words": pa.compress(text, codec="zstd", asbytes=True),
            "windows": squeeze(columns.ravel()), "counts": squeeze(counts)}


PACKED = "part long, lang string, n long, size long, words binary, windows binary, counts binary"
PACKED_ARROW = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("size", pa.int64()),
                          ("words", pa.binary()), ("windows", pa.binary()), ("counts", pa.binary())])


def pack_windows(frame: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """``lang, text`` as packed records per part; equal windows of a block are counted first."""
    shared = frame.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, members = Windows(), Members(shared.value)
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, made in held.items():
                for record in records(lang, made):
                    yield pa.RecordBatch.from_pylist([record], PACKED_ARROW)

        def records(lang: str, made: list[tuple[pa.Array, np.ndarray]]) -> Iterator[dict]:
            # One dictionary for the words of all blocks.
            joined = pa.concat_arrays([words for words, _ in made]).dictionary_encode()
            numbers, at = np.asarray(joined.indices) + np.int32(1), 0
            columns = np.empty((LONGEST, sum(block.shape[1] for _, block in made)), np.int32)
            seen, done = np.zeros(len(joined.dictionary) + 1, bool), 0
            for words, block in made:
                own = columns[:, done:done + block.shape[1]]
                own[:] = np.append(np.int32(0), numbers[at:at + len(words)])[block]
                seen[own] = True
                at, done = at + len(words), done + block.shape[1]
            used = np.flatnonzero(seen)
            hashed = word_hashes(joined.dictionary, used[used > 0])
            pair, triple, quad = prefix_hashes(hashed, columns)
            wide = members.find(pair)[0]
            pair[wide] = triple[wide]
            wider = wide[members.find(triple[wide])[0]]
            pair[wider] = quad[wider]
            # Small numbers sort in linear time.
            part = (pair % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.append(np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1)), len(order))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield packed_part(int(part[order[low]]), lang, joined.dictionary, columns[:, order[low:high]])

        for batch in batches:
            for piece in small_slices(batch):
                langs = np.array([UNKNOWN if v is None else v for v in piece.column("lang").to_pylist()], object)
                for block in blocks(piece.column("text").to_pylist(), CUT, AHEAD):
                    words, columns, text = windows.leads(block)
                    for lang in dict.fromkeys(langs[np.unique(block.texts)]):
                        own = columns[:, langs[text] == lang]
                        if own.shape[1]:
                            held.setdefault(lang, []).append((words, own))
                            total += own.shape[1]
                    if total >= BLOCK_WINDOWS:
                        yield from flush()
                        held, total = {}, 0
        yield from flush()

    return frame.mapInArrow(run, PACKED)


WINDOW_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]


def fold_windows(packed: DataFrame, parts: int, hot: np.ndarray, least: int) -> DataFrame:
    """``lang, w1 .., n``: windows that can be part of a phrase with ``least`` occurrences; others keep the prefix that can.

    A folded window still counts for every prefix it keeps. Padding is the empty word.
    """
    shared = packed.sparkSession.sparkContext.broadcast(hot)

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        members, made = Members(shared.value), []
        by_lang: dict[str, list[dict]] = {}
        for row in table.select(["lang", "n", "size", "words", "windows", "counts"]).to_pylist():
            by_lang.setdefault(row["lang"], []).append(row)
        for lang, rows in by_lang.items():
            made.append(of_lang(lang, rows, members))
        return pa.concat_tables(made)

    def of_lang(lang: str, rows: list[dict], members: Members) -> pa.Table:
        names, columns, counts = [], [], []
        for row in rows:
            text = pa.decompress(row["words"], decompressed_size=row["size"], codec="zstd", asbytes=True).decode()
            names.append(pa.array(text.split("\n") if text else [], pa.string()))
            columns.append(expand(row["windows"], LONGEST * row["n"]).reshape(LONGEST, -1).astype(np.int32))
            counts.append(expand(row["counts"], row["n"]))
        joined = pa.concat_arrays(names).dictionary_encode()
        numbers, at = np.asarray(joined.indices) + np.int32(1), 0
        for i, part in enumerate(names):
            columns[i] = np.append(np.int32(0), numbers[at:at + len(part)])[columns[i]]
            at += len(part)
        merged, total = distinct_rows(np.concatenate(columns, axis=1), np.concatenate(counts))
        pair, triple, _ = prefix_hashes(word_hashes(joined.dictionary), merged)
        open_pair, open_triple = np.zeros(len(total), bool), np.zeros(len(total), bool)
        open_pair[members.find(pair)[0]] = True
        open_triple[members.find(triple)[0]] = True
        # From the longest prefix to the shortest; what is open may be frequent by windows of other parts.
        whole = [True, open_pair, open_triple & open_pair]
        for size, elsewhere in ((2, whole[1]), (3, whole[2]), (4, False)):
            rare = (prefix_sums(merged, total, size) < least) & ~np.asarray(elsewhere)
            merged[size - 1:, rare] = 0
        merged, total = distinct_rows(merged, total)
        words = pa.concat_arrays([pa.array([""]), joined.dictionary])
        return pa.table([pa.array([lang] * len(total), pa.string()), *[words.take(pa.array(c)) for c in merged], pa.array(total)],
                        names=["lang", *WINDOW_COLUMNS, "n"])

    schema = ", ".join(["lang string", *[f"{c} string" for c in WINDOW_COLUMNS], "n long"])
    return packed.repartition(parts, "part").groupBy("part").applyInArrow(fold, schema)


def prefix_sums(ordered: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """For windows in ascending order, the sum over all that begin with the same ``size`` words."""
    head = ordered[:size]
    fresh = np.append(True, (head[:, 1:] != head[:, :-1]).any(axis=0)) if len(total) else np.empty(0, bool)
    at = np.flatnonzero(fresh)
    return np.add.reduceat(total, at)[np.cumsum(fresh) - 1] if len(total) else total


# ---- phrases --------------------------------------------------------------------------------


def hot_share(texts: DataFrame) -> float:
    """``HOT_SHARE`` of a part as a share of all windows, or less: there is at most a window for every two bytes."""
    read = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("texts")).first()
    return min(1.0, HOT_SHARE * PART_WINDOWS / ((read["bytes"] or 0) // 2 + read["texts"] + 1))


def frequent_phrases(frame: DataFrame, least: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, words, f`` of all phrases of 1 to 4 words with ``least`` occurrences; no words for the number of words in all."""
    texts = frame.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    hot, windows = named_candidates(texts.select("text"), pairs_and_triples, hot_share(texts))
    parts = max(1, math.ceil(windows / PART_WINDOWS))
    folded = fold_windows(pack_windows(texts, parts, hot), parts, hot, least)
    levels = frame.sparkSession.sql(f"""
        SELECT lang, {', '.join(WINDOW_COLUMNS)}, sum(n) AS f FROM {{folded}}
        GROUP BY lang, ROLLUP({', '.join(WINDOW_COLUMNS)})""", folded=folded)
    # A rolled-up word is NULL and a padded one empty; a padded prefix is no phrase of its level.
    words = F.array_compact(F.array(*WINDOW_COLUMNS))
    return levels.select("lang", words.alias("words"), "f").where(
        ~F.array_contains("words", "") & ((F.col("f") >= least) | (F.size("words") == 0)))


def phrase_of(words: F.Column) -> F.Column:
    return F.array_join(words, " ")


def phrase_key(lang: F.Column, phrase: F.Column) -> F.Column:
    """One text per language and phrase; phrases hold no tab."""
    return F.concat(lang, F.lit("\t"), phrase)


def collocations(frame: DataFrame, least: int = MIN_COUNT, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` collocations of every language.

    ``score`` is the floored ``FACTOR * a / (l + r)`` of the worst cut of a phrase into two.
    """
    known = stage(frequent_phrases(frame, least, text, lang))
    phrases = stage(known.where(F.size("words") > 0).select(
        "lang", "words", phrase_key(F.col("lang"), phrase_of(F.col("words"))).alias("key"), "f"))
    candidates = phrases.where(F.size("words") > 1).select("lang", "words", "key", F.col("f").alias("a"))

    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = candidates.select("lang", "key", "a", "words", cut).select(
        "key", "a", "k", phrase_key(F.col("lang"), phrase_of(F.slice("words", F.lit(1), F.col("k")))).alias("left"),
        phrase_key(F.col("lang"), phrase_of(F.slice("words", F.col("k") + 1, F.size("words")))).alias("right"))
    cuts = stage(cuts)
    total = cuts.count()
    for side, name in (("left", "l"), ("right", "r")):
        # A frequent word ends very many phrases, so its cuts do not move.
        needed = cuts.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("_rows"))
        counts = stage(phrases.select("key", F.col("f").alias(name)).join(needed, "key").select(F.col("key").alias(side), name, "_rows"))
        cuts = join_counted(cuts, counts, side, "_rows", total)
    # Whole numbers of up to 38 digits; the quotient is exact.
    ratio = F.expr(f"(CAST(a AS DECIMAL(28, 0)) * {FACTOR}BD) div (CAST(l AS DECIMAL(28, 0)) + r)")
    worst = cuts.groupBy("key").agg(F.min(F.struct(ratio.alias("score"), "k", "l", "r")).alias("cut"))

    sizes = [(size, start) for size in range(2, LONGEST) for start in range(LONGEST - size + 1)]
    inner = F.array(*[F.when(F.size("words") >= F.lit(size + start), F.slice("words", start + 1, size)) for size, start in sizes])
    longer = candidates.where(F.size("words") > 2).select(
        "lang", "a", F.size("words").alias("size"), F.explode(F.array_compact(inner)).alias("inner")) \
        .where(F.size("inner") < F.col("size"))
    around = longer.groupBy(phrase_key(F.col("lang"), phrase_of(F.col("inner"))).alias("key")).agg(F.max("a").alias("most"))

    kept = candidates.join(around, "key", "left").where(
        F.col("most").isNull() | (F.col("most").cast("decimal(28,0)") * 100 < F.col("a").cast("decimal(28,0)") * COVERED))
    scored = kept.join(worst, "key").select(
        "lang", phrase_of(F.col("words")).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    everything = known.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(everything, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Token counts of whole texts, with huge texts encoded as overlapping chunks that resynchronise.

Texts of at most ``CHUNK_CHARS`` characters are encoded as they are, where they lie. Longer ones are cut into
chunks that overlap, the chunks are spread over the cluster and encoded with offsets, and neighbours are
spliced at a boundary that both encodings have. Such a boundary is proven if both have the same token on
either side of it, at the same places and away from both cut ends:

* Between pre-tokens: the pattern only looks forward, so from a common start on, both find the same matches.
* Inside a pre-token: a sequence of tokens is its encoding exactly when each two neighbours are the encoding of their
  joint bytes. The left encoding proves all pairs up to and over the boundary, the right one those from it on.
* Special strings are shorter than the distance kept from the cut ends, so both sides see them whole.
* Composed characters: the boundary stands before a character that never joins what precedes it.

Where two neighbours share no such boundary, the chunks between the next proven boundaries are counted by one
task that goes through them in order and doubles the overlap until a boundary is found, to the end of the text
if there is none. Every splice is exact, so chunk and overlap sizes change the work, never a count.

Defined results: a NULL or empty text has 0 bytes and 0 tokens; repeated rows are counted each, NULL or repeated
ids do not matter; other columns pass through, and one named like an output is replaced; empty tables give no rows.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stage
from .arrow import add_columns, small_slices

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 9
# Longer than any special string of the vocabulary; boundaries keep this distance from cut ends.
MARGIN_CHARS = 64


def load_tokenizer(content: bytes):
    """The library's tokenizer for a vocabulary file's content, single-threaded and without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    longest = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    if longest >= MARGIN_CHARS:
        raise ValueError(f"a special string of {longest} characters does not fit into the margin of {MARGIN_CHARS}")
    return tokenizer


@dataclass
class Encoded:
    """The tokens of ``text[start:end]``, with places in the whole text."""

    start: int
    end: int
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, tokenizer, piece: str, start: int) -> Encoded:
        encoding = tokenizer.encode(piece, add_special_tokens=False)
        places = np.array(encoding.offsets, np.int64).reshape(-1, 2) + start
        return cls(start, start + len(piece), np.array(encoding.ids, np.int64), places[:, 0], places[:, 1])

    def first_from(self, place: int) -> int:
        """The number of the first token that starts at ``place`` or later."""
        return int(np.searchsorted(self.starts, place))

    def boundaries(self, low: int, high: int, first_chars: Callable[[int], str]) -> np.ndarray:
        """Numbers of the tokens before which a splice may be, if both tokens lie in ``[low, high]``."""
        at = np.arange(max(1, self.first_from(low)), len(self.ids))
        at = at[(self.starts[at - 1] >= low) & (self.ends[at] <= high) & (self.ends[at - 1] <= self.starts[at])]
        return at[[stands_alone(first_chars(p)) for p in self.starts[at].tolist()]] if at.size else at

    def marks(self, at: np.ndarray) -> list[str]:
        """Texts that are equal for two encodings if the tokens on both sides of a boundary are."""
        columns = (self.starts[at - 1], self.ids[at - 1], self.starts[at], self.ids[at])
        return [":".join(map(str, row)) for row in zip(*(c.tolist() for c in columns))]


def stands_alone(char: str) -> bool:
    """Whether a character never combines with what stands before it."""
    if char < "̀":
        return True
    # Jamo vowels and finals join a leading jamo although they are letters.
    return unicodedata.category(char)[0] != "M" and not "ᅠ" <= char <= "ᇿ"


def seam(left: Encoded, right: Encoded, text: str) -> int | None:
    """A proven place at which ``right`` takes over from ``left``."""
    low, high = right.start + MARGIN_CHARS, left.end - MARGIN_CHARS
    first = text.__getitem__
    ours, theirs = left.boundaries(low, high, first), right.boundaries(low, high, first)
    known = set(right.marks(theirs))
    common = [at for at, mark in zip(ours.tolist(), left.marks(ours)) if mark in known]
    return int(left.starts[common[len(common) // 2]]) if common else None


def count_in_order(tokenizer, text: str, low: int = 0, high: int | None = None, chunk: int = CHUNK_CHARS,
                   overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` that start in ``[low, high)``, chunk after chunk, widening overlaps that do not align."""
    high, counted, begin = len(text) if high is None else high, 0, 0
    left = Encoded.of(tokenizer, text[:chunk], 0)
    while left.end < len(text):
        width, place = overlap, None
        while left.end < len(text):
            start = max(left.start, left.end - width)
            right = Encoded.of(tokenizer, text[start:start + max(chunk, 2 * width)], start)
            place = seam(left, right, text)
            if place is not None and place > begin:
                break
            width *= 2
            left = Encoded.of(tokenizer, text[left.start:left.end + width], left.start)
        else:
            break
        counted += within(left, max(begin, low), min(place, high))
        left, begin = right, place
    return counted + within(left, max(begin, low), high)


def within(encoded: Encoded, low: int, high: int) -> int:
    return max(0, encoded.first_from(high) - encoded.first_from(low))


def count_tokens(frame: DataFrame, vocabulary: str, text: str = "text", count: str = "n_tokens", size: str = "n_bytes",
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``frame`` with ``size`` (bytes, BIGINT) and ``count`` (tokens, BIGINT) of each text.

    ``vocabulary`` is a file of the ``tokenizers`` library. No tokens are added at the ends; special strings in a
    text are the tokens that the library makes of them.
    """
    if overlap <= 4 * MARGIN_CHARS or chunk <= 2 * overlap:
        raise ValueError("chunks must be longer than two overlaps, and overlaps than four margins")
    with open(vocabulary, "rb") as file:
        content = frame.sparkSession.sparkContext.broadcast(file.read())
    long_text = F.coalesce(F.char_length(text) > chunk, F.lit(False))
    short = add_columns(frame.where(~long_text), {count: T.LongType()}, lambda: count_batches(content, text))
    # Row numbers are pinned by writing; they only name rows.
    long = stage(frame.where(long_text).drop(count).withColumn("_row", F.monotonically_increasing_id()))
    names = [c for c in frame.columns if c not in (count, size)]
    bytes_of = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    counted = long_counts(long.select("_row", F.col(text).alias("_text")), content, chunk, overlap)
    whole = long.join(counted, "_row").select(*names, F.col("_tokens").alias(count), bytes_of.alias(size))
    return short.select(*names, count, bytes_of.alias(size)).unionByName(whole)


def count_batches(content, text: str) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    tokenizer = load_tokenizer(content.value)

    def each(part: pa.RecordBatch) -> list[pa.Array]:
        texts = [value or "" for value in part.column(text).to_pylist()]
        return [pa.array([len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], pa.int64())]

    return each


CHUNK_ROW = "_row long, no long, start long, piece string, final boolean"
ENCODED_ROW = ("_row long, no long, start long, end long, n long, head array<string>, head_at array<long>, "
               "tail array<string>, tail_at array<long>")


def long_counts(long: DataFrame, content, chunk: int, overlap: int) -> DataFrame:
    """``_row, _tokens`` of staged long texts; the chunks of one text are spread over all tasks."""
    step = chunk - overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = text.as_py()
                starts = range(0, max(len(value) - overlap, 1), step)
                for no, start in enumerate(starts):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row], pa.int64()), pa.array([no], pa.int64()), pa.array([start], pa.int64()),
                        pa.array([value[start:start + chunk]]), pa.array([no + 1 == len(starts)])],
                        names=["_row", "no", "start", "piece", "final"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(content.value)
        schema = pa.schema([(n, pa.int64()) for n in ("_row", "no", "start", "end", "n")] + [
            (n, pa.list_(t)) for part in ("head", "tail") for n, t in ((part, pa.string()), (f"{part}_at", pa.int64()))])
        for batch in batches:
            for part in small_slices(batch):
                yield pa.RecordBatch.from_pylist([encode_row(tokenizer, row) for row in part.to_pylist()], schema)

    def encode_row(tokenizer, row: dict) -> dict:
        start, piece = row["start"], row["piece"]
        made = Encoded.of(tokenizer, piece, start)
        zones = {"head": (start, start + overlap) if row["no"] else None,
                 "tail": None if row["final"] else (made.end - overlap, made.end)}
        out = {"_row": row["_row"], "no": row["no"], "start": start, "end": made.end, "n": len(made.ids)}
        for name, zone in zones.items():
            at = np.empty(0, np.int64)
            if zone:
                at = made.boundaries(zone[0] + MARGIN_CHARS, zone[1] - MARGIN_CHARS, lambda p: piece[p - start])
            out |= {name: made.marks(at), f"{name}_at": at.tolist()}
        return out

    chunks = long.mapInArrow(cut, CHUNK_ROW).repartition("_row", "no").mapInArrow(encode, ENCODED_ROW)
    ordered = Window.partitionBy("_row").orderBy("no")
    common = F.array_intersect("tail", F.col("next_head"))
    mark = F.get("common", F.floor(F.size("common") / 2).cast("int"))

    def index(marks: str, places: str) -> F.Column:
        return F.get(places, (F.array_position(marks, F.col("mark")) - 1).cast("int"))

    spliced = (
        chunks.withColumns({"next_head": F.lead("head").over(ordered), "next_at": F.lead("head_at").over(ordered)})
        .withColumn("common", common).withColumn("mark", mark)
        .withColumns({"to": index("tail", "tail_at"), "skip": index("next_head", "next_at"),
                      "place": F.split("mark", ":")[2].cast("long"), "last": F.col("next_head").isNull()})
        .select("_row", "no", "start", "end", "n", "to", "skip", "place", "last")
        .withColumns({"from": F.lag("skip").over(ordered), "since": F.lag("place").over(ordered),
                      "opens": (F.lag("place").over(ordered).isNotNull() | (F.col("no") == 0)).cast("int")})
        .withColumn("run", F.sum("opens").over(ordered))
    )
    # A run of one chunk has proven boundaries at both ends; a longer one has seams that did not align.
    runs = stage(spliced.groupBy("_row", "run").agg(
        F.count("*").alias("chunks"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("since").alias("since"),
        F.max_by("place", "no").alias("until"),
        F.sum(F.coalesce("to", "n") - F.coalesce("from", F.lit(0))).alias("_tokens")))
    aligned = runs.where("chunks = 1").select("_row", "_tokens")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(content.value)
        for batch in batches:
            for part in small_slices(batch):
                rows = part.to_pylist()
                found = [count_in_order(tokenizer, r["piece"], r["low"], r["high"], chunk, overlap) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found, pa.int64())], names=["_row", "_tokens"])

    open_runs = runs.where("chunks > 1").join(long, "_row").select(
        "_row", F.substr("_text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("piece"),
        (F.coalesce("since", F.lit(0)) - F.col("start")).alias("low"),
        (F.coalesce("until", "end") - F.col("start")).alias("high"))
    repaired = open_runs.mapInArrow(repair, "_row long, _tokens long")
    return aligned.unionByName(repaired).groupBy("_row").agg(F.sum("_tokens").alias("_tokens"))

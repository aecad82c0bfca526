"""Byte-level BPE over whole texts as a tree reduction, and its inverse.

A text is halved until the parts are short, the parts are encoded, and neighbours are joined going up:
only a window around the seam is encoded anew. It grows on either side until the tokens outside cannot
depend on what lies across the seam:

* Between pre-tokens: blank space after a letter, digit or ASCII mark always begins a new match of the
  pattern, and matches look forward only. From such a place on, a half's tokens stay as they are.
* Inside one long pre-token: BPE output is valid exactly when each two neighbouring tokens are the encoding
  of their joint bytes. A window is wide enough when that holds at both of its edges.

Joining is associative, so any split of a text gives the same ids. Decoding concatenates bytes up the same
kind of tree. Texts are independent rows; nothing is shuffled.

Defined results: a NULL or empty text has no tokens (empty ids, 0); repeated rows are encoded each; other
columns pass through, and an existing column named like an output is replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import add_columns

LEAF_CHARS = 1024
LEAF_BYTES = 256
LEAF_IDS = 4096


def read_ranks(path: str) -> bytes:
    """The rank file's content, read once on the driver; a fixed vocabulary of about 1 MB that jobs carry."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def make_encoder(ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS,
                 leaf_bytes: int = LEAF_BYTES) -> Callable[[str], array]:
    """A function from a text to its ids, by tree reduction."""
    import re

    import regex
    import tiktoken

    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    short_text, short_piece = library._core_bpe.encode_ordinary, library._core_bpe.encode_single_piece
    token_bytes = {rank: token for token, rank in ranks.items()}
    blank_after = re.compile(r"[\w!-~][ \n]")
    pieces = regex.compile(pattern)

    def fits(left: int, right: int) -> bool:
        return short_piece(token_bytes[left] + token_bytes[right]) == [left, right]

    def join_piece(left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            head, tail = left[:-width], right[width:]
            window = encode_piece(b"".join(token_bytes[i] for i in left[-width:] + right[:width]), whole=True)
            if (not head or fits(head[-1], window[0])) and (not tail or fits(window[-1], tail[0])):
                return head + window + tail
            width *= 2

    def encode_piece(piece: bytes, whole: bool = False) -> list[int]:
        if whole or len(piece) <= leaf_bytes:
            return short_piece(piece)
        middle = len(piece) // 2
        return join_piece(encode_piece(piece[:middle]), encode_piece(piece[middle:]))

    def encode_span(text: str) -> list[int]:
        if len(text) <= leaf_chars:
            return short_text(text)
        ids: list[int] = []
        for piece in pieces.findall(text):
            ids += encode_piece(piece.encode())
        return ids

    def last_blank(text: str, low: int, high: int) -> int:
        reach = 64
        while True:
            found = [m.start() + 1 for m in blank_after.finditer(text, max(low, high - reach), high)]
            if found:
                return found[-1]
            if high - reach <= low:
                return low
            reach *= 2

    def encode_range(text: str, low: int, high: int) -> array:
        if high - low <= leaf_chars:
            return array("I", short_text(text[low:high]))
        middle = (low + high) // 2
        left, right = encode_range(text, low, middle), encode_range(text, middle, high)
        start = last_blank(text, low, middle)
        after = blank_after.search(text, middle, high)
        end = after.start() + 1 if after else high
        kept_left = len(left) - len(encode_span(text[start:middle])) if start > low else 0
        lost_right = len(encode_span(text[middle:end])) if end < high else len(right)
        seam = array("I", encode_span(text[start:end]))
        del left[kept_left:]
        left.extend(seam)
        left.extend(right[lost_right:])
        return left

    return lambda text: encode_range(text, 0, len(text))


def decode_ids(ids: list[int], table: list[bytes], leaf_ids: int = LEAF_IDS) -> bytes:
    """The bytes of ``ids``; an id outside the vocabulary raises."""
    if len(ids) <= leaf_ids:
        return b"".join(map(table.__getitem__, ids))
    middle = len(ids) // 2
    return decode_ids(ids[:middle], table, leaf_ids) + decode_ids(ids[middle:], table, leaf_ids)


def bpe_encode(frame: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids",
               count: str = "n_tokens") -> DataFrame:
    """``frame`` with ``ids`` (BINARY, little-endian unsigned 32 bit) and ``count`` (BIGINT) of each text."""
    content = frame.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def work():
        encode = make_encoder(parse_ranks(content.value), pattern)

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            encoded = [encode(value) if value else array("I") for value in part.column(text).to_pylist()]
            return [pa.array([e.tobytes() for e in encoded], pa.binary()),
                    pa.array([len(e) for e in encoded], pa.int64())]

        return each

    return add_columns(frame, {ids: T.BinaryType(), count: T.LongType()}, work)


def bpe_decode(frame: DataFrame, rank_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that ``ids`` stand for; NULL ids decode to no bytes."""
    content = frame.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def work():
        table = token_table(parse_ranks(content.value))

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            rows = [decode_ids(array("I", value or b"").tolist(), table) for value in part.column(ids).to_pylist()]
            return [pa.array(rows, pa.binary())]

        return each

    return add_columns(frame, {decoded: T.BinaryType()}, work)


def bpe_round_trip(frame: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids",
                   count: str = "n_tokens", same: str = "round_trip") -> DataFrame:
    """``frame`` with ``ids``, ``count`` and whether the ids decode to the text, in place of ``text``.

    As ``bpe_encode`` and ``bpe_decode`` one after another, but in one process per task, and no text leaves it.
    """
    content = frame.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def work():
        ranks = parse_ranks(content.value)
        encode, table = make_encoder(ranks, pattern), token_table(ranks)

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            texts = [value or "" for value in part.column(text).to_pylist()]
            encoded = [encode(value) if value else array("I") for value in texts]
            return [pa.array([e.tobytes() for e in encoded], pa.binary()), pa.array([len(e) for e in encoded], pa.int64()),
                    pa.array([decode_ids(e.tolist(), table) == value.encode() for e, value in zip(encoded, texts)], pa.bool_())]

        return each

    return add_columns(frame, {ids: T.BinaryType(), count: T.LongType(), same: T.BooleanType()}, work, drop=(text,))

"""Texts as blocks of UTF-8 bytes of about a megabyte, so that memory does not grow with batches or long texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_BYTES = 1 << 20


@dataclass
class Block:
    """Pieces of texts one after another, each followed by a line feed.

    Piece ``i`` belongs to text ``texts[i]`` and begins at ``starts[i]``. What begins at ``owned[i]`` or later in it is
    looked at only as what follows; the next piece of the same text owns it.
    """

    data: bytes
    texts: np.ndarray
    starts: np.ndarray
    owned: np.ndarray


def pieces(data: bytes, cut: re.Pattern, ahead: re.Pattern, size: int = BLOCK_BYTES) -> Iterator[tuple[bytes, int]]:
    """``data`` in pieces that end after a match of ``cut``, each with what ``ahead`` matches behind it.

    The number tells how many bytes of the piece are its own.
    """
    start = 0
    while len(data) - start > size:
        end = cut.search(data, start + size)
        if not end:
            break
        yield data[start:ahead.match(data, end.end()).end()], end.end() - start
        start = end.end()
    yield data[start:], len(data) - start


def blocks(texts: list[str | None], cut: re.Pattern, ahead: re.Pattern, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """All texts as blocks; a NULL text counts as empty."""
    held: list[bytes] = []
    numbers: list[int] = []
    owned: list[int] = []
    total = 0

    def block() -> Block:
        lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
        starts = np.cumsum(lengths) - lengths
        return Block(b"\n".join([*held, b""]), np.array(numbers), starts, starts + np.array(owned))

    for number, text in enumerate(texts):
        for piece, own in pieces((text or "").encode(), cut, ahead, size):
            held.append(piece)
            numbers.append(number)
            owned.append(own)
            total += len(piece)
            if total >= size:
                yield block()
                held, numbers, owned, total = [], [], [], 0
    if held:
        yield block()


def runs(is_member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of set flags start and end."""
    edges = np.diff(is_member.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

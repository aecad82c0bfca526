"""Hashes of the words of many texts at once, with NumPy inside tasks.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lowercased text;
everything else separates words. Texts are worked on a quarter of a megabyte at a time, so memory does not depend on
the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
# Fixed odd multipliers of the polynomial word hash and of the finalising mix.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(MIX_1)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(MIX_2)
    return values ^ (values >> np.uint64(31))


def powers_of(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


@dataclass
class Words:
    """The words of consecutive texts: text ``first + d`` has the hashes ``hashes[bounds[d]:bounds[d + 1]]``."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


class WordHasher:
    """Reusable tables for hashing; make one per task."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        codes = np.arange(256)
        self.is_word = ((codes >= 128) | ((codes >= 48) & (codes < 58)) | ((codes >= 97) & (codes < 123))).astype(np.int8)

    def grow(self, size: int) -> None:
        if len(self.powers) < size:
            size, inverse = max(size, 1 << 16), pow(BASE, -1, 1 << 64)
            self.powers = powers_of(BASE, size)
            self.inverses = powers_of(inverse, size)

    def hash_texts(self, texts: pa.Array, first: int) -> Words:
        """The words of a few texts; NULL counts as empty."""
        lowered = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts, "")), "\n", "")
        if isinstance(lowered, pa.ChunkedArray):
            lowered = lowered.combine_chunks()
        kind = np.int64 if pa.types.is_large_string(lowered.type) else np.int32
        offsets = np.frombuffer(lowered.buffers()[1], kind)[lowered.offset:lowered.offset + len(lowered) + 1].astype(np.int64)
        data = np.frombuffer(lowered.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        self.grow(len(data) + 1)
        edges = np.diff(self.is_word[data], prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        return Words(first, hashes, np.searchsorted(starts, offsets))

    def chunks(self, texts: pa.Array) -> Iterator[Words]:
        """The words of all texts, about ``CHUNK_BYTES`` of text (or one longer text) at a time."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        ends, start, done = np.cumsum(sizes), 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
            yield self.hash_texts(texts.slice(start, stop - start), start)
            start, done = stop, int(ends[stop - 1])


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their bounds; a shorter text is one run of all its words."""
    counts = np.diff(words.bounds)
    each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(each)])
    if not bounds[-1]:
        return np.empty(0, np.uint64), bounds
    places = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], each)
    last = len(words.hashes) - 1
    run = words.hashes[places]
    length = np.repeat(np.minimum(counts, size), each)
    for step in range(1, size):
        following = words.hashes[np.minimum(places + step, last)]
        run = np.where(length > step, mix(run) + following, run)
    return mix(run), bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes within each segment, how often each occurs, and the new bounds."""
    if not len(hashes):
        return hashes, np.empty(0, np.int64), bounds
    ordered = hashes.copy()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ordered[low:high].sort()
    fresh = np.empty(len(ordered), dtype=bool)
    fresh[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    places = np.flatnonzero(fresh)
    return ordered[places], np.diff(places, append=len(ordered)), np.searchsorted(places, bounds)


class Members:
    """Membership in a sorted set of 64-bit hashes, with a bit table in front of the search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.sort(np.asarray(values, dtype=np.uint64))
        bits = max(16, int(len(self.values) * 16).bit_length())
        self.shift = np.uint64(64 - min(bits, 26))
        self.present = np.zeros(1 << min(bits, 26), dtype=bool)
        self.present[self.values >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``hashes`` members stand, and which members they are."""
        if not len(self.values):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        places = np.flatnonzero(self.present[hashes >> self.shift])
        at = np.minimum(np.searchsorted(self.values, hashes[places]), len(self.values) - 1)
        hit = self.values[at] == hashes[places]
        return places[hit], at[hit]

"""Sums over entries that do not depend on their order, as whole numbers on a fixed grid of bits.

A double is split into limbs of 19 bits that all blocks cut at the same places. Limbs and products of two limbs add up
without rounding in doubles as long as a block is short (19 + 19 + 13 bits), so a matrix product of limbs is exact in whatever
order it runs; totals are whole numbers of any size, kept per limb and rounded once, at the end. Equal data give equal
bits for any partitioning, and what was added can be taken away again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np

LIMB_BITS = 19
LOWEST_LIMB = -56  # of 2^-1064; what is smaller counts as zero
BLOCK_ENTRIES = 8192
# A double has at most four limbs, so a block adds less than 2^54 to a total and 2^7 blocks fit into 63 bits.
OPEN_BLOCKS = 128
SLACK_BINS = 1024
SLACK_LOWEST = -96  # power of two of the first bin; eight bins for each

# Fixed odd multipliers of the layout digest.
DIGEST_1, DIGEST_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def limbs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(k, whole)`` with ``values`` the sum of ``whole * 2^(19 k)``, each whole number below 2^19."""
    rest, top = values.copy(), float(np.abs(values).max(initial=0.0))
    if not math.isfinite(top):
        raise ValueError("parameters must be finite numbers or missing")
    limb = (math.frexp(top)[1] - 1) // LIMB_BITS
    while limb >= LOWEST_LIMB and rest.any():
        unit = math.ldexp(1.0, LIMB_BITS * limb)
        whole = np.trunc(rest / unit)
        rest -= whole * unit
        if whole.any():
            yield limb, whole
        limb -= 1


def total_of(by_limb: dict[int, int]) -> Fraction:
    lowest = min(by_limb, default=0)
    total = sum(int(n) << (LIMB_BITS * (limb - lowest)) for limb, n in by_limb.items())
    shift = LIMB_BITS * lowest
    return Fraction(total << shift) if shift >= 0 else Fraction(total, 1 << -shift)


def rounded(value: Fraction) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.copysign(math.inf, value)


def digest(samples: np.ndarray, sources: np.ndarray, labels: np.ndarray) -> int:
    """An order-free number for which entry of which sample has which label."""
    mixed = samples.astype(np.uint64) * DIGEST_1
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed + (sources.astype(np.uint64) << np.uint64(32) | labels.astype(np.uint64)) * DIGEST_1) * DIGEST_2
    mixed ^= mixed >> np.uint64(32)
    mixed *= DIGEST_1
    return int(np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29)), initial=np.uint64(0)))


def slack_bin(slack: np.ndarray) -> np.ndarray:
    """The histogram bin of a slack: its power of two in eight parts."""
    known = np.clip(slack, 2.0 ** SLACK_LOWEST, 2.0 ** (SLACK_LOWEST + SLACK_BINS / 8 - 1))
    return np.where(slack > 0, (8 * (np.log2(known) - SLACK_LOWEST)).astype(np.int64) + 1, 0)


@dataclass
class SlotSums:
    """Counts, sums and sums of products of the entries of every slot, with the layout they stand in."""

    num_sources: int
    num_params: int
    samples: int = 0
    present: np.ndarray = None
    valid: np.ndarray = None
    layout: int = 0
    infinite: float = 0.0
    score: dict[int, int] = field(default_factory=dict)
    first: dict[int, np.ndarray] = field(default_factory=dict)
    second: dict[int, np.ndarray] = field(default_factory=dict)
    slacks: np.ndarray = None
    read: int = 0
    open: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)
    open_blocks: int = 0

    def __post_init__(self) -> None:
        for name, size in (("present", self.num_sources), ("valid", self.num_sources), ("slacks", SLACK_BINS)):
            if getattr(self, name) is None:
                setattr(self, name, np.zeros(size, np.int64))

    def add_entries(self, labels: np.ndarray, entries: np.ndarray, sign: int = 1) -> None:
        """``entries`` are rows of parameters in the order of ``labels``."""
        bounds = np.searchsorted(labels, np.arange(self.num_sources + 1))
        for label, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            self.valid[label] += sign * (high - low)
            for at in range(low, high, BLOCK_ENTRIES):
                self._add_block(label, entries[at:min(high, at + BLOCK_ENTRIES)], sign)

    def _add_block(self, label: int, block: np.ndarray, sign: int) -> None:
        cut = list(limbs(block))
        for i, (limb, whole) in enumerate(cut):
            self._cell("first", limb, 1)[label] += sign * whole.sum(axis=0).astype(np.int64)
            for other, factor in cut[i:]:
                product = whole.T @ factor
                product = product if other == limb else product + product.T
                self._cell("second", limb + other, 2)[label] += sign * product.astype(np.int64)
        self.open_blocks += 1
        if self.open_blocks == OPEN_BLOCKS:
            self.close()

    def _cell(self, name: str, limb: int, axes: int) -> np.ndarray:
        """Machine numbers that take up some blocks before they are added to the total."""
        if (name, limb) not in self.open:
            self.open[name, limb] = np.zeros((self.num_sources, *[self.num_params] * axes), np.int64)
        return self.open[name, limb]

    def close(self) -> SlotSums:
        """Add what is open to the totals, in place."""
        for (name, limb), made in self.open.items():
            total = getattr(self, name)
            total[limb] = total[limb] + made.astype(object) if limb in total else made.astype(object)
        self.open, self.open_blocks = {}, 0
        return self

    def add_scores(self, scores: np.ndarray) -> None:
        finite = np.isfinite(scores)
        self.infinite += float(scores[~finite].sum()) if not finite.all() else 0.0
        for at in range(0, len(scores), BLOCK_ENTRIES):
            for limb, whole in limbs(np.where(finite, scores, 0.0)[at:at + BLOCK_ENTRIES]):
                self.score[limb] = self.score.get(limb, 0) + int(whole.sum())

    def merge(self, other: SlotSums) -> SlotSums:
        """Add ``other`` in place."""
        self.close()
        other.close()
        self.samples += other.samples
        self.read += other.read
        self.layout ^= other.layout
        self.infinite += other.infinite
        for name in ("present", "valid", "slacks"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        for name in ("score", "first", "second"):
            ours = getattr(self, name)
            for limb, value in getattr(other, name).items():
                ours[limb] = ours[limb] + value if limb in ours else value
        return self

    def mean_score(self) -> float:
        return math.nan if not self.samples else self.infinite + rounded(total_of(self.score) / self.samples)

    def central(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and sums of products of the deviations from them; NaN and 0 for a slot without entries."""
        self.close()
        slots, width = self.num_sources, self.num_params
        mean, scatter = np.full((slots, width), np.nan), np.zeros((slots, width, width))
        for label in np.flatnonzero(self.valid).tolist():
            count = int(self.valid[label])
            sums = [total_of({k: s[label, i] for k, s in self.first.items()}) for i in range(width)]
            mean[label] = [rounded(s / count) for s in sums]
            for i in range(width):
                for j in range(i, width):
                    square = total_of({k: s[label, i, j] for k, s in self.second.items()})
                    scatter[label, i, j] = scatter[label, j, i] = rounded(square - sums[i] * sums[j] / count)
        return mean, scatter

"""Fits that look at the entries of a layout: mergeable states per slot, and a robust model built on them.

An ``EntryEstimator`` is four functions. Tasks build a state per slot from blocks of complete entries, states are merged
in a tree, and the driver turns one state per label into a fit. A state must be bounded and made of arrays and plain numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

State = Any

# Fixed values that results depend on.
SKETCH_BITS = 7          # sub-buckets of a power of two; the relative error is at most 2^-8
FREEDOM = 4.0            # degrees of freedom of the robust model
QUARTILE_OF_T = 0.7406970841126834   # 75 % point of Student's t with four degrees of freedom


@dataclass(frozen=True)
class EntryEstimator:
    """A fit of one's own: ``init(parameters)``, ``update(state, entries)``, ``merge(state, state)``, ``finish(states, given)``.

    ``entries`` are rows of fitted parameters without missing values, possibly none. ``finish`` gets a state per label;
    labels with few entries get the merged state of all labels. The fit needs ``params`` and ``num_labels``.
    """

    init: Callable[[int], State]
    update: Callable[[State, np.ndarray], State]
    merge: Callable[[State, State], State]
    finish: Callable[[list[State], Any], Any]


# ---- quantile sketch ------------------------------------------------------------------------
# Counts of values by sign, power of two and its 128th parts. Counts merge exactly, so a sketch does not depend on
# order, and all doubles together have fewer than 2^20 buckets, however many values are counted.

Sketch = tuple[np.ndarray, np.ndarray]


def sketch_buckets(values: np.ndarray) -> np.ndarray:
    """Bucket numbers in the order of the values: the leading bits of their magnitudes, negated below zero."""
    bits = np.abs(np.ascontiguousarray(values, np.float64)).view(np.int64) >> np.int64(52 - SKETCH_BITS)
    return np.where(values < 0, -bits, bits)


def bucket_values(buckets: np.ndarray) -> np.ndarray:
    """The middle of each bucket; 0 for the smallest magnitudes."""
    shift = np.int64(52 - SKETCH_BITS)
    low, high = (((np.abs(buckets) + step) << shift).view(np.float64) for step in (0, 1))
    return np.where(buckets == 0, 0.0, np.sign(buckets) * (low + (high - low) / 2))


def add_counts(sketch: Sketch, buckets: np.ndarray, counts: np.ndarray) -> Sketch:
    every, place = np.unique(np.concatenate([sketch[0], buckets]), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, place, np.concatenate([sketch[1], counts]))
    return every, total


def quantile(sketch: Sketch, share: float) -> float:
    """The bucket of the value whose rank is ``share`` of the count, rounded up; NaN without values."""
    buckets, counts = sketch
    if not len(buckets):
        return math.nan
    ranks = np.cumsum(counts)
    place = np.searchsorted(ranks, max(1, math.ceil(share * int(ranks[-1]))))
    return float(bucket_values(buckets[place:place + 1])[0])


def empty_sketches(num_params: int) -> list[Sketch]:
    return [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(num_params)]


def update_sketches(state: list[Sketch], entries: np.ndarray) -> list[Sketch]:
    if not len(entries):
        return state
    return [add_counts(sketch, *np.unique(sketch_buckets(entries[:, i]), return_counts=True)) for i, sketch in enumerate(state)]


def merge_sketches(left: list[Sketch], right: list[Sketch]) -> list[Sketch]:
    return [add_counts(a, *b) for a, b in zip(left, right)]


# ---- robust model ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RobustFit:
    """Medians and scales per label and parameter, for independent Student distributions."""

    location: np.ndarray
    scale: np.ndarray
    params: tuple[int, ...]

    @property
    def num_labels(self) -> int:
        return len(self.location)

    def numbers(self, label: int) -> np.ndarray:
        """What tells one label's distribution from another's."""
        return np.concatenate([self.location[label], self.scale[label]])

    def require_regular(self) -> None:
        for label, scale in enumerate(self.scale):
            if not (np.isfinite(scale).all() and (scale > 0).all()):
                raise ValueError(f"the quartiles of slot {label} coincide: scales {scale.tolist()}")


def finish_robust(states: Sequence[list[Sketch]], given) -> RobustFit:
    location = np.array([[quantile(s, 0.5) for s in state] for state in states])
    spread = np.array([[quantile(s, 0.75) - quantile(s, 0.25) for s in state] for state in states])
    return RobustFit(location, spread / 2 / QUARTILE_OF_T, given.params)


robust_estimate = EntryEstimator(empty_sketches, update_sketches, merge_sketches, finish_robust)

# For four degrees of freedom the gamma functions are 3/4 sqrt(pi) and 1; math.lgamma is off in the last digits.
LOG_CONSTANT = math.log(0.75 * math.sqrt(math.pi)) - 0.5 * math.log(FREEDOM * math.pi)


def natural_log(values: np.ndarray) -> np.ndarray:
    """The C library's logarithm; the last bit of NumPy's own depends on the processor."""
    return pc.ln(pa.array(np.asarray(values, float).ravel())).to_numpy(zero_copy_only=False).reshape(np.shape(values))


def robust_density_of_block(values: np.ndarray, fit: RobustFit, label: int) -> np.ndarray:
    """Added from left to right: labels often share medians, and then the last bits decide between equal totals."""
    total, log_scale = 0.0, natural_log(fit.scale[label])
    for i in range(values.shape[1]):
        scaled = (values[:, i] - fit.location[label, i]) / fit.scale[label, i]
        total = total + LOG_CONSTANT - log_scale[i] - (FREEDOM + 1) / 2 * natural_log(1 + scaled * scaled / FREEDOM)
    return total

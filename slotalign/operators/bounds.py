"""Bounds that tell which samples keep their layout when the fits move, so that only the others are matched again.

For every sample, the gap is what the second best layout lacks to the best one. A label's score is quadratic in the entry, so
the change of a score between two fits is bounded by a constant, a multiple of the entry's length and one of its square. A
sample whose gap exceeds what all of its entries can change by keeps its layout: no candidate is lost, and the loop takes
the same steps as without bounds. The gap per unit is one number, written with the sample; a unit weighs the three terms
as the last step moved them, so that a further step like it is bounded tightly.

A tighter test needs a look at the sample. If there is a price per label at which every entry wants the label it has, and free
labels cost no more than the others, no other layout is as good: what it saves in prices it loses in scores. Any prices will
do. Those of one fit are written as what is left to each entry of its score; under a new fit a label's price is its
entry's new score less that, so that a change which all entries share costs no room. Quadratic scores are one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from ..functions.columns import LOG_TWO_PI
from .exact import slack_bin
from .moments import SlotMoments

# Scores are rounded; differences at this part of their largest terms are no evidence.
ROUNDING = 1e-11
SINGLE_ROUNDING = 4e-6  # the same where scores are sums of a few products in single precision
# Samples whose layouts are compared at a time.
GAP_SAMPLES = 1024


@dataclass(frozen=True)
class Coordinates:
    """Entries relative to the mean of all of them, in units of their deviations, and what a unit of movement is."""

    centre: np.ndarray
    lower: np.ndarray
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def weighing(self, movement: np.ndarray) -> Coordinates:
        """A unit in proportion to ``movement``; no term weighs nothing."""
        top = float(movement.max())
        known = np.isfinite(top) and top > 0
        return replace(self, weights=tuple(np.maximum(movement / top, 1e-3).tolist()) if known else (1.0, 1.0, 1.0))

    def units(self, movement: np.ndarray) -> float:
        """A slack above this number survives a movement."""
        return float((movement / np.array(self.weights)).max())

    @classmethod
    def of(cls, moments: SlotMoments) -> Coordinates | None:
        count, centre, scatter = moments.pooled()
        try:
            return cls(centre, np.linalg.cholesky(scatter / max(count - 1, 1))) if count > 1 else None
        except np.linalg.LinAlgError:
            return None

    def lengths(self, entries: np.ndarray) -> np.ndarray:
        return np.linalg.norm(np.linalg.solve(self.lower, (entries - self.centre).T), axis=0)


def layout_gaps(score: np.ndarray, labels: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """What the next best layout of each sample's valid entries lacks: the cheapest cycle of moves to other labels.

    ``score`` is (samples, entries, labels) and ``labels`` an optimal permutation of them.
    """
    return gaps_and_prices(score, labels, valid)[0]


def gaps_and_prices(score: np.ndarray, labels: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``layout_gaps``, and per sample and label what its entry keeps of its score after the label's price, or a free label's price.

    The prices leave every entry much room before it wants another label.
    """
    parts = [slice(at, at + GAP_SAMPLES) for at in range(0, max(len(labels), 1), GAP_SAMPLES)]
    made = [_gaps_and_prices(score[part], labels[part], valid[part]) for part in parts]
    gaps, prices = zip(*made)
    return np.concatenate(gaps), np.concatenate(prices)


def _gaps_and_prices(score: np.ndarray, labels: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.arange(labels.shape[1])
    holder = np.empty_like(labels)
    np.put_along_axis(holder, labels, np.broadcast_to(every.astype(labels.dtype), labels.shape), axis=1)
    held = np.take_along_axis(valid, holder, axis=1).T
    # Going from one label to another moves the holder of the first; a missing entry moves for nothing.
    paths = np.ascontiguousarray(np.moveaxis(np.take_along_axis(score, holder[:, :, None], axis=1), 0, 2))
    own = paths[every, every]
    paths = np.where(held[:, None], own[:, None] - paths, 0.0)
    paths[every, every] = np.inf
    with np.errstate(invalid="ignore", over="ignore"):
        for label in every:
            np.minimum(paths, paths[:, label, None] + paths[label], out=paths)
        around = np.where(held, paths[every, every], np.inf).min(axis=0)
        # Costs of paths to and from a label are prices each, and so is their mean.
        paths[every, every] = 0.0
        prices = (paths.sum(axis=1) - paths.sum(axis=0)) / (2 * len(every))
        prices = np.where(held, own - prices, prices.min(axis=0)).astype(np.float32)
    return np.where(np.isnan(around), 0.0, np.maximum(around, 0.0)), prices.T


def keeper(fit, log_in: np.ndarray, coordinates: Coordinates):
    """A function that tells which samples are sure to keep their layout under a fit.

    It takes the fitted parameters (parameters, entries) of a block's complete entries, the sample and the label of each, and what
    ``gaps_and_prices`` told (labels, samples). Samples that single precision leaves in doubt are looked at in double precision.
    """
    constant, linear, square = _terms(fit, log_in, coordinates)
    constant = constant - 0.5 * linear.shape[1] * LOG_TWO_PI
    pairs = [(i, j) for i in range(linear.shape[1]) for j in range(i + 1)]
    factors = np.stack([constant, *-linear.T, *[-(0.5 if i == j else 1.0) * square[:, i, j] for i, j in pairs]], axis=1)
    tops = [float(np.abs(constant).max()), float(np.linalg.norm(linear, axis=1).max()), float(np.abs(square).sum(axis=(1, 2)).max())]
    unit = np.linalg.inv(coordinates.lower)

    def doubtful(place: np.ndarray, row: np.ndarray, own: np.ndarray, left: np.ndarray, kind: type, rounding: float) -> np.ndarray:
        place = place.astype(kind, copy=False)
        features = np.empty((factors.shape[1], len(row)), kind)
        features[0], features[1:1 + len(place)] = 1.0, place
        for at, (i, j) in enumerate(pairs, 1 + len(place)):
            np.multiply(place[i], place[j], out=features[at])
        net = factors.astype(kind) @ features
        own = own.astype(np.int64)
        chosen, label = own * len(row) + np.arange(len(row)), own * left.shape[1] + row
        prices, free = left.astype(kind), np.ones(left.shape, bool)
        mine = prices.ravel()[label]
        prices.ravel()[label] = net.ravel()[chosen] - mine
        free.ravel()[label] = False
        np.copyto(prices, prices.min(axis=0), where=free)
        net -= np.take(prices, row, axis=1)
        net.ravel()[chosen] = -np.inf
        length = (place * place).sum(axis=0)
        height = np.take(np.maximum(np.abs(prices).max(axis=0), np.abs(left).max(axis=0)), row)
        doubt = rounding * (tops[0] + tops[1] * np.sqrt(length) + tops[2] * length + height)
        return ~(mine - net.max(axis=0) > doubt)

    def keeps(values: np.ndarray, row: np.ndarray, own: np.ndarray, left: np.ndarray) -> np.ndarray:
        kept = np.ones(left.shape[1], bool)
        with np.errstate(invalid="ignore", over="ignore"):
            place = unit @ (values - coordinates.centre[:, None])
            kept[row[doubtful(place, row, own, left, np.float32, SINGLE_ROUNDING)]] = False
            again = np.flatnonzero(~kept[row])
            kept[:] = True
            kept[row[again][doubtful(place[:, again], row[again], own[again], left, np.float64, ROUNDING)]] = False
        return kept

    return keeps


def slacks(gaps: np.ndarray, valid: np.ndarray, lengths: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    """Gaps per unit: a weighted sum of one, the length and its square, over the entries."""
    constant, linear, square = weights
    units = np.where(valid, constant + linear * lengths + square * lengths**2, 0.0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(units > 0, gaps / units, np.inf)


def movement_between(before: tuple, after: tuple, coordinates: Coordinates) -> np.ndarray:
    """By how much two labels' scores may part between one ``(normal fit, log inclusion)`` and another.

    Three bounds, for the constant, the linear and the quadratic term in the length of an entry; rounding is included.
    """
    old, new = _terms(*before, coordinates), _terms(*after, coordinates)
    largest = max(float(np.abs(term).max()) for term in (*old, *new))
    constant, linear, square = ((now - was)[:, None] - (now - was)[None, :] for was, now in zip(old, new))
    size = square.shape[2]
    bounds = np.array([np.abs(constant).max(), np.linalg.norm(linear, axis=2).max(),
                       0.5 * np.linalg.norm(square.reshape(-1, size, size), ord=2, axis=(1, 2)).max()])
    return np.where(np.isfinite(bounds), bounds + ROUNDING * largest * size, np.inf)


def _terms(fit, log_in: np.ndarray, coordinates: Coordinates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every label's score as constant, linear and quadratic term of the coordinates."""
    whiten, half_log_det = fit.whitening
    turned = whiten @ coordinates.lower
    offset = np.einsum("lij,lj->li", whiten, coordinates.centre - fit.mean)
    constant = log_in - half_log_det - 0.5 * (offset**2).sum(axis=1)
    return constant, np.einsum("lij,li->lj", turned, offset), np.einsum("lij,lik->ljk", turned, turned)


def share_at_most(histogram: np.ndarray, slack: float) -> float:
    """At least the share of samples with at most this slack."""
    if not np.isfinite(slack):
        return 1.0
    return float(histogram[:int(slack_bin(np.array([slack]))[0]) + 1].sum() / max(histogram.sum(), 1))

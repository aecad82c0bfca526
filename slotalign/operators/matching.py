"""Best labels for the entries of many samples at once, on NumPy blocks inside a task."""

from __future__ import annotations

from itertools import permutations

import numpy as np

# Up to so many slots near ties are told by comparing all orders, and by comparing all sets of labels.
MAX_ORDERED, MAX_SETS = 3, 10
NEAR_TIE = 1e-9  # of the largest score; far above rounding
CELLS = 1 << 21


def best_labels(score: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Labels that maximise the total score of the valid entries of each sample.

    ``score`` is (samples, entries, labels) with at least as many labels as entries; the result is
    (samples, entries) with distinct labels per sample and -1 where ``valid`` is False.
    """
    cost = np.where(valid[:, :, None], -score, 0.0)
    forbidden = ~np.isfinite(cost)
    if forbidden.any():
        usable = cost[~forbidden]
        reach = float(np.ptp(usable)) + 1.0 if usable.size else 1.0
        top = float(usable.max()) if usable.size else 0.0
        cost[forbidden] = top + reach * (score.shape[1] + 1)

    # An entry's own favourite is final where no two entries of the sample want the same label.
    labels = cost.argmin(axis=2)
    labels[~valid] = -1
    wanted = np.sort(np.where(valid, labels, score.shape[2] + np.arange(score.shape[1])), axis=1)
    contested = np.flatnonzero((np.diff(wanted, axis=1) == 0).any(axis=1))
    if contested.size:
        labels[contested] = _augment(cost[contested], valid[contested])
    return labels


def _augment(cost: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Shortest augmenting paths (Crouse 2016), advanced for all samples of the block together.

    Every label starts with the first entry whose favourite it is. With the favourites' costs as prices that is the
    solution for these entries, so only the others look for a path, however many slots there are.
    """
    samples, entries, width = cost.shape
    favourite = cost.argmin(axis=2)
    entry_price = np.take_along_axis(cost, favourite[:, :, None], axis=2)[:, :, 0]
    label_price = np.zeros((samples, width))
    owner = np.full((samples, width), -1)
    for entry in reversed(range(entries)):
        there = np.flatnonzero(valid[:, entry])
        owner[there, favourite[there, entry]] = entry
    labels = np.where(valid & (np.take_along_axis(owner, favourite, axis=1) == np.arange(entries)), favourite, -1)
    waiting = valid & (labels < 0)
    while True:
        # The next entry of every sample that still has one.
        rows = np.flatnonzero(waiting.any(axis=1))
        if not rows.size:
            return labels
        entry = waiting[rows].argmax(axis=1)
        waiting[rows, entry] = False
        distance = np.full((rows.size, width), np.inf)
        came_from = np.full((rows.size, width), -1)
        closed = np.zeros((rows.size, width), dtype=bool)
        reached = np.zeros(rows.size)
        end = np.full(rows.size, -1)
        at = entry.copy()
        open_rows = np.arange(rows.size)
        while open_rows.size:
            sample, here = rows[open_rows], at[open_rows]
            step = (reached[open_rows, None] + cost[sample, here]
                    - entry_price[sample, here][:, None] - label_price[sample])
            shorter = (step < distance[open_rows]) & ~closed[open_rows]
            distance[open_rows] = np.where(shorter, step, distance[open_rows])
            came_from[open_rows] = np.where(shorter, here[:, None], came_from[open_rows])
            nearest = np.where(closed[open_rows], np.inf, distance[open_rows]).argmin(axis=1)
            reached[open_rows] = distance[open_rows, nearest]
            closed[open_rows, nearest] = True
            holder = owner[sample, nearest]
            end[open_rows[holder < 0]] = nearest[holder < 0]
            at[open_rows] = holder
            open_rows = open_rows[holder >= 0]

        slack = np.where(closed, reached[:, None] - distance, 0.0)
        label_price[rows] -= slack
        held = closed & (owner[rows] >= 0)
        place, label = np.nonzero(held)
        entry_price[rows[place], owner[rows[place], label]] += slack[place, label]
        entry_price[rows, entry] += reached  # from the price of its favourite

        # Hand the labels on along each path, from its free end back to the new entry.
        moving, label = np.arange(rows.size), end
        while moving.size:
            taker = came_from[moving, label]
            released = labels[rows[moving], taker]
            owner[rows[moving], label] = taker
            labels[rows[moving], taker] = label
            going_on = taker != entry[moving]
            moving, label = moving[going_on], released[going_on]


def settle_ties(labels: np.ndarray, values: np.ndarray, same_labels: list[tuple[int, int]]) -> None:
    """Give structural ties one answer, in place: lower slot, lower label.

    Entries with equal fitted values can swap labels, and labels with equal fits can swap entries,
    without changing the total score.
    """
    entries = labels.shape[1]
    for low, high in same_labels:
        at_low = np.where(labels == low, np.arange(entries), entries).min(axis=1)
        at_high = np.where(labels == high, np.arange(entries), entries).min(axis=1)
        rows = np.flatnonzero(at_high < at_low)
        labels[rows, at_high[rows]] = low
        taken = rows[at_low[rows] < entries]
        labels[taken, at_low[taken]] = high
    # Equal entries stand next to each other once the entries of each sample are sorted; blocks without any end here.
    samples = np.arange(len(labels))[:, None]
    order = np.lexsort(np.moveaxis(values, 2, 0), axis=1) if values.shape[2] else np.zeros_like(labels)
    ordered, given = values[samples, order], labels[samples, order]
    same = (ordered[:, 1:] == ordered[:, :-1]).all(axis=2) & (given[:, 1:] >= 0) & (given[:, :-1] >= 0)
    rows = np.flatnonzero(same.any(axis=1))
    slots, given = order[rows], given[rows]
    run = np.cumsum(np.concatenate([np.zeros((len(rows), 1), bool), ~same[rows]], axis=1), axis=1)
    # Slots and labels of every run in ascending order stand at the same places.
    row = np.repeat(rows, entries)
    by_slot = np.lexsort((slots.ravel(), run.ravel(), row))
    by_label = np.lexsort((given.ravel(), run.ravel(), row))
    labels[row[by_slot], slots.ravel()[by_slot]] = given.ravel()[by_label]


def fill_free_labels(labels: np.ndarray) -> np.ndarray:
    """Put entries without a label on the free labels, both in ascending order (square case)."""
    samples, entries = labels.shape
    free = np.ones((samples, entries + 1), dtype=bool)
    free[np.arange(samples)[:, None], labels] = False
    filled = labels.copy()
    filled[labels < 0] = np.nonzero(free[:, :entries])[1]
    return filled


def greatest_totals(score: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Labels of the valid entries with the greatest total as doubles add up, -1 for the others; for samples with near ties.

    Up to ``MAX_ORDERED`` slots all orders are compared, their scores added from the lowest on, and the first of equal orders counts.
    With more slots scores are added slot by slot, and of equal totals that counts in which the last entry has the highest label.
    """
    samples, slots, _ = score.shape
    if slots <= MAX_ORDERED:
        cells, orders = np.where(valid[:, :, None], score, 0.0), np.array(list(permutations(range(slots))))
        chosen = np.sort(cells[:, np.arange(slots), orders], axis=2)
        totals = chosen[:, :, 0]
        for place in range(1, slots):
            totals = totals + chosen[:, :, place]
        return np.where(valid, orders[totals.argmax(axis=1)], -1)
    rows = max(1, CELLS // (slots << slots))
    return np.concatenate([_sets_of_labels(score[at:at + rows], valid[at:at + rows]) for at in range(0, max(samples, 1), rows)])


def _sets_of_labels(score: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The best total of every set of used labels (a bit pattern), entry by entry, and the labels read off from the last entry back."""
    samples, slots, _ = score.shape
    sets = np.arange(1 << slots)
    holding = [sets[(sets >> label) & 1 == 1] for label in range(slots)]
    totals = [np.full((samples, len(sets)), -np.inf)]
    totals[0][:, 0] = 0.0
    for slot in range(slots):
        best = np.full((samples, len(sets)), -np.inf)
        for label, used in enumerate(holding):
            best[:, used] = np.maximum(best[:, used], totals[slot][:, used ^ (1 << label)] + score[:, slot, label, None])
        totals.append(np.where(valid[:, slot, None], best, totals[slot]))
    used, every = totals[slots].argmax(axis=1), np.arange(samples)
    labels = np.full((samples, slots), -1)
    for slot in reversed(range(slots)):
        open_rows = valid[:, slot].copy()
        for label in reversed(range(slots)):
            before = totals[slot][every, used ^ (1 << label)] + score[:, slot, label]
            here = open_rows & ((used >> label) & 1 == 1) & (before == totals[slot + 1][every, used])
            labels[here, slot] = label
            used = np.where(here, used ^ (1 << label), used)
            open_rows &= ~here
    return labels

"""The block matching against brute force."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotalign import PosteriorChain
from slotalign.operators.assignment import assign
from slotalign.operators.fits import NormalFit
from slotalign.operators.models import mv_normal_model
from slotalign.operators.matching import best_labels, fill_free_labels, settle_ties


def brute_force(score, valid):
    entries = np.flatnonzero(valid)
    return max(sum(score[e, label] for e, label in zip(entries, order))
               for order in permutations(range(score.shape[1]), len(entries)))


def total(score, labels):
    held = np.flatnonzero(labels >= 0)
    return sum(score[e, labels[e]] for e in held)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 5), st.sampled_from(["continuous", "coarse", "equal"]))
def test_totals_are_optimal(seed, size, kind):
    rng = np.random.default_rng(seed)
    score = rng.normal(size=(40, size, size)) * 10
    if kind == "coarse":
        score = np.round(score / 10)
    elif kind == "equal":
        score[:] = 1.5
    valid = rng.random((40, size)) < 0.7
    score[~valid] = np.nan
    labels = best_labels(score, valid)
    for s, v, chosen in zip(score, valid, labels):
        assert ((chosen >= 0) == v).all()
        assert len(set(chosen[v])) == v.sum()
        assert total(s, chosen) == pytest.approx(brute_force(s, v), abs=1e-9)


def test_wide_blocks_beat_every_exchange():
    rng = np.random.default_rng(5)
    score = rng.normal(size=(30, 20, 20))
    labels = best_labels(score, np.ones((30, 20), dtype=bool))
    for s, chosen in zip(score, labels):
        assert sorted(chosen) == list(range(20))
        own = s[np.arange(20), chosen]
        crossed = s[:, chosen]
        # no pair and no triple of entries gains by passing labels around
        assert (own[:, None] + own[None, :] >= crossed + crossed.T - 1e-12).all()
        triple = crossed[:, :, None] + crossed[None, :, :] + crossed.T[:, None, :]
        assert (own[:, None, None] + own[None, :, None] + own[None, None, :] >= triple - 1e-12).all()


def test_impossible_labels_are_avoided():
    score = np.array([[[-np.inf, 1.0], [-np.inf, 5.0]]])
    assert best_labels(score, np.array([[True, False]])).tolist() == [[1, -1]]
    assert sorted(best_labels(score, np.array([[True, True]]))[0]) == [0, 1]
    assert best_labels(score, np.array([[True, True]])).tolist() == [[0, 1]]


def test_equal_entries_take_labels_in_order():
    values = np.array([[[2.0], [1.0], [2.0]]])
    labels = np.array([[2, 1, 0]])
    settle_ties(labels, values, [])
    assert labels.tolist() == [[0, 1, 2]]


def test_equal_labels_take_entries_in_order():
    values = np.array([[[1.0], [2.0], [3.0]], [[1.0], [2.0], [np.nan]]])
    labels = np.array([[2, 1, 0], [2, 0, -1]])
    settle_ties(labels, values, [(1, 2)])
    assert labels.tolist() == [[1, 2, 0], [1, 0, -1]]


def test_missing_entries_fill_free_labels_in_order():
    labels = np.array([[-1, 3, -1, 0], [-1, -1, -1, -1], [3, 2, 1, 0]])
    assert fill_free_labels(labels).tolist() == [[1, 3, 2, 0], [0, 1, 2, 3], [3, 2, 1, 0]]


@pytest.mark.parametrize("params", [3, 4])
@pytest.mark.parametrize("slots", [2, 3])
def test_ties_have_one_rule_for_all_widths(spark, slots, params):
    """Equal fits, equal entries, a missing entry, and a label of probability 0."""
    values = np.full((4, slots, params), np.nan)
    values[0, :2], values[1, 1], values[2, :2] = 1.0, 2.0, [[3.0] * params, [0.5] * params]
    values[3, :2] = [[5.0] * params, [0.1] * params]
    chain = PosteriorChain.from_array(spark, values, slots, params)
    cov = np.stack([np.eye(params)] * slots)
    same = NormalFit(np.zeros((slots, params)), cov, tuple(range(params)))
    labels = lambda fit, prob: [r.labels for r in assign(chain, fit, np.array(prob), mv_normal_model()).orderBy("sample_id").collect()]
    rest = list(range(2, slots))
    got = labels(same, [0.5] * slots)
    assert got[0] == [0, 1, *rest] and got[1] == [1, 0, *rest] and got[2] == [0, 1, *rest]
    apart = NormalFit(np.arange(slots)[:, None] * 5.0 + np.zeros((slots, params)), cov, tuple(range(params)))
    assert labels(apart, [0.0] + [0.5] * (slots - 1))[3][:2] == ([1, 0] if slots == 2 else [2, 1])


def plain_hungarian(cost):
    """Total of the best assignment of all rows to distinct columns, one row after another."""
    rows, columns = cost.shape
    u, v, owner, way = np.zeros(rows + 1), np.zeros(columns + 1), np.zeros(columns + 1, int), np.zeros(columns + 1, int)
    for row in range(1, rows + 1):
        owner[0], column = row, 0
        least, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool)
        while True:
            used[column] = True
            here = owner[column]
            open_ones = np.flatnonzero(~used[1:]) + 1
            step = cost[here - 1, open_ones - 1] - u[here] - v[open_ones]
            better = step < least[open_ones]
            least[open_ones[better]], way[open_ones[better]] = step[better], column
            following = open_ones[least[open_ones].argmin()]
            delta = least[following]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            column = following
            if owner[column] == 0:
                break
        while column:
            owner[column], column = owner[way[column]], way[column]
    return sum(cost[owner[c] - 1, c - 1] for c in range(1, columns + 1) if owner[c])


@pytest.mark.parametrize("slots, samples", [(20, 60), (100, 6), (300, 2)])
@pytest.mark.parametrize("spread", [0.0, 2.0, 30.0])
def test_wide_samples(slots, samples, spread):
    """From all entries wanting the same labels to none."""
    rng = np.random.default_rng(slots)
    centres = rng.normal(size=(slots, 2)) * spread
    entries = centres + rng.normal(size=(samples, slots, 2))
    score = -0.5 * ((entries[:, :, None] - centres) ** 2).sum(axis=3) - rng.random(slots)
    valid = rng.random((samples, slots)) < 0.8
    labels = best_labels(score, valid)
    assert (labels[~valid] == -1).all()
    for row in range(samples):
        there = np.flatnonzero(valid[row])
        got = labels[row, there]
        assert len(set(got.tolist())) == len(there) and got.min() >= 0
        assert -score[row, there, got].sum() == pytest.approx(plain_hungarian(-score[row, there]), abs=1e-8)


@pytest.mark.parametrize("slots", [3, 4])
def test_labels_that_share_medians_tie_as_doubles_add_up(spark, slots):
    """All labels have one distribution and other probabilities: every order has the same total but for rounding."""
    import math
    from functools import reduce
    from itertools import permutations
    from operator import add

    from slotalign.operators.entry_fits import RobustFit
    from slotalign.operators.models import robust_model

    rng = np.random.default_rng(5)
    values = rng.integers(1, 50, (300, slots, 2)) / 7.0
    values[rng.random((300, slots)) < 0.2] = np.nan
    fit = RobustFit(np.full((slots, 2), [3.125, 4.0625]), np.full((slots, 2), [1.9, 2.3]), (0, 1))
    prob = np.linspace(0.4, 0.6, slots)
    constant = math.log(0.75 * math.sqrt(math.pi)) - 0.5 * math.log(4 * math.pi)

    def plain(numbers):
        return reduce(add, numbers, 0.0)  # sum() compensates for rounding

    def score(entry, label):
        total = 0.0
        for value, middle, scale in zip(entry, fit.location[label].tolist(), fit.scale[label].tolist()):
            scaled = (value - middle) / scale
            total = total + constant - math.log(scale) - 2.5 * math.log(1 + scaled * scaled / 4)
        return math.log(prob[label]) + total

    chain = PosteriorChain.from_array(spark, values, slots, 2)
    rows = assign(chain, fit, prob, robust_model()).orderBy("sample_id").collect()
    for entries, row in zip(values, rows):
        there = [s for s in range(slots) if not np.isnan(entries[s, 0])]
        cells = {(s, label): score(entries[s].tolist(), label) for s in there for label in range(slots)}
        found = [row["labels"][s] for s in there]
        if slots == 3:
            totals = [(plain(sorted(cells.get((s, order[s]), 0.0) for s in range(slots))), order) for order in permutations(range(slots))]
            first = next(order for total, order in totals if total == max(totals)[0])
            assert found == [first[s] for s in there]
        else:
            totals = [(plain(cells[s, label] for s, label in zip(there, order)), order) for order in permutations(range(slots), len(there))]
            used = min((sum(1 << label for label in order) for total, order in totals if total == max(totals)[0]), default=0)
            assert (sum(1 << label for label in found)) == used
            assert plain(cells[s, label] for s, label in zip(there, found)) == max(totals)[0]

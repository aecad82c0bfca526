"""Exact sums, fits over entries, and bounds that leave the loop's steps as they are."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_relabel import one_step, plain_loop, same_samples

from slotalign import PosteriorChain
from slotalign.functions.columns import with_log_floor
from slotalign.operators.assignment import block_matcher
from slotalign.operators.bounds import Coordinates, layout_gaps, movement_between, slacks
from slotalign.operators.entry_fits import (
    EntryEstimator,
    add_counts,
    bucket_values,
    empty_sketches,
    merge_sketches,
    quantile,
    robust_estimate,
    sketch_buckets,
    update_sketches,
)
from slotalign.operators.exact import SlotSums, limbs, slack_bin, total_of
from slotalign.operators.fits import NormalFit, create_parametric_fit, mv_normal_fit
from slotalign.operators.matching import best_labels, fill_free_labels
from slotalign.operators.models import LabelModel, mv_normal_model, normal_density_of_block, robust_model, uni_normal_model
from slotalign.operators.moments import measure_entries
from slotalign.operators.relabel import Alignment, create_relabel_samples, relabel_mv_normal, relabel_samples_one_iteration

NUMBERS = st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300).filter(lambda x: x == 0 or abs(x) > 1e-290)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(NUMBERS, NUMBERS), min_size=1, max_size=12))
def test_sums_are_those_of_fractions(pairs):
    values = np.array(pairs)
    assert sum(Fraction(float(w)) * Fraction(2) ** (19 * k) for k, whole in limbs(values[:, :1]) for w in whole[:, 0]) \
        == sum(Fraction(a) for a, _ in pairs)
    sums = SlotSums(1, 2)
    sums.add_entries(np.zeros(len(values), int), values)
    sums.close()
    for i in range(2):
        assert total_of({k: s[0, i] for k, s in sums.first.items()}) == sum(Fraction(p[i]) for p in pairs)
        for j in range(2):
            found = total_of({k: s[0, i, j] for k, s in sums.second.items()})
            wanted = sum(Fraction(p[i]) * Fraction(p[j]) for p in pairs)
            # Limbs below 2^-1064 do not count, only products of the smallest values have them.
            assert abs(found - wanted) <= Fraction(1, 2**700)
    sums.add_entries(np.zeros(len(values), int), values[::-1], sign=-1)
    sums.close()
    assert not any(s.any() for s in (*sums.first.values(), *sums.second.values())) and sums.valid[0] == 0


def test_many_entries_and_wide_ranges():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(30_000, 3)) * 10.0 ** rng.integers(-12, 12, size=(30_000, 1))
    labels = np.sort(rng.integers(0, 2, 30_000))
    sums = SlotSums(2, 3)
    sums.add_entries(labels, values)
    mean, scatter = sums.central()
    for label in (0, 1):
        own = values[labels == label]
        assert mean[label].tolist() == [float(sum(map(Fraction, own[:, i].tolist())) / len(own)) for i in range(3)]
        centred = own - own.mean(axis=0)
        np.testing.assert_allclose(scatter[label], centred.T @ centred, rtol=1e-9)
    with pytest.raises(ValueError, match="finite"):
        sums.add_entries(np.zeros(1, int), np.array([[math.inf, 0, 0]]))


@pytest.fixture(scope="module")
def rough(clusters):
    """Values whose sums in doubles depend on the order."""
    return clusters[0] * 10.0 ** np.random.default_rng(3).integers(-3, 4, size=(400, 1, 1)) + 0.1


@pytest.mark.parametrize("model", [mv_normal_model(), uni_normal_model(1), robust_model()])
def test_every_bit_is_the_same_for_any_partitioning(spark, rough, model):
    chain = PosteriorChain.from_array(spark, rough, 3, 2)
    seen = []
    for parts in (1, 7, 64):
        dealt = chain.with_frame(chain.frame.repartition(parts))
        result = create_relabel_samples(model)(dealt, num_iterations=3)
        fit = create_parametric_fit(model.estimator, model.single_parameter)(dealt, 3)
        one = relabel_samples_one_iteration(dealt, fit, np.full(3, 0.5), model)[1].first()["mean_cost"]
        numbers = (fit.mean.tolist(), fit.cov.tolist()) if isinstance(fit, NormalFit) else (fit.location.tolist(), fit.scale.tolist())
        seen.append((result.trace, numbers, one))
    assert seen[0] == seen[1] == seen[2]


def test_states_of_many_tasks_meet_in_groups(spark, rough, monkeypatch):
    chain = PosteriorChain.from_array(spark, rough, 3, 2)
    straight = mv_normal_fit(chain, 3)
    monkeypatch.setattr("slotalign.operators.moments.FAN_IN", 3)
    grouped = chain.with_frame(chain.frame.repartition(11))
    assert mv_normal_fit(grouped, 3).cov.tolist() == straight.cov.tolist()
    left, right = (create_parametric_fit(robust_estimate)(c, 3) for c in (chain, grouped))
    assert left.location.tolist() == right.location.tolist() and left.scale.tolist() == right.scale.tolist()


# ---- fits over entries ------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(NUMBERS, min_size=1, max_size=60), st.floats(0.01, 1.0), st.integers(0, 60))
def test_sketched_quantiles(values, share, cut):
    both = [update_sketches(empty_sketches(1), np.array(part).reshape(-1, 1)) for part in (values[:cut], values[cut:])]
    found = quantile(merge_sketches(*both)[0], share)
    exact = sorted(values)[max(1, math.ceil(share * len(values))) - 1]
    assert found == quantile(add_counts((np.empty(0, int), np.empty(0, int)), *np.unique(sketch_buckets(np.array(values)), return_counts=True)), share)
    assert abs(found - exact) <= abs(exact) * 2.0**-8
    buckets = sketch_buckets(np.array(sorted(values)))
    assert (np.diff(buckets) >= 0).all() and (np.diff(bucket_values(np.unique(buckets))) > 0).all()


def robust_slots(values):
    def middle(rows, share):
        ordered = np.sort(rows, axis=0)
        return bucket_values(sketch_buckets(ordered[math.ceil(share * len(ordered)) - 1]))

    everything = values.reshape(-1, values.shape[2])
    location, scale = [], []
    for slot in range(values.shape[1]):
        rows = values[:, slot][~np.isnan(values[:, slot]).any(axis=1)]
        rows = rows if len(rows) >= 8 else everything[~np.isnan(everything).any(axis=1)]
        location.append(middle(rows, 0.5))
        scale.append((middle(rows, 0.75) - middle(rows, 0.25)) / 2 / 0.7406970841126834)
    return np.array(location), np.array(scale)


def student(values, location, scale):
    z = (values - location) / scale
    constant = math.lgamma(2.5) - math.lgamma(2.0) - 0.5 * math.log(4 * math.pi)
    return (constant - np.log(scale) - 2.5 * np.log1p(z * z / 4)).sum(axis=-1)


@pytest.mark.parametrize("width", [3, 4])
def test_robust_model_runs_in_the_loop(spark, clusters, width, monkeypatch):
    values = clusters[0].copy()
    values[::17, 1] *= 40          # outliers
    chain = PosteriorChain.from_array(spark, values, 3, 2)
    current = np.concatenate([values, np.full((400, width - 3, 2), np.nan)], axis=1)
    result = create_relabel_samples(robust_model())(chain, width, num_iterations=4)
    monkeypatch.setattr("test_relabel.log_normal", student)
    for step in result.trace:
        location, scale = robust_slots(current)
        prob = np.clip((~np.isnan(current[:, :, 0])).mean(axis=0), 0.01, 0.99)
        np.testing.assert_allclose(step.prob_in_model, prob)
        current, cost = one_step(current, location, scale, prob, None)
        assert step.cost == pytest.approx(cost, rel=1e-9)
    same_samples(result.to_array(), current)


def test_an_own_estimator(spark, clusters):
    """Means of the logarithms' squares, which no moments of the entries tell."""
    def finish(states, given):
        mean = np.array([[total / max(count, 1)] for count, total in states])
        return NormalFit(np.repeat(mean, 2, axis=1), np.stack([np.eye(2)] * len(states)), given.params)

    estimator = EntryEstimator(lambda width: (0, 0.0), lambda s, rows: (s[0] + len(rows), s[1] + float((np.log(np.abs(rows)) ** 2).sum())),
                               lambda a, b: (a[0] + b[0], a[1] + b[1]), finish)
    values = clusters[0].copy()
    values[7:, 2] = np.nan         # too few for a fit of their own
    chain = PosteriorChain.from_array(spark, values, 3, 2)
    fit = create_parametric_fit(estimator)(chain, 3)
    squares = np.log(np.abs(values)) ** 2
    slots = [squares[:, s][~np.isnan(values[:, s]).any(axis=1)] for s in range(3)]
    wanted = [s.sum() / len(s) for s in (slots[0], slots[1], np.concatenate(slots))]
    np.testing.assert_allclose(fit.mean[:, 0], wanted)
    one = create_parametric_fit(estimator, 1)(chain, 2)
    assert one.mean.shape == (2, 2) and one.params == (1,)
    result = create_relabel_samples(LabelModel(estimator, normal_density_of_block))(chain, num_iterations=3)
    np.testing.assert_array_equal(np.sort(result.to_array(), axis=1), np.sort(values, axis=1))


def test_equal_quartiles_are_named(spark):
    values = np.random.default_rng(1).normal(size=(40, 1, 2))
    values[:36, :, 1] = 2.0
    with pytest.raises(ValueError, match="slot 0"):
        create_relabel_samples(robust_model())(PosteriorChain.from_array(spark, values, 1, 2))


# ---- bounds -----------------------------------------------------------------------------------


def random_case(rng, samples, slots, params):
    values = rng.normal(size=(samples, slots, params)) * 2
    values[rng.random((samples, slots)) > 0.7] = np.nan
    return np.moveaxis(values, 2, 0)


def fit_of(rng, slots, params, move=0.0):
    mean = np.random.default_rng(5).normal(size=(slots, params)) + move * rng.normal(size=(slots, params))
    root = np.random.default_rng(6).normal(size=(slots, params, params)) / 2 + np.eye(params) + move * rng.normal(size=(slots, params, params))
    return NormalFit(mean, root @ np.swapaxes(root, 1, 2) + 0.1 * np.eye(params), tuple(range(params)))


def test_gaps_are_those_to_the_second_best_layout():
    from itertools import permutations

    rng = np.random.default_rng(2)
    score = rng.normal(size=(60, 4, 4)) * 3
    valid = rng.random((60, 4)) < 0.7
    labels = fill_free_labels(best_labels(np.where(valid[:, :, None], score, np.nan), valid))
    gaps = layout_gaps(np.where(valid[:, :, None], score, np.nan), labels, valid)
    for row in range(60):
        there = np.flatnonzero(valid[row])
        totals = sorted({tuple(order[e] for e in there): sum(score[row, e, order[e]] for e in there)
                         for order in permutations(range(4))}.values(), reverse=True)
        assert gaps[row] == pytest.approx(totals[0] - totals[1] if len(totals) > 1 else np.inf)


@pytest.mark.parametrize("move", [1e-3, 1e-2, 0.1])
def test_what_the_bounds_spare_stays(move):
    rng, model = np.random.default_rng(9), mv_normal_model()
    spared = 0
    for turn in range(20):
        cube = random_case(rng, 200, 5, 2)
        old, new = fit_of(rng, 5, 2), fit_of(rng, 5, 2, move)
        p, q = rng.uniform(0.2, 0.8, 5), rng.uniform(0.2, 0.8, 5)
        q = p + move * (q - p)
        everything = cube[:, ~np.isnan(cube).any(axis=0)]
        place = Coordinates(everything.mean(axis=1), np.linalg.cholesky(np.cov(everything)))
        logs = [with_log_floor(x)[0] for x in (p, q)]
        movement = movement_between((old, logs[0]), (new, logs[1]), place)
        place = place.weighing(movement) if turn % 2 else place
        before, _, slack = block_matcher(5, old, p, model, place)(cube)
        after = block_matcher(5, new, q, model)(cube)[0]
        safe = slack > place.units(movement)
        valid = ~np.isnan(cube).any(axis=0)
        assert (before == after)[safe][valid[safe]].all()
        spared += int(safe.sum())
    assert spared > 0 or move > 0.05


def test_pruned_steps_are_the_full_ones(spark):
    rng = np.random.default_rng(12)
    centres = np.array([[0.0, 0.0], [4.0, -3.0], [-3.0, 5.0], [2.0, 3.0]])
    values = centres + rng.normal(size=(1500, 4, 2)) * 1.4
    values[rng.random((1500, 4)) > 0.8] = np.nan
    values = np.take_along_axis(values, rng.permuted(np.tile(np.arange(4), (1500, 1)), axis=1)[:, :, None], axis=1)
    chain = PosteriorChain.from_array(spark, values, 4, 2).staged()
    full, pruned = (Alignment.of(chain, prune=p).run(uni_normal_model(0), 200).run(mv_normal_model(), 200) for p in (False, True))
    assert [(t.cost, t.changed, t.prob_in_model) for t in full.trace] == [(t.cost, t.changed, t.prob_in_model) for t in pruned.trace]
    same_samples(full.result().to_array(), pruned.result().to_array())
    matched = [t.matched for t in pruned.trace]
    assert not pruned.trace[-1].changed and {t.matched for t in full.trace} == {1500}
    assert min(matched) < 400 and sum(matched) < 0.9 * 1500 * len(matched)


def test_five_slots_settle_like_a_plain_loop(spark):
    rng = np.random.default_rng(13)
    values = rng.normal(size=(5, 2)) * 4 + rng.normal(size=(250, 5, 2))
    values[rng.random((250, 5)) > 0.8] = np.nan
    values = np.take_along_axis(values, rng.permuted(np.tile(np.arange(5), (250, 1)), axis=1)[:, :, None], axis=1)
    result = relabel_mv_normal(PosteriorChain.from_array(spark, values, 5, 2), num_iterations=200)
    assert not result.trace[-1].changed
    expected, costs, _ = plain_loop(values, len(result.trace))
    np.testing.assert_allclose([t.cost for t in result.trace], costs, rtol=1e-9)
    same_samples(result.to_array(), expected)


def test_one_map_per_iteration_and_pruned_reads(spark, clusters):
    """A pass reads the parameters it uses and moves nothing; a pruned one filters at the scan."""
    seen = []
    chain = PosteriorChain.from_array(spark, clusters[0], 3, 2).staged()
    fit, prob = mv_normal_fit(chain, 3), np.full(3, 0.5)
    match = block_matcher(3, fit, prob, mv_normal_model())
    original = type(chain.frame).mapInArrow

    def record(frame, function, schema, *rest):
        made = original(frame, function, schema, *rest)
        seen.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    type(chain.frame).mapInArrow = record
    try:
        layout = measure_entries(chain.by_param().where("p0[0] > 0"), 3, [1], match, [0, 1])
    finally:
        type(chain.frame).mapInArrow = original
    assert layout.sums.read == layout.sums.samples > 0
    assert len(seen) == 1 and "Exchange" not in seen[0] and "ReadSchema: struct<sample_id:bigint,p0:array<double>,p1:array<double>>" in seen[0]


def test_slack_bins_are_ordered():
    values = np.array([0.0, 1e-40, 1e-5, 1.01e-5, 0.3, 5.0, 1e20, np.inf])
    assert (np.diff(slack_bin(values)) >= 0).all() and slack_bin(values)[0] == 0
    assert slacks(np.ones(1), np.ones((1, 2), bool), np.ones((1, 2)), (1, 1, 1))[0] == pytest.approx(1 / 6)


def test_packed_blocks_measure_the_same(spark):
    """The loop's blocks, also with a matcher, and with the samples of a written layout that may move."""
    from slotalign.operators.assignment import assign_with_slack, block_matcher
    from slotalign.operators.bounds import Coordinates
    from slotalign.operators.fits import create_parametric_fit
    from slotalign.operators.moments import packed

    rng = np.random.default_rng(8)
    values = rng.normal(size=(9000, 3, 2)) + np.arange(3)[:, None]
    values[rng.random((9000, 3)) < 0.3] = np.nan
    chain = PosteriorChain.from_array(spark, values, 3, 2)
    blocks = packed(chain.by_param())
    plain = measure_entries(chain.by_param(), 3, [0, 1])
    fit, prob = create_parametric_fit(mv_normal_model().estimator)(chain, 3), np.array([0.5, 0.6, 0.7])
    match = block_matcher(3, fit, prob, mv_normal_model())
    full = measure_entries(chain.by_param(), 3, [0, 1], match, [0, 1])
    coordinates = Coordinates.of(plain.moments)
    written = assign_with_slack(blocks, 3, fit, prob, mv_normal_model(), coordinates)
    for made, expected in ((measure_entries(blocks, 3, [0, 1]), plain), (measure_entries(blocks, 3, [0, 1], match, [0, 1]), full),
                           (measure_entries(written, 3, [0, 1]), full)):
        assert made.sums.layout == expected.sums.layout and made.sums.samples == 9000
        assert made.sums.first.keys() == expected.sums.first.keys()
        np.testing.assert_array_equal(made.sums.central()[1], expected.sums.central()[1])
    none = measure_entries(written.where("low <= 0.5"), 3, [0, 1], match, [0, 1], limit=0.5)
    assert 0 < none.sums.read < 9000 and none.sums.layout == 0 and not none.sums.valid.any()

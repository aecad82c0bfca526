"""Written layouts whose samples are held by prices: what they spare stays, and the loop takes the steps of full passes."""

import numpy as np
import pytest

from slotalign import PosteriorChain
from slotalign.functions.columns import with_log_floor
from slotalign.operators.assignment import assign_with_slack, block_matcher, renewed
from slotalign.operators.bounds import Coordinates, keeper, movement_between
from slotalign.operators.fits import NormalFit
from slotalign.operators.models import mv_normal_model, uni_normal_model
from slotalign.operators.moments import WrittenBlock, may_move, measure_entries, packed
from slotalign.operators.relabel import Alignment


def shuffled_sources(rng, samples, slots, params, spread):
    values = rng.normal(size=(slots, params)) * spread + rng.normal(size=(samples, slots, params))
    values[rng.random((samples, slots)) > 0.6] = np.nan
    return np.take_along_axis(values, rng.permuted(np.tile(np.arange(slots), (samples, 1)), axis=1)[:, :, None], axis=1)


def fit_of(rng, slots, params, move):
    mean = np.random.default_rng(5).normal(size=(slots, params)) + move * rng.normal(size=(slots, params))
    root = np.random.default_rng(6).normal(size=(slots, params, params)) / 2 + np.eye(params) + move * rng.normal(size=(slots, params, params))
    return NormalFit(mean, root @ np.swapaxes(root, 1, 2) + 0.1 * np.eye(params), tuple(range(params)))


@pytest.mark.parametrize("slots", [1, 2, 5, 7])
@pytest.mark.parametrize("move", [1e-3, 1e-2, 0.1])
def test_what_prices_hold_stays(slots, move):
    rng, model = np.random.default_rng(9), mv_normal_model()
    held = all_samples = 0
    for turn in range(10):
        cube = np.moveaxis(shuffled_sources(rng, 300, slots, 2, 1.5), 2, 0)
        if turn % 2:
            cube[:, ::3, 0] = cube[:, ::3, slots - 1]  # equal entries tie
        cube[1, ::17, 0] = np.nan  # partly missing
        old, new = fit_of(rng, slots, 2, 0.0), fit_of(rng, slots, 2, move)
        p = rng.uniform(0.2, 0.8, slots)
        q = p + move * (rng.uniform(0.2, 0.8, slots) - p)
        everything = cube[:, ~np.isnan(cube).any(axis=0)]
        place = Coordinates(everything.mean(axis=1), np.linalg.cholesky(np.cov(everything)))
        before, _, slack, prices = block_matcher(slots, old, p, model, place, priced=True)(cube)
        after = block_matcher(slots, new, q, model)(cube)[0]
        block = WrittenBlock.of(np.arange(300), cube, before, slack, prices)
        np.testing.assert_array_equal(block.dense(np.ones(300, bool)), cube)
        may = may_move(np.inf, keeper(new, with_log_floor(q)[0], place), [0, 1])(block)
        assert (before == after)[~may].all()
        held, all_samples = held + int((~may).sum()), all_samples + 300
    assert held > 0.4 * all_samples or move > 0.05


def test_a_renewed_layout_is_the_one_of_the_later_fit(spark):
    rng, model, place = np.random.default_rng(3), mv_normal_model(), Coordinates(np.zeros(2), np.eye(2))
    chain = PosteriorChain.from_array(spark, shuffled_sources(rng, 6000, 4, 2, 2.0), 4, 2)
    blocks, prob = packed(chain.by_param()), np.array([0.5, 0.6, 0.7, 0.55])
    old, new = fit_of(rng, 4, 2, 0.0), fit_of(rng, 4, 2, 0.02)
    log_in = with_log_floor(prob)[0]
    swing = place.units(movement_between((old, log_in), (new, log_in), place))
    written = assign_with_slack(blocks, 4, old, prob, model, place)
    later = renewed(written, 4, new, prob, model, place, swing, keeper(new, log_in, place))
    full = measure_entries(blocks, 4, [0, 1], block_matcher(4, new, prob, model), [0, 1])
    made = measure_entries(later, 4, [0, 1])
    assert made.sums.layout == full.sums.layout and made.sums.samples == 6000
    np.testing.assert_array_equal(made.sums.central()[1], full.sums.central()[1])
    none = measure_entries(later, 4, [0, 1], block_matcher(4, new, prob, model), [0, 1], limit=np.inf, keeps=keeper(new, log_in, place))
    assert none.sums.read < 600 and none.sums.layout == 0 and not none.sums.valid.any()


def test_slow_steps_match_few_samples(spark):
    """Sources that overlap settle slowly; nearly all steps are those of few samples, and the same as in full passes."""
    values = shuffled_sources(np.random.default_rng(12), 2500, 5, 2, 2.0)
    values = values[~np.isnan(values).all(axis=(1, 2))]
    chain = PosteriorChain.from_array(spark, values, 5, 2).staged()
    full, pruned = (Alignment.of(chain, prune=p).run(uni_normal_model(0), 200).run(mv_normal_model(), 200) for p in (False, True))
    assert [(t.cost, t.changed, t.prob_in_model) for t in full.trace] == [(t.cost, t.changed, t.prob_in_model) for t in pruned.trace]
    np.testing.assert_array_equal(full.result().frame.orderBy("sample_id").toArrow()["entries"].to_pylist()[0],
                                  pruned.result().frame.orderBy("sample_id").toArrow()["entries"].to_pylist()[0])
    assert sum(t.matched for t in pruned.trace) < 0.35 * len(values) * len(pruned.trace)

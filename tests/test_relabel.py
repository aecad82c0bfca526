"""The loop against a plain array version that carries the reordered samples along."""

import logging
from itertools import permutations

import numpy as np
import pytest

from slotalign import PosteriorChain, make_catalog_mv_normal
from slotalign.operators.fits import NormalFit
from slotalign.operators.models import LabelModel, mv_normal_model
from slotalign.operators.relabel import (
    Alignment,
    create_relabel_samples,
    relabel_mv_normal,
    relabel_univariate_normal,
    trace_frame,
)
from slotalign.plans.catalog import catalog_summary


def log_normal(values, mean, cov):
    centred = values - mean
    distance = np.einsum("...i,ij,...j->...", centred, np.linalg.inv(cov), centred)
    return -0.5 * (len(mean) * np.log(2 * np.pi) + np.log(np.linalg.det(cov)) + distance)


def fit_slots(values, param):
    means, covs = [], []
    for slot in range(values.shape[1]):
        rows = values[:, slot] if param is None else values[:, slot, [param]]
        rows = rows[~np.isnan(rows).any(axis=1)]
        ddof = 1 if param is None else 0
        if len(rows) < 8:
            if param is None:
                rows = values.reshape(-1, values.shape[2])
                rows = rows[~np.isnan(rows).any(axis=1)]
            else:
                rows, ddof = values[~np.isnan(values)].reshape(-1, 1), 1
        means.append(rows.mean(axis=0))
        covs.append(np.atleast_2d(np.cov(rows.T, ddof=ddof)))
    prob = np.clip((~np.isnan(values[:, :, 0])).mean(axis=0), 0.01, 0.99)
    return means, covs, prob


def one_step(values, means, covs, prob, param):
    moved, total = [], 0.0
    for sample in values:
        seen = sample if param is None else sample[:, [param]]
        score = np.array([np.log(prob[i]) + log_normal(seen, means[i], covs[i]) for i in range(len(means))])
        score = np.where(np.isnan(score), np.log1p(-prob)[None, :], score)
        best = max(permutations(range(len(sample))), key=lambda order: sum(score[i, e] for i, e in enumerate(order)))
        total -= sum(score[i, e] for i, e in enumerate(best))
        moved.append(sample[list(best)])
    return np.array(moved), total / len(values)


def plain_loop(values, iterations, param=None):
    costs, probs = [], []
    for _ in range(iterations):
        means, covs, prob = fit_slots(values, param)
        values, cost = one_step(values, means, covs, prob, param)
        costs.append(cost)
        probs.append(prob)
    return values, costs, probs


def same_samples(left, right):
    np.testing.assert_array_equal(left, right)


@pytest.mark.parametrize("param", [None, 0, 1])
def test_every_iteration_matches(spark, clusters, param):
    values, _ = clusters
    expected, costs, probs = plain_loop(values, 4, param)
    chain = PosteriorChain.from_array(spark, values, 3, 2)
    if param is None:
        result = relabel_mv_normal(chain, num_iterations=4)
    else:
        result = relabel_univariate_normal(chain, num_iterations=4, init_parameter_index=param)
    done = len(result.trace)
    np.testing.assert_allclose([t.cost for t in result.trace], costs[:done], rtol=1e-9)
    np.testing.assert_allclose([t.prob_in_model for t in result.trace], probs[:done])
    same_samples(result.to_array(), expected)
    assert result.cost_by_width == {3: result.trace[-1].cost}


def test_two_slots(spark, clusters):
    values = clusters[0][:, :2]
    expected, costs, _ = plain_loop(values, 3)
    result = relabel_mv_normal(PosteriorChain.from_array(spark, values, 2, 2), num_iterations=3)
    np.testing.assert_allclose([t.cost for t in result.trace], costs[:len(result.trace)], rtol=1e-9)
    same_samples(result.to_array(), expected)


def test_one_slot(spark, clusters):
    values = clusters[0][:, :1]
    result = relabel_mv_normal(PosteriorChain.from_array(spark, values, 1, 2))
    same_samples(result.to_array(), values)
    assert [t.changed for t in result.trace] == [False]


def test_extra_slots(spark, clusters):
    values, _ = clusters
    wide = np.concatenate([values, np.full((400, 1, 2), np.nan)], axis=1)
    expected, costs, _ = plain_loop(wide, 3)
    result = relabel_mv_normal(PosteriorChain.from_array(spark, values, 3, 2), max_num_sources=4, num_iterations=3)
    np.testing.assert_allclose([t.cost for t in result.trace], costs[:len(result.trace)], rtol=1e-9)
    same_samples(result.to_array(), expected)
    assert result.num_sources == 4 and result.trans_dimensional


def test_stops_when_nothing_moves(spark, clusters):
    values, _ = clusters
    result = relabel_mv_normal(PosteriorChain.from_array(spark, values, 3, 2), num_iterations=50)
    done = len(result.trace)
    assert done < 50
    assert [t.changed for t in result.trace] == [True] * (done - 1) + [False]
    expected, costs, _ = plain_loop(values, done + 1)
    assert costs[-1] == pytest.approx(costs[-2], rel=1e-12)
    same_samples(result.to_array(), expected)
    assert trace_frame(spark, result).count() == done


def test_catalog_recovers_sources(spark, clusters):
    shuffled, truth = clusters
    catalog = make_catalog_mv_normal(PosteriorChain.from_array(spark, shuffled, 3, 2), 3,
                                     initialization_param_index=0, shuffle_seed=1)
    values = catalog.to_array()
    order = np.argsort(np.nanmean(values[:, :, 0], axis=0))
    true_order = np.argsort(np.nanmean(truth[:, :, 0], axis=0))
    same_samples(values[:, order], truth[:, true_order])
    presence = {r["slot"]: r["presence"] for r in catalog_summary(catalog).collect()}
    np.testing.assert_allclose([presence[s] for s in order], (~np.isnan(truth[:, true_order, 0])).mean(axis=0))
    np.testing.assert_allclose(catalog.prob_in_model, [presence[s] for s in range(3)])


def test_catalog_keeps_the_entries_of_each_sample(spark, clusters):
    shuffled, _ = clusters
    catalog = make_catalog_mv_normal(PosteriorChain.from_array(spark, shuffled, 3, 2), 5, num_iterations=2)
    values = catalog.to_array()
    assert values.shape == (400, 5, 2)
    padded = np.concatenate([shuffled, np.full((400, 2, 2), np.nan)], axis=1)
    np.testing.assert_array_equal(np.sort(values, axis=1), np.sort(padded, axis=1))


def test_partly_missing_entries_stay_in_their_sample(spark, clusters):
    values = clusters[0].copy()
    values[::5, 0, 1] = np.nan
    result = relabel_mv_normal(PosteriorChain.from_array(spark, values, 3, 2), num_iterations=3)
    np.testing.assert_array_equal(np.sort(result.to_array(), axis=1), np.sort(values, axis=1))


def test_no_iterations(spark, clusters):
    chain = PosteriorChain.from_array(spark, clusters[0], 3, 2, trans_dimensional=True)
    result = relabel_mv_normal(chain, num_iterations=0)
    same_samples(result.to_array(), clusters[0])
    assert result.trans_dimensional and result.trace == ()


def test_too_few_labels(spark, dense):
    with pytest.raises(ValueError):
        relabel_mv_normal(dense, max_num_sources=1)
    with pytest.raises(ValueError):
        make_catalog_mv_normal(dense, 1)


def test_custom_model(spark, clusters):
    """A user's estimator and density: independent Laplace scores around the slot means."""

    def estimate(moments, width, given):
        scale = np.sqrt(np.diagonal(moments.scatter, axis1=1, axis2=2) / moments.valid[:, None] / 2)
        return NormalFit(moments.mean, np.stack([np.diag(s**2) for s in scale]), given.params)

    def density(values, fit, label):
        scale = np.sqrt(np.diag(fit.cov[label]))
        return -(np.abs(values - fit.mean[label]) / scale + np.log(2 * scale)).sum(axis=1)

    relabel = create_relabel_samples(LabelModel(estimate, density))
    result = relabel(PosteriorChain.from_array(spark, clusters[0], 3, 2), num_iterations=30)
    assert not result.trace[-1].changed
    np.testing.assert_array_equal(np.sort(result.to_array(), axis=1), np.sort(clusters[0], axis=1))


def test_wide_chain(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 3)) * 30
    truth = centres + rng.normal(size=(300, 8, 3))
    truth[rng.random((300, 8)) > 0.7] = np.nan
    start = truth.copy()
    for sample in start[:100]:
        rng.shuffle(sample)
    result = relabel_mv_normal(PosteriorChain.from_array(spark, start, 8, 3), num_iterations=40)
    same_samples(result.to_array(), truth)


def test_result_does_not_depend_on_partitions(spark, clusters):
    chain = PosteriorChain.from_array(spark, clusters[0], 3, 2)
    scattered = chain.with_frame(chain.frame.repartition(9))
    same_samples(relabel_mv_normal(chain, num_iterations=5).to_array(),
                 relabel_mv_normal(scattered, num_iterations=5).to_array())


def test_filter_on_result_matches_once(spark, clusters):
    result = Alignment.of(PosteriorChain.from_array(spark, clusters[0], 3, 2)).run(mv_normal_model(), 1).result()
    plan = result.long_columns().where("p0 > 3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_progress_is_logged(spark, clusters, caplog):
    with caplog.at_level(logging.INFO, logger="slotalign"):
        relabel_mv_normal(PosteriorChain.from_array(spark, clusters[0], 3, 2), num_iterations=1)
    assert "iteration 1: mean cost" in caplog.text

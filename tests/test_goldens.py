"""Known values for fits, scores and one relabeling step."""

import numpy as np
import pytest

from slotalign.operators.assignment import cost_matrix, create_compute_cost_matrix
from slotalign.operators.fits import find_prob_in_model, mv_normal_fit, uni_normal_fit_single_parameter
from slotalign.operators.models import mv_normal_model, uni_normal_model
from slotalign.operators.relabel import relabel_posterior_chain_one_iteration, relabel_samples_one_iteration


def matrix(scores, sample):
    rows = scores.where(f"sample_id = {sample}").collect()
    result = np.full((2, 2), np.nan)
    for row in rows:
        result[row["label"], row["slot"]] = row["score"]
    return result


def test_cost_matrix_without_gaps(dense):
    compute = create_compute_cost_matrix(mv_normal_model())
    scores = compute(dense, mv_normal_fit(dense, 2), find_prob_in_model(dense, 2, eps=0))
    expected = [[0.30395628, -0.05770942], [0.29753514, -0.06278939]]
    np.testing.assert_allclose(matrix(scores, 0), expected, rtol=1e-7)


def test_cost_matrix_fills_by_slot(uneven_gaps):
    prob = find_prob_in_model(uneven_gaps, 2, eps=0)
    scores = cost_matrix(uneven_gaps, mv_normal_fit(uneven_gaps, 2), prob, mv_normal_model())
    expected = [[-0.44169619, -0.40556511], [-0.8618358, -0.40556511]]
    np.testing.assert_allclose(matrix(scores, 2), expected, rtol=1e-7)


def test_univariate_fit(half_missing):
    fit = uni_normal_fit_single_parameter(half_missing, 2, 0)
    np.testing.assert_allclose(fit.mean[:, 0], [0.49645889, 0.49523962], rtol=1e-7)
    np.testing.assert_allclose(fit.std, [0.2895911, 0.29129024], rtol=1e-7)


def test_univariate_cost_matrix(half_missing):
    fit = uni_normal_fit_single_parameter(half_missing, 2, 0)
    scores = cost_matrix(half_missing, fit, np.array([1, 1]), uni_normal_model(0))
    expected = [[0.30400465, -0.05769722], [0.29758345, -0.06277712]]
    np.testing.assert_allclose(matrix(scores, 0), expected, rtol=1e-6)


@pytest.mark.parametrize("width", [2, 1])
def test_multivariate_fit(half_missing, width):
    fit = mv_normal_fit(half_missing, width)
    assert fit.mean.shape == (width, 1) and fit.cov.shape == (width, 1, 1)
    np.testing.assert_allclose(fit.mean[:, 0], [0.49645889162008944, 0.495239621185434][:width], rtol=1e-8)
    np.testing.assert_allclose(fit.cov[:, 0, 0], [0.08387139433093833, 0.08485848849960947][:width], rtol=1e-8)


@pytest.mark.parametrize("width", [2, 1])
def test_inclusion_probability(half_missing, width):
    np.testing.assert_allclose(find_prob_in_model(half_missing, width), [0.5] * width, rtol=1e-8)


def test_one_iteration(dense):
    fit, prob = mv_normal_fit(dense, 2), find_prob_in_model(dense, 2, eps=0)
    relabeled, cost = relabel_samples_one_iteration(dense, fit, prob, mv_normal_model())
    assert cost.first()["mean_cost"] == pytest.approx(0.3616456656513372)
    values = relabeled.to_array()[:, :, 0]
    assert len(values) == 10_000
    np.testing.assert_allclose(
        values[:3], [[0.5488135, 0.74826798], [0.71518937, 0.18020271], [0.60276338, 0.38902314]], rtol=1e-6)
    np.testing.assert_allclose(
        values[-3:], [[0.44645576, 0.75842952], [0.36012661, 0.02378743], [0.62588665, 0.81357508]], rtol=1e-6)


def test_iteration_on_chain_records_cost(dense):
    fit, prob = mv_normal_fit(dense, 2), find_prob_in_model(dense, 2)
    relabeled = relabel_posterior_chain_one_iteration(dense, fit, prob, mv_normal_model())
    assert set(relabeled.cost_by_width) == {2}
    assert relabeled.prob_in_model == (0.99, 0.99)
    assert dense.cost_by_width == {}


def test_cost_matrix_must_be_square(dense):
    fit, prob = mv_normal_fit(dense, 2), find_prob_in_model(dense, 2)
    wider = dense.expand_chain(3)
    with pytest.raises(ValueError, match="square"):
        cost_matrix(wider, fit, prob, mv_normal_model())
    single = cost_matrix(wider, mv_normal_fit(dense, 1), prob[:1], mv_normal_model())
    assert single.count() == 30_000
    assert single.where("slot = 2").first()["score"] == pytest.approx(np.log(0.01))

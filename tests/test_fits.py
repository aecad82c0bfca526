from dataclasses import replace

import numpy as np
import pytest

from slotalign import PosteriorChain
from slotalign.operators.assignment import log_density
from slotalign.operators.fits import (
    create_parametric_fit,
    find_prob_in_model,
    mv_normal_estimate,
    mv_normal_fit,
    uni_normal_fit_single_parameter,
    update_parametric_fit_and_prob_in_model,
)
from slotalign.operators.models import mv_normal_model


def sparse_values():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(50, 2, 2)) + [[[1.0, 20.0], [5.0, -4.0]]]
    return values


@pytest.mark.parametrize("rows, pooled", [(8, False), (7, True)])
def test_thin_slots_use_the_pool(spark, rows, pooled):
    values = sparse_values()
    values[rows:, 1] = np.nan
    chain = PosteriorChain.from_array(spark, values, 2, 2)
    mv = mv_normal_fit(chain, 2)
    flat = values.reshape(-1, 2)
    used = flat[~np.isnan(flat).any(axis=1)] if pooled else values[:rows, 1]
    assert mv.pooled == (False, pooled)
    np.testing.assert_allclose(mv.mean[1], used.mean(axis=0))
    np.testing.assert_allclose(mv.cov[1], np.cov(used.T))

    uni = uni_normal_fit_single_parameter(chain, 2, 1)
    pool = values[~np.isnan(values)]
    expected = (pool.mean(), pool.std(ddof=1)) if pooled else (values[:rows, 1, 1].mean(), values[:rows, 1, 1].std())
    np.testing.assert_allclose((uni.mean[1, 0], uni.std[1]), expected)


def test_partly_missing_entries(spark):
    values = sparse_values()
    values[:20, 0, 1] = np.nan      # present, but not complete
    values[30:, 1, 0] = np.nan      # absent by parameter 0, though parameter 1 is there
    chain = PosteriorChain.from_array(spark, values, 2, 2)
    np.testing.assert_allclose(find_prob_in_model(chain, 2), [0.99, 0.6])
    mv = mv_normal_fit(chain, 2)
    np.testing.assert_allclose(mv.mean, [values[20:, 0].mean(axis=0), values[:30, 1].mean(axis=0)])
    uni = uni_normal_fit_single_parameter(chain, 2, 1)
    np.testing.assert_allclose(uni.mean[:, 0], [values[20:, 0, 1].mean(), values[:, 1, 1].mean()])


def test_probability_docstring_case(spark):
    values = np.array([[1.0, np.nan, 2.0], [0.5, 2.1, np.nan], [np.nan, 1.8, 2.3]])
    chain = PosteriorChain.from_array(spark, values, 3, 1)
    np.testing.assert_allclose(find_prob_in_model(chain, 3), [2 / 3] * 3)


def test_narrow_deviations_far_from_zero(spark):
    rng = np.random.default_rng(0)
    values = 5e-3 + 1e-9 * rng.normal(size=(500, 1, 1))
    fit = mv_normal_fit(PosteriorChain.from_array(spark, values, 1, 1), 1)
    np.testing.assert_allclose(fit.cov[0, 0, 0], np.var(values - values.mean(), ddof=1), rtol=1e-6)
    np.testing.assert_allclose(fit.mean[0, 0], values.mean(), rtol=1e-15)


def test_constant_parameter_is_singular(spark):
    values = np.random.default_rng(1).normal(size=(20, 1, 2))
    values[:, :, 1] = 0.1
    fit = mv_normal_fit(PosteriorChain.from_array(spark, values, 1, 2), 1)
    with pytest.raises(ValueError, match="slot 0 is singular"):
        fit.whitening


def test_too_many_distributions(spark, half_missing):
    with pytest.raises(IndexError):
        mv_normal_fit(half_missing, 3)
    with pytest.raises(IndexError):
        uni_normal_fit_single_parameter(half_missing, 2, 1)


def test_fit_and_probability_together(half_missing):
    fit, prob = update_parametric_fit_and_prob_in_model(half_missing, 2, create_parametric_fit(mv_normal_estimate))
    np.testing.assert_allclose(prob, [0.5, 0.5])
    np.testing.assert_allclose(fit.mean, mv_normal_fit(half_missing, 2).mean)


def test_empty_chain(spark):
    chain = PosteriorChain.from_array(spark, np.zeros((0, 2, 1)), 2, 1)
    assert np.isnan(find_prob_in_model(chain, 2)).all()
    assert chain.shape == (0, 2, 1)


def test_density_without_sql_text(spark, half_missing):
    model = mv_normal_model()
    fit = mv_normal_fit(half_missing, 2)
    left = log_density(half_missing, fit, model).orderBy("sample_id", "label", "slot").toPandas()
    right = log_density(half_missing, fit, replace(model, column_density=None))
    right = right.orderBy("sample_id", "label", "slot").toPandas()
    keys = ["sample_id", "label", "slot"]
    assert len(left) == 80_000 and (left[keys] == right[keys]).all(axis=None)
    np.testing.assert_allclose(left["logpdf"], right["logpdf"], rtol=1e-12, atol=1e-12)
    one = log_density(half_missing, fit, model, labels=[1])
    assert one.where("label = 1").count() == one.count() == 40_000

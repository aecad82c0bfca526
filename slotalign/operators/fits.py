"""Fits per slot and inclusion probabilities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chain import PosteriorChain
from .entry_fits import EntryEstimator
from .exact import SlotSums
from .moments import Layout, SlotMoments, collect_all_values, measure_entries

# Fixed values that results depend on.
MIN_VALID = 8        # slots with fewer valid entries use the pooled fit
DEFAULT_EPS = 1e-2   # inclusion probabilities are clipped to [eps, 1-eps]


@dataclass(frozen=True)
class NormalFit:
    """Mean vectors and covariances, one per label, over the fitted parameters."""

    mean: np.ndarray
    cov: np.ndarray
    params: tuple[int, ...]
    pooled: tuple[bool, ...] = ()

    @property
    def num_labels(self) -> int:
        return len(self.mean)

    def numbers(self, label: int) -> np.ndarray:
        """What tells one label's distribution from another's."""
        return np.concatenate([self.mean[label].ravel(), self.cov[label].ravel()])

    @property
    def std(self) -> np.ndarray:
        """Standard deviations of a one-parameter fit."""
        return np.sqrt(self.cov[:, 0, 0])

    @cached_property
    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Per label the inverse Cholesky factor and half the log-determinant."""
        factors = []
        for label, cov in enumerate(self.cov):
            try:
                if not np.isfinite(cov).all():
                    raise np.linalg.LinAlgError
                factors.append(np.linalg.cholesky(cov))
            except np.linalg.LinAlgError:
                raise ValueError(f"the covariance of slot {label} is singular: {cov.tolist()}") from None
        lower = np.stack(factors)
        return np.linalg.inv(lower), np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)

    def require_regular(self) -> None:
        """Raise an error that names the slot if a covariance is singular."""
        self.whitening  # noqa: B018

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """``slot, mean, cov`` with array columns."""
        rows = [(i, m.tolist(), c.tolist()) for i, (m, c) in enumerate(zip(self.mean, self.cov))]
        return spark.createDataFrame(rows, "slot int, mean array<double>, cov array<array<double>>")


class FitInput:
    """What an estimator may use: the moments per slot, and the pools on request.

    The pools do not depend on which slot an entry is in, so one instance serves a whole loop.
    """

    def __init__(self, chain: PosteriorChain, params: list[int]):
        self.chain = chain
        self.params = tuple(params)

    @cached_property
    def all_values(self) -> tuple[int, float, float]:
        return collect_all_values(self.chain.by_param())


MomentEstimator = Callable[[SlotMoments, int, FitInput], NormalFit]
Estimator = MomentEstimator | EntryEstimator


def mv_normal_estimate(moments: SlotMoments, max_num_sources: int, given: FitInput) -> NormalFit:
    """Mean and ddof-1 covariance of the complete entries; thin slots take those of all slots."""
    mean = moments.mean[:max_num_sources].copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = moments.scatter[:max_num_sources] / (moments.valid[:max_num_sources] - 1.0)[:, None, None]
        thin = moments.valid[:max_num_sources] < MIN_VALID
        if thin.any():
            count, mean[thin], scatter = moments.pooled()
            cov[thin] = scatter / (count - 1.0)
    return NormalFit(mean, cov, given.params, tuple(bool(t) for t in thin))


def uni_normal_estimate(moments: SlotMoments, max_num_sources: int, given: FitInput) -> NormalFit:
    """Mean and ddof-0 variance of one parameter.

    Thin slots take mean and ddof-1 variance of all values of all parameters and slots.
    """
    mean = moments.mean[:max_num_sources].copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = moments.scatter[:max_num_sources] / moments.valid[:max_num_sources, None, None]
    thin = moments.valid[:max_num_sources] < MIN_VALID
    if thin.any():
        _, mean[thin], std = given.all_values
        cov[thin] = std * std
    return NormalFit(mean, cov, given.params, tuple(bool(t) for t in thin))


def check_width(chain: PosteriorChain, max_num_sources: int) -> None:
    if max_num_sources > chain.num_sources:
        raise IndexError(f"the chain has {chain.num_sources} slots, not {max_num_sources}")


def measure(chain: PosteriorChain, params: list[int], estimator: Estimator) -> Layout:
    """What ``estimator`` needs of a chain in the layout it has."""
    return measure_entries(chain.by_param([0, *params]), chain.num_sources, params,
                           estimator=estimator if isinstance(estimator, EntryEstimator) else None)


def estimate(estimator: Estimator, layout: Layout, max_num_sources: int, given: FitInput):
    """The fit of a layout; labels with few entries are fitted to those of all labels."""
    if not isinstance(estimator, EntryEstimator):
        return estimator(layout.moments, max_num_sources, given)
    states, thin = layout.states, layout.sums.valid < MIN_VALID
    if thin[:max_num_sources].any():
        # Merging may work in place, so the pool starts from an own state.
        pool = reduce(estimator.merge, states, estimator.init(len(given.params)))
        states = [pool if few else state for few, state in zip(thin, states)]
    return estimator.finish(states[:max_num_sources], given)


def clip_probability(moments: SlotMoments | SlotSums, max_num_sources: int, eps: float) -> np.ndarray:
    """Share of samples in which a slot has parameter 0, clipped to [eps, 1-eps]."""
    if moments.samples == 0:
        return np.full(max_num_sources, np.nan)
    return np.clip(moments.present[:max_num_sources] / moments.samples, eps, 1.0 - eps)


def find_prob_in_model(chain: PosteriorChain, max_num_sources: int | None = None,
                       eps: float = DEFAULT_EPS) -> np.ndarray:
    """Inclusion probability of the first ``max_num_sources`` slots."""
    width = chain.num_sources if max_num_sources is None else max_num_sources
    check_width(chain, width)
    counts = [F.count(F.get("p0", s)).alias(f"n{s}") for s in range(chain.num_sources)]
    row = chain.by_param([0]).agg(F.count("*").alias("samples"), *counts).first()
    present = np.array([row[f"n{s}"] for s in range(chain.num_sources)])
    return clip_probability(SlotSums(chain.num_sources, 1, row["samples"], present), width, eps)


def create_parametric_fit(estimator: Estimator, single_parameter: int | None = None):
    """A function ``(chain, max_num_sources) -> fit``, over all parameters or over one of them.

    An ``estimator`` is a function of the moments of the slots, or an ``EntryEstimator`` that looks at their entries.
    """

    def parametric_fit(chain: PosteriorChain, max_num_sources: int):
        check_width(chain, max_num_sources)
        params = fitted_params(chain, single_parameter)
        return estimate(estimator, measure(chain, params, estimator), max_num_sources, FitInput(chain, params))

    parametric_fit.estimator = estimator
    parametric_fit.single_parameter = single_parameter
    return parametric_fit


def fitted_params(chain: PosteriorChain, single_parameter: int | None) -> list[int]:
    if single_parameter is None:
        return list(range(chain.num_params_per_source))
    if not 0 <= single_parameter < chain.num_params_per_source:
        raise IndexError(f"no parameter {single_parameter}")
    return [single_parameter]


def mv_normal_fit(chain: PosteriorChain, max_num_sources: int) -> NormalFit:
    return create_parametric_fit(mv_normal_estimate)(chain, max_num_sources)


def uni_normal_fit_single_parameter(chain: PosteriorChain, max_num_sources: int,
                                    fit_parameter: int) -> NormalFit:
    return create_parametric_fit(uni_normal_estimate, fit_parameter)(chain, max_num_sources)


def update_parametric_fit_and_prob_in_model(chain: PosteriorChain, max_num_sources: int, parametric_fit,
                                            eps: float = DEFAULT_EPS) -> tuple[NormalFit, np.ndarray]:
    """Fit and inclusion probabilities from one pass."""
    check_width(chain, max_num_sources)
    params = fitted_params(chain, parametric_fit.single_parameter)
    layout = measure(chain, params, parametric_fit.estimator)
    fit = estimate(parametric_fit.estimator, layout, max_num_sources, FitInput(chain, params))
    return fit, clip_probability(layout.sums, max_num_sources, eps)

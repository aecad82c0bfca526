"""Label models: how slots are fitted and how an entry is scored under a label."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from ..functions.columns import LOG_TWO_PI, by_label, mv_normal_log_density, number, uni_normal_log_density
from .entry_fits import FREEDOM, LOG_CONSTANT, RobustFit, robust_density_of_block, robust_estimate
from .fits import Estimator, NormalFit, mv_normal_estimate, uni_normal_estimate
from .moments import SlotMoments

ArrayDensity = Callable[[np.ndarray, NormalFit, int], np.ndarray]
ColumnDensity = Callable[[list[str], NormalFit, str], str]
TotalScore = Callable[[NormalFit, np.ndarray, SlotMoments], float]


@dataclass(frozen=True)
class LabelModel:
    """An estimator with its log-density.

    ``estimator`` fits the moments of the slots, or is an ``EntryEstimator`` that looks at their entries.
    ``array_density`` scores a block of entries (rows of fitted parameters) under one label inside
    a task. ``column_density`` is the same as a Column and lets narrow chains stay in the JVM; a
    model without it always takes the Arrow path. ``total_score`` tells the sum of all entries' scores from the
    moments of their slots; ``quadratic`` says that the fit is a ``NormalFit`` and the density the normal one, so that
    bounds can tell which samples keep their layout. ``near_ties`` says that labels may differ in some numbers only, so that
    layouts tie but for rounding; the doubles' totals decide then.
    """

    estimator: Estimator
    array_density: ArrayDensity
    column_density: ColumnDensity | None = None
    single_parameter: int | None = None
    check: Callable[[NormalFit], object] = lambda fit: None
    total_score: TotalScore | None = None
    quadratic: bool = False
    near_ties: bool = False


def normal_density_of_block(values: np.ndarray, fit: NormalFit, label: int) -> np.ndarray:
    """Works on one row per parameter, which is how the blocks arrive."""
    whiten, half_log_det = fit.whitening
    residual = whiten[label] @ (values.T - fit.mean[label][:, None])
    distance = np.einsum("ij,ij->j", residual, residual)
    return -0.5 * (values.shape[1] * LOG_TWO_PI + distance) - half_log_det[label]


def mv_density_column(values: list[str], fit: NormalFit, label: str) -> str:
    return mv_normal_log_density(values, fit.mean, *fit.whitening, label)


def uni_density_column(values: list[str], fit: NormalFit, label: str) -> str:
    return uni_normal_log_density(values[0], fit.mean[:, 0], fit.std, label)


def normal_total_score(fit: NormalFit, log_in: np.ndarray, moments: SlotMoments) -> float:
    """Sum over all entries of ``ln p + ln density`` under their labels."""
    whiten, half_log_det = fit.whitening
    total = 0.0
    for label in np.flatnonzero(moments.valid).tolist():
        count, inverse = float(moments.valid[label]), whiten[label]
        shift = inverse @ (moments.mean[label] - fit.mean[label])
        distance = float(np.einsum("ij,jk,ik->", inverse, moments.scatter[label], inverse)) + count * float(shift @ shift)
        constant = log_in[label] - half_log_det[label] - 0.5 * len(shift) * LOG_TWO_PI
        total += count * float(constant) - 0.5 * distance
    return total


def mv_normal_model() -> LabelModel:
    return LabelModel(mv_normal_estimate, normal_density_of_block, mv_density_column,
                      check=NormalFit.require_regular, total_score=normal_total_score, quadratic=True)


def uni_normal_model(single_parameter: int) -> LabelModel:
    return LabelModel(uni_normal_estimate, normal_density_of_block, uni_density_column, single_parameter,
                      check=NormalFit.require_regular, total_score=normal_total_score, quadratic=True)


def robust_density_column(values: list[str], fit: RobustFit, label: str) -> str:
    terms = []
    for i, value in enumerate(values):
        scaled = f"(({value} - {by_label(fit.location[:, i], label)}) * {by_label(1.0 / fit.scale[:, i], label)})"
        terms.append(f"({by_label(LOG_CONSTANT - np.log(fit.scale[:, i]), label)} "
                     f"- {number((FREEDOM + 1) / 2)} * log1p({scaled} * {scaled} / {number(FREEDOM)}))")
    return f"({' + '.join(terms)})"


def robust_model() -> LabelModel:
    """Independent Student distributions around sketched medians; outliers move them little."""
    return LabelModel(robust_estimate, robust_density_of_block, robust_density_column, check=RobustFit.require_regular, near_ties=True)

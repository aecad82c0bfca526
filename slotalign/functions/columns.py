"""Column helpers over entries (arrays of parameters) and index arrays."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_TWO_PI = math.log(2.0 * math.pi)


def null_entry(num_params: int) -> Column:
    """An absent source: every parameter NULL."""
    return F.array(*[F.lit(None).cast("double")] * num_params)


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)


def number(value: float) -> str:
    """A double literal in SQL text."""
    value = float(value)
    if math.isfinite(value):
        return f"{value!r}D"
    return f"double('{value}')"


def number_array(values: Iterable[float]) -> str:
    return f"array({', '.join(number(v) for v in values)})"


def all_present(values: Sequence[str]) -> str:
    """True when none of ``values`` is missing."""
    return "(" + " AND ".join(f"{value} IS NOT NULL" for value in values) + ")"


def by_label(values: Iterable[float], label: str) -> str:
    """The value of a label; one lookup for any number of labels, a literal for a constant label."""
    return f"get({number_array(values)}, {label})"


def uni_normal_log_density(value: str, mean: np.ndarray, std: np.ndarray, label: str = "label") -> str:
    """Log-density of the normal distribution of ``label`` as SQL text; NULL for a missing value."""
    mean, std = np.atleast_1d(mean), np.atleast_1d(std)
    if not (std > 0).all():
        raise ValueError(f"standard deviations must be positive, got {std}")
    scaled = f"(({value} - {by_label(mean, label)}) * {by_label(1.0 / std, label)})"
    return f"({by_label(-0.5 * LOG_TWO_PI - np.log(std), label)} - 0.5D * {scaled} * {scaled})"


def mv_normal_log_density(values: Sequence[str], mean: np.ndarray, whiten: np.ndarray, half_log_det: np.ndarray,
                          label: str = "label") -> str:
    """Log-density of the multivariate normal distribution of ``label`` as SQL text.

    ``whiten`` holds the inverse Cholesky factors, so a row only pays for the whitened residuals. NULL
    when any value is missing.
    """
    constant = -0.5 * len(values) * LOG_TWO_PI - half_log_det
    centred = [f"({value} - {by_label(mean[:, i], label)})" for i, value in enumerate(values)]
    residuals = ["(" + " + ".join(f"{centred[col]} * {by_label(whiten[:, row, col], label)}"
                                  for col in range(row + 1)) + ")"
                 for row in range(len(values))]
    distance = " + ".join(f"{r} * {r}" for r in residuals)
    return f"({by_label(constant, label)} - 0.5D * ({distance}))"


def fill_missing_indices(total: Column | int, given: Column) -> Column:
    """``given`` followed by the other indices below ``total`` in ascending order."""
    total = F.lit(total) if isinstance(total, int) else total
    everything = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(given, F.array_except(everything, given))


def count_swaps(values: Column) -> Column:
    """Half the number of positions that differ from the sorted array, rounded down."""
    moved = F.zip_with(values, F.array_sort(values), lambda a, b: F.when(a != b, 1).otherwise(0))
    return F.floor(F.aggregate(moved, F.lit(0), lambda total, one: total + one) / 2).cast("int")


def file_number(name: Column) -> Column:
    """The integer after the last dot of a file name."""
    return F.element_at(F.split(name, r"\."), -1).cast("int")


def sort_by_number(files: DataFrame, name: str) -> DataFrame:
    """File names in the order of the integer after their last dot."""
    return files.orderBy(file_number(F.col(name)))


def with_log_floor(prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ln p`` and ``ln(1-p)`` with the infinite limits at 0 and 1 and no warnings."""
    prob = np.asarray(prob, dtype=float)
    with np.errstate(divide="ignore"):
        return np.log(prob), np.log1p(-prob)

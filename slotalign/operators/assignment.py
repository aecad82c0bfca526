"""Scores of entries under labels, and the best assignment per sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..chain import PosteriorChain
from ..functions.columns import all_present, number_array, with_log_floor
from .bounds import Coordinates, gaps_and_prices, layout_gaps, slacks
from .entry_fits import natural_log
from .exact import SlotSums
from .fits import NormalFit
from .matching import MAX_SETS, NEAR_TIE, best_labels, fill_free_labels, greatest_totals, settle_ties
from .models import LabelModel
from .moments import (
    CHUNK_SAMPLES,
    PACKED_SAMPLES,
    WRITTEN,
    Layout,
    WrittenBlock,
    add_moves,
    collect_states,
    may_move,
    samples_of,
    state_of,
    written_blocks,
)

# Scores (samples x entries x labels) that a task holds at a time.
MAX_BLOCK_CELLS = 2_000_000

ASSIGNMENT_TYPE = "struct<labels:array<int>,scores:array<double>>"


def log_density(chain: PosteriorChain, fit: NormalFit, model: LabelModel,
                labels: list[int] | None = None) -> DataFrame:
    """``sample_id, label, slot, logpdf`` for the requested labels; NULL for missing entries."""
    labels = list(range(fit.num_labels)) if labels is None else labels
    model.check(fit)
    entries = chain.long_columns()
    if model.column_density is None:
        scored = entries.withColumn("_logpdf", _block_density(fit, model, labels))
        numbers = ", ".join(str(label) for label in labels)
        paired = f"arrays_zip(array({numbers}), _logpdf)"
        return scored.selectExpr("sample_id", "slot", f"inline_outer({paired}) AS (label, logpdf)").select(
            "sample_id", "label", "slot", "logpdf")
    values = [f"p{p}" for p in fit.params]
    pairs = entries.selectExpr("sample_id", "slot", *values,
                               f"explode(array({', '.join(str(label) for label in labels)})) AS label")
    density = f"CASE WHEN {all_present(values)} THEN {model.column_density(values, fit, 'label')} END"
    return pairs.selectExpr("sample_id", "label", "slot", f"{density} AS logpdf")


def _block_density(fit: NormalFit, model: LabelModel, labels: list[int]) -> Column:
    density = model.array_density

    @F.arrow_udf("array<double>")
    def densities(*params: pa.Array) -> pa.Array:
        block = np.stack([p.to_numpy(zero_copy_only=False) for p in params]).T
        scored = np.stack([density(block, fit, label) for label in labels], axis=1)
        return _rows_of(scored, np.isnan(scored))

    return densities.asNondeterministic()(*[f"p{p}" for p in fit.params])


def cost_matrix(chain: PosteriorChain, fit: NormalFit, prob_in_model: np.ndarray, model: LabelModel,
                num_distributions: int | None = None) -> DataFrame:
    """``sample_id, label, slot, score``: ``ln p[label] + logpdf``, or ``ln(1-p[slot])`` if missing.

    The filling for a missing entry goes by the slot of the entry, not by the label.
    """
    width = fit.num_labels if num_distributions is None else num_distributions
    if width not in (1, chain.num_sources):
        raise ValueError("the cost matrix must be square, or have one distribution")
    log_in, log_out = with_log_floor(np.asarray(prob_in_model)[:width])
    scored = log_density(chain, fit, model, list(range(width)))
    absent = f"get({number_array(log_out)}, {'slot' if width > 1 else 0})"
    return scored.selectExpr("sample_id", "label", "slot",
                             f"coalesce(get({number_array(log_in)}, label) + logpdf, {absent}) AS score")


def create_compute_cost_matrix(model: LabelModel):
    """A function ``(chain, fit, prob_in_model, num_distributions) -> scores`` for one model."""

    def compute_cost_matrix(chain: PosteriorChain, fit: NormalFit, prob_in_model: np.ndarray,
                            num_distributions: int | None = None) -> DataFrame:
        return cost_matrix(chain, fit, prob_in_model, model, num_distributions)

    return compute_cost_matrix


def assign(chain: PosteriorChain, fit: NormalFit, prob_in_model: np.ndarray,
           model: LabelModel) -> DataFrame:
    """The chain by parameter with ``labels`` and ``scores``: the best label of every entry, its score.

    Scores of missing entries are NULL; the entries are in the order they have in the chain. One solver
    serves all widths, so ties have one rule: of equal totals that come from equal fits or equal entries,
    lower slots get lower labels, and a lone entry the lowest of equal labels. Models with ``near_ties`` compare totals
    as doubles add up (``greatest_totals``) where layouts of up to ``MAX_SETS`` slots tie but for rounding.
    """
    frame = chain.by_param()
    match = block_matcher(chain.num_sources, fit, prob_in_model, model)
    return _matched(frame, fit, match, chain.num_sources).selectExpr(
        *frame.columns, "_best.labels AS labels", "_best.scores AS scores")


def assign_with_slack(blocks: DataFrame, num_sources: int, fit: NormalFit, prob_in_model: np.ndarray, model: LabelModel,
                      coordinates: Coordinates) -> DataFrame:
    """Packed blocks with the ``labels``, their ``prices`` and the ``slack`` of every sample, by which they are ordered; ``low`` is a block's least."""
    match = block_matcher(num_sources, fit, prob_in_model, model, coordinates, priced=True)
    names = [f"p{p}" for p in sorted({0, *fit.params})]
    needs = [names.index(f"p{p}") for p in fit.params]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for samples, cube, _, _ in samples_of(batches, names, num_sources, size=4 * CHUNK_SAMPLES):
            labels, _, slack, prices = match(cube[needs])
            order = np.argsort(slack, kind="stable")
            parts = [order[at:at + PACKED_SAMPLES] for at in range(0, len(order), PACKED_SAMPLES)]
            made = [WrittenBlock.of(samples[o], cube[:, o], labels[o], slack[o], prices[o]).row(names) for o in parts]
            yield pa.RecordBatch.from_pylist(made, _written_schema(names))

    return blocks.select("ids", *names).mapInArrow(run, _written_type(names))


def renewed(written: DataFrame, num_sources: int, fit: NormalFit, prob_in_model: np.ndarray, model: LabelModel,
            coordinates: Coordinates, swing: float, keeps) -> DataFrame:
    """A written layout under a later fit, ``swing`` away: what may have moved is matched again, the others keep their prices.

    A last row of every task has no samples but the ``state`` of what the moves change, see ``changes``.
    """
    match = block_matcher(num_sources, fit, prob_in_model, model, coordinates, priced=True)
    names = [f"p{p}" for p in sorted({0, *fit.params})]
    needs = [names.index(f"p{p}") for p in fit.params]
    chosen = may_move(swing, keeps, needs)

    schema = _written_schema(names).append(pa.field("state", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = SlotSums(num_sources, len(needs))
        for batch in batches:
            for block in written_blocks(batch, names, num_sources):
                rows = chosen(block)
                labels, prices, slack = block.labels.copy(), block.prices.copy(), block.slack - swing
                if rows.any():
                    cube = block.dense(rows)
                    labels[rows], _, slack[rows], found = match(cube[needs])
                    prices[:, rows] = found.T
                    add_moves(sums, None, None, block.samples[rows], cube[needs], ~np.isnan(cube[0]), block.labels[rows], labels[rows])
                    sums.read += len(cube[0])
                made = replace(block, labels=labels, prices=prices, slack=slack).row(names)
                yield pa.RecordBatch.from_pylist([made], schema)
        none = {name: b"" for name in ("ids", *names, *WRITTEN)}
        yield pa.RecordBatch.from_pylist([none | {"low": np.inf, "state": state_of(sums)}], schema)

    return written.select("ids", *names, *WRITTEN).mapInArrow(run, _written_type(names) + ", state binary")


def changes(written: DataFrame, tasks: int, num_sources: int, num_params: int) -> Layout:
    """What a ``renewed`` layout, staged, adds to the sums of the one before."""
    rows = written.where("state IS NOT NULL").select(F.spark_partition_id().cast("long").alias("task"), "state")
    return collect_states(rows, tasks, num_sources, num_params)


def _written_schema(names: list[str]) -> pa.Schema:
    return pa.schema([*[pa.field(n, pa.binary()) for n in ("ids", *names, *WRITTEN)], pa.field("low", pa.float64())])


def _written_type(names: list[str]) -> str:
    return ", ".join(f"{n} binary" for n in ("ids", *names, *WRITTEN)) + ", low double"


def block_matcher(num_sources: int, fit: NormalFit, prob_in_model: np.ndarray, model: LabelModel,
                  coordinates: Coordinates | None = None, priced: bool = False):
    """A function from the fitted parameters of many samples (parameters, samples, slots) to labels, scores and slacks.

    Slacks are None without ``coordinates``; with ``priced`` the labels' prices follow.
    """
    if fit.num_labels != num_sources or len(prob_in_model) != num_sources:
        raise ValueError("the fit must have one label per slot; expand the chain first")
    model.check(fit)
    compared = model.near_ties and num_sources <= MAX_SETS
    log_in = natural_log(prob_in_model) if compared else with_log_floor(prob_in_model)[0]
    density = model.array_density
    # Labels with the same fit are interchangeable; a fit may hold more than it names as its numbers in a subclass.
    alike: dict[bytes, list[int]] = {}
    for label in range(num_sources if "numbers" in vars(type(fit)) else 0):
        numbers = np.concatenate([[log_in[label]], fit.numbers(label)]) + 0.0
        alike.setdefault(numbers.tobytes(), []).append(label)
    tied = [pair for group in alike.values() for pair in combinations(group, 2)]
    rows = max(1, MAX_BLOCK_CELLS // num_sources**2)

    def match_block(cube: np.ndarray) -> tuple[np.ndarray, ...]:
        valid = ~np.isnan(cube).any(axis=0)
        score = np.full(valid.shape + (num_sources,), np.nan)
        entries = cube[:, valid].T
        score[valid] = np.stack([density(entries, fit, label) + log_in[label] for label in range(num_sources)], axis=1)
        labels = best_labels(score, valid)
        settle_ties(labels, np.moveaxis(cube, 0, 2), tied)
        if compared and entries.size:
            reach = NEAR_TIE * max(1.0, float(np.abs(score[valid][np.isfinite(score[valid])]).max(initial=0.0)))
            near = np.flatnonzero(layout_gaps(score, fill_free_labels(labels), valid) <= reach)
            labels[near] = greatest_totals(score[near], valid[near])
        own = np.where(valid, np.take_along_axis(score, np.maximum(labels, 0)[:, :, None], axis=2)[:, :, 0], np.nan)
        filled = fill_free_labels(labels)
        if coordinates is None:
            return filled, own
        lengths = np.zeros(valid.shape)
        lengths[valid] = coordinates.lengths(entries)
        gaps, prices = gaps_and_prices(score, filled, valid)
        return filled, own, slacks(gaps, valid, lengths, coordinates.weights), prices

    def match(cube: np.ndarray) -> tuple[np.ndarray | None, ...]:
        blocks = [match_block(cube[:, at:at + rows]) for at in range(0, max(cube.shape[1], 1), rows)]
        parts = [np.concatenate(part) for part in zip(*blocks)]
        return (*parts[:3 + priced], *[None] * (coordinates is None))

    return match


def _matched(frame: DataFrame, fit: NormalFit, match, num_sources: int) -> DataFrame:
    """``frame`` with ``_best``: Arrow blocks of samples scored and matched with NumPy."""

    @F.arrow_udf(ASSIGNMENT_TYPE)
    def best(*params: pa.Array) -> pa.Array:
        cube = np.stack([p.flatten().to_numpy(zero_copy_only=False) for p in params])
        labels, own, _ = match(cube.reshape(len(params), -1, num_sources))
        return pa.StructArray.from_arrays([_rows_of(labels.astype("int32")), _rows_of(own, np.isnan(own))], ["labels", "scores"])

    # Nondeterministic to the optimizer only: a filter on the result must not run the matching twice.
    return frame.withColumn("_best", best.asNondeterministic()(*[f"p{p}" for p in fit.params]))


def _rows_of(block: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    flat = pa.array(block.ravel(), mask=None if missing is None else missing.ravel())
    offsets = pa.array(np.arange(len(block) + 1, dtype="int32") * block.shape[1])
    return pa.ListArray.from_arrays(offsets, flat)

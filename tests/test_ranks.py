"""Row numbers from bitmaps of ids, without moving the rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotalign import PosteriorChain, storage
from slotalign.storage import number_ids


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def ranks_of(frame):
    return {r.own: r.sample_id for r in frame.collect()}


@settings(max_examples=12, deadline=None)
@given(st.sets(st.integers(-70_000, 70_000) | st.sampled_from([-2**63, 2**63 - 1, 0, 32767, 32768, -32768, -32769]), min_size=1, max_size=300))
def test_ranks_of_any_ids(spark, ids):
    frame = spark.createDataFrame([(i, i) for i in ids], "sample_id long, own long")
    wanted = {i: rank for rank, i in enumerate(sorted(ids))}
    least, storage.MIN_IDS_PER_BITMAP = storage.MIN_IDS_PER_BITMAP, 0
    try:
        assert ranks_of(number_ids(frame)) == wanted
    finally:
        storage.MIN_IDS_PER_BITMAP = least
    assert ranks_of(number_ids(frame)) == wanted


@pytest.mark.parametrize("limit", [128_000_000, 0])
def test_dense_ids_do_not_move_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(storage, "MAX_BROADCAST_BYTES", limit)
    frame = spark.range(0, 200_000, 3, 5).select(F.col("id").alias("sample_id"), F.col("id").alias("own"))
    numbered = number_ids(frame)
    if limit:
        assert "BroadcastHashJoin" in plan_of(numbered) and "Exchange hashpartitioning" not in plan_of(numbered)
    assert numbered.where("sample_id != own / 3").count() == 0 and numbered.count() == 66_667


def test_repeated_null_and_scattered_ids_are_sorted(spark):
    rows = [(5, 0), (5, 1), (None, 2), (9, 3)]
    numbered = number_ids(spark.createDataFrame(rows, "sample_id long, own int"))
    assert sorted(r.sample_id for r in numbered.collect()) == [0, 1, 2, 3]
    scattered = spark.range(2000).select((F.col("id") * 10**12).alias("sample_id"), F.col("id").alias("own"))
    assert ranks_of(number_ids(scattered)) == {i: i for i in range(2000)}
    assert number_ids(spark.createDataFrame([], "sample_id long, own int")).count() == 0


def test_burn_and_thin_of_grouped_rows(spark, monkeypatch):
    """The ids come from the rows before they are grouped; nothing is written but bitmaps."""
    monkeypatch.setattr("slotalign.storage.number_rows", None)
    rows = spark.range(0, 40_000, 1, 6).select((F.col("id") / 4).cast("long").alias("s"), (F.col("id") % 2).alias("slot"), F.lit(1.0).alias("v"))
    rows = rows.where("s % 5 != 2")
    chain = PosteriorChain.from_long(rows, F.col("s"), F.col("slot"), [F.col("v")], 2, F.sum)
    kept = [i for i in range(10_000) if i % 5 != 2]
    for made in (chain, chain.expand_chain(3), chain.randomize_entries(1), chain.staged()):
        found = made.get_chain(burn=10, thin=7)
        assert found.dense_ids and sorted(r.sample_id for r in found.frame.collect()) == list(range(len(kept[10::7])))
    filtered = chain.with_frame(chain.frame.where("sample_id >= 100"))
    assert filtered.with_dense_ids().frame.count() == len([i for i in kept if i >= 100])
    assert np.array_equal(np.sort([r.sample_id for r in filtered.with_dense_ids().frame.collect()]), np.arange(len([i for i in kept if i >= 100])))

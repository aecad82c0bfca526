"""Samples of several lines, put together in the splits that hold them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotalign.sources.text import load_samples_by_dimension, put_together
from slotalign.sources import text


@pytest.fixture(params=[60, 1 << 27])
def small_splits(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": 1}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, str(v))
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def write_folder(path, counts, width, rng):
    """``counts``: samples per number of sources. Returns the samples in the order of the stack."""
    stack = []
    for sources, samples in sorted(counts.items()):
        lines = []
        for _ in range(samples):
            rows = np.round(rng.normal(size=(sources, width)), 4)
            stack.append(rows)
            lines += [" ".join(map(str, row)) for row in rows]
        for at in range(3, len(lines), 11):
            lines[at] += " # a comment"
        lines[5:5] = ["", "# only a comment"]
        (path / f"dimension_chain.dat.{sources}").write_text("\n".join(lines) + "\n")
    return stack


@pytest.mark.parametrize("burn, thin", [(0, 1), (4, 3)])
def test_any_splits_give_the_same_chain(spark, tmp_path, small_splits, burn, thin, monkeypatch):
    stack = write_folder(tmp_path, {1: 40, 2: 30, 7: 25, 12: 9}, 3, np.random.default_rng(small_splits))
    seen = {}
    original = text.join_pieces

    def record(pieces, *rest):
        seen["cut"] = pieces.where("NOT whole").count()
        seen["all"] = pieces.count()
        made = original(pieces, *rest)
        seen["plan"] = made.frame._jdf.queryExecution().executedPlan().toString()
        return made

    monkeypatch.setattr(text, "join_pieces", record)
    chain = load_samples_by_dimension(spark, str(tmp_path), burn=burn, thin=thin, num_params_per_source=3)
    kept = stack[burn::thin]
    found = {r.sample_id: r.entries for r in chain.frame.collect()}
    assert sorted(found) == list(range(len(kept))) and chain.num_sources == 12
    for i, rows in enumerate(kept):
        assert np.array_equal(np.array(found[i][:len(rows)], float), rows)
        assert all(v is None for entry in found[i][len(rows):] for v in entry)
    splits = spark.read.text(f"{tmp_path}/*").select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert seen["cut"] <= 2 * splits and (seen["cut"] > 0 or small_splits > 1000)
    # The filter that keeps the cut samples reaches the scan; only they are shuffled.
    assert seen["plan"].count("Exchange") == 1 and "EqualTo(whole,false)" in seen["plan"].replace("Not(EqualTo(whole,true))", "EqualTo(whole,false)")


def test_batches_may_end_anywhere():
    sources = np.repeat([2, 3], [4, 6])
    samples, slots = np.array([0, 0, 1, 1, 2, 2, 2, 3, 3, 3]), np.array([0, 1, 0, 1, 0, 1, 2, 0, 1, 2])
    values = pa.array([[float(i)] for i in range(10)])
    for size in (1, 2, 3, 7, 10):
        held, rows = [], []
        for at in range(0, 10, size):
            part = slice(at, min(at + size, 10))
            held.append((sources[part], samples[part], slots[part], values[part.start:part.stop]))
            made, rest = put_together(held, part.stop == 10)
            held = [rest] if rest else []
            rows += made.to_pylist()
        assert [(r["sample_id"], r["slot"], r["whole"], len(r["rows"])) for r in rows] == [(0, 0, True, 2), (1, 0, True, 2), (2, 0, True, 3), (3, 0, True, 3)]
        assert [v for r in rows for v in r["rows"]] == values.to_pylist()


def test_lines_of_other_widths_are_refused(spark, tmp_path):
    (tmp_path / "dimension_chain.dat.2").write_text("1 2\n3 4\n5 6 7\n8 9\n")
    with pytest.raises(ValueError, match="one width"):
        load_samples_by_dimension(spark, str(tmp_path), num_params_per_source=2)
    assert spark.range(1).select(F.lit(1)).count() == 1

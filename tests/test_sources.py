from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from slotalign import PosteriorChain, load_samples
from slotalign.sources.text import (
    load_samples_by_dimension,
    load_samples_fixed_num_sources,
    load_samples_product_space,
)


@pytest.fixture
def small_splits(spark):
    """Many splits per file, so that the order of samples has to survive them."""
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def product_space_rows(rng, samples, sources, params):
    rows = rng.normal(size=(samples, sources * params + 5))
    active = rng.integers(1, sources + 1, samples)
    rows[:, -5] = active - 1.0
    expected = np.full((samples, active.max() * params), np.nan)
    for row, count, out in zip(rows, active, expected):
        out[:count * params] = row[:count * params]
    return rows, expected.reshape(samples, -1, params)


def test_fixed_layout(spark, tmp_path, small_splits):
    rows = np.random.default_rng(0).normal(size=(700, 2 * 3 + 4))
    path = f"{tmp_path}/chain.dat"
    np.savetxt(path, rows)
    expected = rows[:, :-4].reshape(-1, 2, 3)
    chain = load_samples(spark, path, 3, burn=11, thin=3)
    np.testing.assert_array_equal(chain.to_array(), expected[11::3])
    assert not chain.trans_dimensional
    np.testing.assert_array_equal(load_samples_fixed_num_sources(spark, path, 3).to_array(), expected)
    with pytest.raises(ValueError, match="do not hold sources"):
        load_samples_fixed_num_sources(spark, path, 4)


def test_product_space_layout(spark, tmp_path, small_splits):
    rows, expected = product_space_rows(np.random.default_rng(1), 400, 3, 2)
    path = f"{tmp_path}/space.dat"
    np.savetxt(path, rows)
    chain = load_samples(spark, path, 2, burn=5, thin=2)     # neither applies to this layout
    np.testing.assert_array_equal(chain.to_array(), expected)
    assert chain.trans_dimensional
    filled = load_samples_product_space(spark, path, 2, fill_value=-1.0).to_array()
    np.testing.assert_array_equal(filled, np.nan_to_num(expected, nan=-1.0))


def test_source_counts_round_half_to_even(spark, tmp_path):
    counts = [-0.5, 0.5, 1.5, 1.2]                           # plus one: 0.5, 1.5, 2.5, 2.2
    path = f"{tmp_path}/half.dat"
    np.savetxt(path, [[1, 2, 3, c, 0, 0, 0, 0] for c in counts])
    present = ~np.isnan(load_samples_product_space(spark, path, 1).to_array()[:, :, 0])
    assert present.sum(axis=1).tolist() == [0, 2, 2, 2]


def test_dimension_folder(spark, tmp_path, small_splits):
    rng = np.random.default_rng(2)
    stacks = []
    for sources, samples in ((0, 5), (1, 9), (2, 8), (10, 30)):
        rows = rng.normal(size=(samples * max(sources, 1), 8))
        np.savetxt(tmp_path / f"dimension_chain.dat.{sources}", rows)
        if sources:
            stack = np.full((samples, 10, 8), np.nan)
            stack[:, :sources] = rows.reshape(samples, sources, 8)
            stacks.append(stack)
    whole = np.concatenate(stacks)
    chain = load_samples(spark, str(tmp_path), num_params_per_source=3)
    np.testing.assert_array_equal(chain.to_array(), whole)
    assert chain.trans_dimensional and chain.num_params_per_source == 8
    thinned = load_samples(spark, str(tmp_path), 3, burn=7, thin=4)     # burn reaches into the second file
    np.testing.assert_array_equal(thinned.to_array(), whole[7::4])
    many = load_samples(spark, str(tmp_path), 3, remove_low_numbers=True)
    np.testing.assert_array_equal(many.to_array(), np.concatenate([stacks[0], stacks[2]]))
    padded = load_samples_by_dimension(spark, str(tmp_path), fill_value=0.0).to_array()
    np.testing.assert_array_equal(padded, np.nan_to_num(whole))


def test_dimension_folder_errors(spark, tmp_path):
    np.savetxt(tmp_path / "dimension_chain.dat.2", np.zeros((6, 8)))
    with pytest.raises(ValueError, match="more than 8 samples"):
        load_samples(spark, str(tmp_path), 8, remove_low_numbers=True)
    np.savetxt(tmp_path / "dimension_chain.dat.3", np.zeros((7, 8)))
    with pytest.raises(ValueError, match="ends inside a sample"):
        load_samples(spark, str(tmp_path), 8)


def test_text_details(spark, tmp_path):
    path = tmp_path / "chain.dat"
    path.write_text("# header\n 1.5\tnan 3 0 0 0 0 0 # tail\n\n-1e-3 +inf 7 1 1 1 1 1\r\n")
    chain = load_samples_fixed_num_sources(spark, str(path), 2)
    np.testing.assert_array_equal(chain.to_array(), [[[1.5, np.nan], [3, 0]], [[-1e-3, np.inf], [7, 1]]])


def test_one_parameter_reads_as_product_space(spark, tmp_path):
    path = f"{tmp_path}/p1.dat"
    np.savetxt(path, [[5.0, 0.0, 0, 0, 0, 0]] * 2)
    assert load_samples(spark, path, 1).trans_dimensional
    np.savetxt(f"{tmp_path}/p5.dat", [[5.0, 0, 0, 0, 0]] * 2)
    assert not load_samples(spark, f"{tmp_path}/p5.dat", 1).trans_dimensional


def test_unknown_and_ragged_layouts(spark, tmp_path):
    np.savetxt(tmp_path / "odd.dat", np.zeros((3, 10)))
    with pytest.raises(ValueError, match="fit neither text layout"):
        load_samples(spark, f"{tmp_path}/odd.dat", 7)
    (tmp_path / "ragged.dat").write_text("1 2 0 0 0 0\n1 2 3 0 0 0 0\n")
    with pytest.raises(ValueError, match="one width"):
        load_samples_fixed_num_sources(spark, f"{tmp_path}/ragged.dat", 1)


@pytest.fixture
def cube():
    values = np.random.default_rng(3).normal(size=(500, 2, 3))
    values[::3, 1] = np.nan
    return values


def test_feather_parts(spark, tmp_path, cube):
    chain = PosteriorChain.from_array(spark, cube, 2, 3, trans_dimensional=True)
    path = f"{tmp_path}/feather"
    chain.with_frame(chain.frame.repartition(5)).to_feather(path)
    back = PosteriorChain.read_feather(spark, path)
    np.testing.assert_array_equal(back.to_array(), cube)
    assert back.trans_dimensional and (back.num_sources, back.num_params_per_source) == (2, 3)
    parts = sorted((tmp_path / "feather").iterdir())
    wide = pd.concat([pd.read_feather(part) for part in parts])
    assert list(wide.columns) == [*"012345", "num_sources", "num_params_per_source", "transdimensional"]
    np.testing.assert_array_equal(wide.iloc[:, :6].to_numpy().reshape(-1, 2, 3), cube)
    with pytest.raises(Exception, match="already exists"):
        chain.to_feather(path)


def test_feather_file_of_many_batches(spark, tmp_path, cube):
    wide = pd.DataFrame(cube.reshape(-1, 6), columns=list("012345"))
    wide = wide.assign(num_sources=2, num_params_per_source=3, transdimensional=0)
    wide.to_feather(tmp_path / "one.feather", chunksize=64)
    chain = PosteriorChain.read_feather(spark, f"{tmp_path}/one.feather")
    np.testing.assert_array_equal(chain.to_array(), cube)
    np.testing.assert_array_equal(chain.get_chain(100, 7).to_array(), cube[100::7])
    assert not chain.trans_dimensional


def test_empty_feather_file(spark, tmp_path):
    pd.DataFrame({"0": [], "num_sources": [], "num_params_per_source": [], "transdimensional": []}).to_feather(
        tmp_path / "empty.feather")
    with pytest.raises(ValueError, match="no samples"):
        PosteriorChain.read_feather(spark, f"{tmp_path}/empty.feather")


def test_parquet(spark, tmp_path, cube):
    PosteriorChain.from_array(spark, cube, 2, 3, trans_dimensional=True).to_parquet(f"{tmp_path}/chain")
    back = PosteriorChain.read_parquet(spark, f"{tmp_path}/chain")
    np.testing.assert_array_equal(back.to_array(), cube)
    assert back.trans_dimensional and (back.num_sources, back.num_params_per_source) == (2, 3)


@pytest.mark.parametrize("name", ["dimension_chain.dat.2.txt", "dimension_chain.dat.bak"])
def test_dimension_files_without_a_number_raise(spark, tmp_path, name):
    for file in ("dimension_chain.dat.1", name):
        np.savetxt(tmp_path / file, np.ones((9, 8)))
    with pytest.raises(Exception, match="no source count at the end of the name"):
        load_samples(spark, str(tmp_path), 8)


def test_dropped_dimension_files_are_not_checked(spark, tmp_path):
    np.savetxt(tmp_path / "dimension_chain.dat.1", np.ones((9, 8)))
    np.savetxt(tmp_path / "dimension_chain.dat.2", np.ones((5, 3)))
    (tmp_path / "dimension_chain.dat.0").write_text("not a number\n")
    assert load_samples(spark, str(tmp_path), 8, remove_low_numbers=True).shape == (9, 1, 8)
    with pytest.raises(ValueError, match="ends inside a sample: 5 lines"):
        load_samples(spark, str(tmp_path), 8)


@pytest.mark.parametrize("count", [2.0, -2.0])
def test_product_space_counts_must_fit_the_row(spark, tmp_path, count):
    np.savetxt(tmp_path / "space.dat", [[1, 2, 3, 4, count, 0, 0, 0, 0]])
    with pytest.raises(Exception, match="9 columns does not hold"):
        load_samples_product_space(spark, f"{tmp_path}/space.dat", 2).to_array()


def feather_file(path, values, sources, params):
    columns = {str(i): values[:, i] for i in range(values.shape[1])}
    shape = {"num_sources": sources, "num_params_per_source": params, "transdimensional": 1}
    pd.DataFrame(columns | {k: np.full(len(values), v) for k, v in shape.items()}).to_feather(path)


def test_all_feather_files_of_a_folder_are_read(spark, tmp_path):
    values = np.arange(54.0).reshape(9, 6)
    for i, name in enumerate(("a.feather", "b", "part-0.feather")):
        feather_file(tmp_path / name, values[3 * i:3 * i + 3], 2, 3)
    (tmp_path / "_done").write_text("")
    np.testing.assert_array_equal(PosteriorChain.read_feather(spark, str(tmp_path)).to_array(), values.reshape(9, 2, 3))
    feather_file(tmp_path / "c.feather", values[:3], 3, 2)
    with pytest.raises(ValueError, match="different shapes"):
        PosteriorChain.read_feather(spark, str(tmp_path))


def test_bare_paths_belong_to_the_default_file_system(spark, tmp_path):
    from slotalign.sources.feather import qualified

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == qualified(spark, f"file:{tmp_path}")
    with pytest.raises(ValueError, match="disk of each machine"):
        qualified(SimpleNamespace(sparkContext=SimpleNamespace(
            _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc, master="yarn")), str(tmp_path))


def test_feather_opens_only_what_is_needed(spark, tmp_path, monkeypatch):
    """Cells that no job asks for cannot be read here, nor can the first record batch."""
    import pyarrow as pa

    from slotalign.operators.fits import find_prob_in_model, uni_normal_fit_single_parameter

    rng = np.random.default_rng(5)
    values = rng.normal(size=(90, 6))
    values[::4, 4] = np.nan
    columns = {str(i): pa.array(values[:, i]) for i in range(6)}
    columns["3"] = pa.array(["not a number"] * 90)
    shape = {"num_sources": 3, "num_params_per_source": 2, "transdimensional": 1}
    table = pa.table(columns | {k: pa.array([v] * 90) for k, v in shape.items()})
    path = str(tmp_path / "chain.feather")
    with pa.ipc.new_file(path, table.schema) as sink:
        sink.write_table(table, max_chunksize=30)
    chain = PosteriorChain.read_feather(spark, path)
    found = [r.value for r in chain.values(slot=2, param=0).orderBy("sample_id").collect()]
    assert [v is None for v in found] == np.isnan(values[:, 4]).tolist()
    assert [v for v in found if v is not None] == values[~np.isnan(values[:, 4]), 4].tolist()
    np.testing.assert_allclose(find_prob_in_model(chain), [0.99, 0.99, np.mean(~np.isnan(values[:, 4]))])
    fit = uni_normal_fit_single_parameter(chain, 3, 0)
    np.testing.assert_allclose(fit.mean[:, 0], np.nanmean(values[:, ::2], axis=0))
    with pytest.raises(Exception, match="could not convert"):
        chain.frame.collect()

    columns["3"] = pa.array(["x"] * 60 + ["1.5"] * 30)
    table = pa.table(columns | {k: pa.array([v] * 90) for k, v in shape.items()})
    with pa.ipc.new_file(path, table.schema) as sink:
        sink.write_table(table, max_chunksize=30)
    late = PosteriorChain.read_feather(spark, path).get_chain(burn=65, thin=2)
    rows = late.frame.orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == list(range(13))
    assert [r.entries[0][0] for r in rows] == values[65::2, 0].tolist() and all(r.entries[1][1] == 1.5 for r in rows)


def test_scratch_folders_are_known_to_be_shared(spark):
    """On a cluster a bare path on disk is refused, but not one in the shared folder."""
    from slotalign.plans.queries import scratch
    from slotalign.sources.feather import qualified

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(
        _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc, master="spark://host:7077"))
    path = scratch(spark, "feather")
    assert qualified(cluster, path).startswith("file:///")


def test_comments_reach_to_the_end_of_the_line(spark, tmp_path):
    """Also behind a character that regular expressions take for a line's end; tabs part numbers."""
    (tmp_path / "space.dat").write_text("1\t2 3 4 0 0 0 0 0 # first second\n# none  here\n5 6 7 8 1 0 0 0 0\n", encoding="utf-8")
    chain = load_samples_product_space(spark, f"{tmp_path}/space.dat", 2)
    np.testing.assert_array_equal(chain.to_array(), [[[1, 2], [np.nan, np.nan]], [[5, 6], [7, 8]]])


def test_dimension_files_are_written_from_their_own_rows(spark):
    """The table of all widths is sorted by width, and no width is written twice."""
    from pyspark.sql import functions as F

    from slotalign.plans import queries

    rows = spark.range(300).select(F.expr("id div 3").alias("sample_id"), (F.col("id") % 3 + 1).cast("int").alias("sources"),
                                   F.lit(0).alias("slot"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("values"))
    tables, plain = [], queries.stage
    queries.stage = lambda frame: tables.append(plain(frame)) or tables[-1]
    try:
        folder = queries.write_dimension_files(spark, rows, 3)
    finally:
        queries.stage = plain
    assert len(tables) == 1
    parts = tables[0].select(F.input_file_name().alias("file"), "sources", F.monotonically_increasing_id().alias("place")).collect()
    for file in {row["file"] for row in parts}:
        widths = [row["sources"] for row in sorted(parts, key=lambda row: row["place"]) if row["file"] == file]
        assert widths == sorted(widths)
    lines = [row["value"] for row in spark.read.text(f"{folder}/dimension_chain.dat.2").collect()]
    assert sorted(float(line.split()[0]) for line in lines) == list(np.arange(1.0, 300.0, 3.0))

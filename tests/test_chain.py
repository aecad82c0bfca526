import numpy as np
import pytest
from pyspark.sql import functions as F

from slotalign import PosteriorChain
from slotalign.functions import count_swaps, file_number, fill_missing_indices, sort_by_number


@pytest.fixture(scope="module")
def cube():
    values = np.random.default_rng(2).normal(size=(23, 3, 2))
    values[::4, 1] = np.nan
    return values


@pytest.fixture(scope="module")
def chain(spark, cube):
    return PosteriorChain.from_array(spark, cube, 3, 2)


def test_array_roundtrip(chain, cube):
    np.testing.assert_array_equal(chain.to_array(), cube)
    assert chain.shape == (23, 3, 2)


def test_indivisible_array(spark):
    with pytest.raises(ValueError):
        PosteriorChain.from_array(spark, np.zeros(7), 2, 2)


@pytest.mark.parametrize("burn, thin", [(0, 1), (5, 2), (22, 3), (30, 1), (3, 4)])
def test_burn_and_thin(chain, cube, burn, thin):
    np.testing.assert_array_equal(chain.get_chain(burn, thin).to_array(), cube[burn::thin])


@pytest.mark.parametrize("burn, thin", [(-1, 1), (0, 0)])
def test_bad_burn_and_thin(chain, burn, thin):
    with pytest.raises(ValueError):
        chain.get_chain(burn, thin)


def test_burn_counts_samples_not_ids(spark, cube):
    flat = PosteriorChain.from_array(spark, cube, 3, 2).frame.withColumn("sample_id", F.col("sample_id") * 7 + 3)
    chain = PosteriorChain(flat, 3, 2, dense_ids=False)
    np.testing.assert_array_equal(chain.get_chain(burn=4, thin=3).to_array(), cube[4::3])


def test_expand(chain, cube):
    wider = chain.expand_chain(5)
    values = wider.to_array()
    assert wider.num_sources == 5 and wider.trans_dimensional
    np.testing.assert_array_equal(values[:, :3], cube)
    assert np.isnan(values[:, 3:]).all()
    with pytest.raises(ValueError):
        chain.expand_chain(2)


def test_randomize_keeps_entries(chain, cube):
    first = chain.randomize_entries(seed=4).to_array()
    again = chain.with_frame(chain.frame.repartition(7)).randomize_entries(seed=4).to_array()
    other = chain.randomize_entries(seed=5).to_array()
    np.testing.assert_array_equal(first, again)
    np.testing.assert_array_equal(np.sort(first, axis=1), np.sort(cube, axis=1))
    assert not np.array_equal(first, cube, equal_nan=True) and not np.array_equal(first, other, equal_nan=True)


def test_randomize_is_uniform(spark):
    places = PosteriorChain.from_array(spark, np.tile(np.arange(3.0), 6000), 3, 1).randomize_entries(1).to_array()
    orders, counts = np.unique(places[:, :, 0], axis=0, return_counts=True)
    assert len(orders) == 6 and abs(counts - 1000).max() < 150


def test_staged_chain(chain, cube):
    staged = chain.staged()
    np.testing.assert_array_equal(staged.to_array(), cube)
    assert staged.staged() is staged
    plan = staged.values(1, 0)._jdf.queryExecution().executedPlan().toString()
    assert "p1" not in plan.split("ReadSchema")[1]


def test_projection(chain, cube):
    column = [r["value"] for r in chain.values(1, 0).orderBy("sample_id").collect()]
    np.testing.assert_array_equal(np.array(column, dtype=float), cube[:, 1, 0])
    with pytest.raises(IndexError):
        chain.values(3, 0)


def test_long_form_merges_rows(spark):
    rows = spark.createDataFrame(
        [(7, 0, 1.0), (7, 0, 2.0), (7, 2, 5.0), (9, 1, float("nan"))], "sample long, slot int, v double")
    chain = PosteriorChain.from_long(rows, F.col("sample"), F.col("slot"), [F.col("v")], 3, F.sum, [10])
    expected = [[[0.3], [np.nan], [0.5]], [[np.nan], [np.nan], [np.nan]]]
    np.testing.assert_allclose(chain.to_array(), expected)


def test_flat_rows_of_wrong_width(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="does not have 4 values"):
        PosteriorChain.from_flat(rows, F.col("id"), F.col("v"), 2, 2).to_array()


@pytest.mark.parametrize("total, given, expected", [
    (5, [2, 4], [2, 4, 0, 1, 3]), (3, [], [0, 1, 2]), (3, [2, 0, 1], [2, 0, 1]), (0, [], [])])
def test_fill_missing_indices(spark, total, given, expected):
    frame = spark.createDataFrame([(given,)], "given array<int>")
    assert frame.select(fill_missing_indices(total, F.col("given"))).first()[0] == expected


@pytest.mark.parametrize("values, swaps", [([2, 1, 3], 1), ([3, 1, 2], 1), ([1, 2, 3], 0), ([4, 3, 2, 1], 2)])
def test_count_swaps(spark, values, swaps):
    frame = spark.createDataFrame([(values,)], "v array<int>")
    assert frame.select(count_swaps(F.col("v"))).first()[0] == swaps


def test_sort_by_number(spark):
    names = spark.createDataFrame([("d/file.10",), ("d/file.2",), ("d/file.1",)], "name string")
    ordered = [r[0] for r in sort_by_number(names, "name").collect()]
    assert ordered == ["d/file.1", "d/file.2", "d/file.10"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("file.x",)], "name string").select(file_number(F.col("name"))).collect()


def long_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, slot int, a double, b double")


@pytest.mark.parametrize("cells", [128, 0])
def test_long_rows_are_never_lost_or_mixed(spark, monkeypatch, cells):
    monkeypatch.setattr("slotalign.chain.MAX_PIVOT_CELLS", cells)
    make = lambda rows, **more: PosteriorChain.from_long(
        long_rows(spark, rows), F.col("id"), F.col("slot"), [F.col("a"), F.col("b")], 2, **more).to_array()
    np.testing.assert_array_equal(make([(1, 1, 1.0, 10.0), (1, 0, 5.0, None), (2, 1, 3.0, 4.0)]),
                                  [[[5, np.nan], [1, 10]], [[np.nan, np.nan], [3, 4]]])
    for slot in (2, -1, None):
        with pytest.raises(Exception, match="slots must be 0 to 1"):
            make([(1, slot, 1.0, 2.0)])
    with pytest.raises(Exception, match="several rows for one slot of sample 1"):
        make([(1, 0, 1.0, 10.0), (1, 0, 5.0, 2.0)])
    np.testing.assert_array_equal(make([(1, 0, 1.0, 10.0), (1, 0, 5.0, 2.0)], merge=F.sum)[0, 0], [6, 12])


@pytest.mark.parametrize("labels", [[0, 0, 1], [0, 1], [1, 2, 3], [0, 1, None]])
def test_only_permutations_reorder(spark, labels):
    chain = PosteriorChain.from_array(spark, np.arange(6.0).reshape(2, 3), 3, 1)
    with pytest.raises(Exception, match="permutation of 0 to 2"):
        chain.reorder(F.array(*[F.lit(x).cast("int") for x in labels])).to_array()

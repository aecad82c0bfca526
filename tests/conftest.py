import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from slotalign import PosteriorChain  # noqa: E402


def to_array(chain):
    """A whole small chain as an array."""
    rows = chain.frame.orderBy("sample_id").toArrow()
    flat = rows["entries"].combine_chunks().flatten().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, chain.num_sources, chain.num_params_per_source)


PosteriorChain.to_array = to_array


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("slotalign-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def uniforms():
    state = np.random.RandomState(0)
    return state.uniform(0, 1, 10_000), state.uniform(0, 1, 10_000)


@pytest.fixture(scope="session")
def dense(spark, uniforms):
    return PosteriorChain.from_array(spark, np.stack(uniforms, axis=1), 2, 1)


@pytest.fixture(scope="session")
def uneven_gaps(spark, uniforms):
    values = np.stack(uniforms, axis=1)
    rows = np.arange(len(values))
    values[rows % 2 != 0, 0] = np.nan
    values[rows % 3 != 0, 1] = np.nan
    return PosteriorChain.from_array(spark, values, 2, 1)


@pytest.fixture(scope="session")
def half_missing(spark, uniforms):
    values = np.full((20_000, 2), np.nan)
    values[::2] = np.stack(uniforms, axis=1)
    return PosteriorChain.from_array(spark, values, 2, 1, trans_dimensional=True)


@pytest.fixture(scope="session")
def clusters():
    """Three separated sources of two parameters in shuffled slots, with the true source of each entry."""
    rng = np.random.default_rng(11)
    centres = np.array([[0.0, 0.0], [8.0, -5.0], [-6.0, 9.0]])
    values = centres + rng.normal(size=(400, 3, 2))
    values[rng.random((400, 3)) > [0.9, 0.6, 0.3]] = np.nan
    order = rng.permuted(np.tile(np.arange(3), (400, 1)), axis=1)
    return np.take_along_axis(values, order[:, :, None], axis=1), values

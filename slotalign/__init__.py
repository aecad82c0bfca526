"""Consistent source labels for trans-dimensional posterior chains, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .chain import PosteriorChain
from .plans.catalog import make_catalog_mv_normal
from .sources.text import load_samples

# Task functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PosteriorChain", "load_samples", "make_catalog_mv_normal"]

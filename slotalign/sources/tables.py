"""Chains in Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..chain import PosteriorChain


def write_parquet(chain: PosteriorChain, path: str, mode: str = "errorifexists") -> None:
    """The wide frame; the widths travel as metadata of the ``entries`` column."""
    shape = {"num_sources": chain.num_sources, "num_params_per_source": chain.num_params_per_source,
             "trans_dimensional": chain.trans_dimensional, "dense_ids": chain.dense_ids}
    tagged = chain.frame.select("sample_id", F.col("entries").alias("entries", metadata=shape))
    tagged.write.mode(mode).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> PosteriorChain:
    frame = spark.read.parquet(path)
    shape = frame.schema["entries"].metadata
    return PosteriorChain(frame, shape["num_sources"], shape["num_params_per_source"],
                          shape["trans_dimensional"], dense_ids=shape["dense_ids"])

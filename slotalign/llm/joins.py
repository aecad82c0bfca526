"""Joins with a table of one row per key, when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-3


def join_counted(frame: DataFrame, side: DataFrame, key: str, count: str, total: int,
                 hot_share: float = HOT_SHARE) -> DataFrame:
    """``frame`` left joined with ``side``, whose ``count`` says how many rows of ``frame`` have its key.

    Keys with at least ``hot_share`` of the ``total`` rows are at most ``1 / hot_share`` many, so they are
    broadcast and their rows stay where they are. The other rows are shuffled by key; rows of hot keys ride
    along spread evenly. ``side`` should be a written table; ``count`` is dropped.
    """
    columns = [c for c in side.columns if c not in (key, count)]
    least = max(1.0, hot_share * total)
    hot = side.where(F.col(count) >= least).select(key, F.struct(*columns).alias("_hot"))
    rare = side.where(F.col(count) < least).select(F.col(key).alias("_rare_key"), F.struct(*columns).alias("_rare"))
    joined = frame.join(F.broadcast(hot), key, "left")
    if rare.take(1):
        # A hot row gets a key that meets nothing and differs from row to row.
        number = F.concat(F.lit("\u0000hot"), F.monotonically_increasing_id().cast("string"))
        spread = number.cast(frame.schema[key].dataType)
        keyed = joined.withColumn("_rare_key", F.when(
            F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
        joined = keyed.join(rare, "_rare_key", "left").drop("_rare_key")
    else:
        joined = joined.withColumn("_rare", F.lit(None).cast(joined.schema["_hot"].dataType))
    found = F.coalesce("_hot", "_rare")
    return joined.select(*frame.columns, *[found[c].alias(c) for c in columns])

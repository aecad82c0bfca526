"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links`` (``a, b``); the component is its smallest node.

    Every round is written to the shared folder, so the plan stays short and a lost executor costs a
    re-read. A node with very many links only meets them in aggregations with map-side partials and in
    joins with one row per node on the other side.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("neighbour"))
    both = stage(ends.unionByName(ends.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))).distinct())
    labels = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("neighbour")).alias("component")))
    while True:
        offered = both.join(labels.withColumnRenamed("node", "neighbour"), "neighbour").groupBy("node").agg(
            F.min("component").alias("offer"))
        nearest = labels.join(offered, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "offer").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("component").alias("root"))
        stepped = stage(nearest.join(roots, "near", "left").select(
            "node", "before", F.least("near", F.coalesce("root", "near")).alias("component")))
        labels = stepped.select("node", "component")
        if not stepped.where(F.col("before") != F.col("component")).take(1):
            return labels

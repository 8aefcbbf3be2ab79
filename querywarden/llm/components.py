"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step groups by node with a partial minimum first. In the join that follows, the edges of one node meet in one
task: the other side is an aggregate by node, so Spark does not split them. An edge is two keys, and copies have
been merged before, so this is the number of different neighbours of the largest centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywarden.llm.base import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of node keys of one ordered type. Returns (node, label) for every node that has an
    edge to another one; the label is the component's smallest node."""
    a, b = edges.columns
    state = checkpointed(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = checkpointed(small.unionByName(centre.select("u", F.col("m").alias("v"))).distinct())

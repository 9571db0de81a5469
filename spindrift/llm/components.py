"""Connected components of large edge tables by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.staging import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the smallest node that links reach.

    Each round points all larger neighbours of a node at its smallest neighbour (large star), then all smaller ones
    (small star); a few rounds leave a forest of stars. Groups are never gathered: both steps are a ``min`` per node, which
    is combined before its shuffle, and a join that adaptive execution can split. Self-loops and nulls are dropped; an
    empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stage(large.distinct())
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = stage(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        discard(large)
        discard(now)
        now = then
        nodes, pairs = now.agg(F.count_distinct("u"), F.count("*")).first()
        if nodes == pairs and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

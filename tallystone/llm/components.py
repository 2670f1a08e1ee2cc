"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import salted_join, saved


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """True if every u has one edge and is no other's v: each v, smaller than its u, is then a component's root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    ends = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return not ends.agg(F.max(F.when(F.col("above") > 0, F.col("above") + F.col("below") > 1))).first()[0]


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): the smallest node it reaches.

    Hubs are pre-aggregated before each shuffle, and the joins against them are
    salted. Edges are saved after every round.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = saved(now, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = salted_join(both, _least(both), "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = saved(large, "large-star")
        least = _least(large)
        small = salted_join(large, least, "u", "v").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

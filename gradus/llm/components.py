"""Connected components of a graph that stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``edges`` (columns a and b): the smallest node that can be reached.

    Rounds of large and small stars: every node hands its smallest neighbour to the others, which makes chains
    shorter by half or more in each round. A node's neighbours are only joined and reduced to their smallest,
    never gathered, so a hub of any degree is split like any other join. Each round is written."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "components")
    before = None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()) != before:
        before = state
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(down, "v")
        small = joined.select("v", F.col("m").alias("u")).unionByName(joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        now, done = stash(small, "components"), now
        discard(done)
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()

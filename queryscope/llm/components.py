"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import forget, kept


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node that it sees; ``edges`` are (u > v) pairs."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); component: its least reachable node.

    Every round is written to the checkpoint folder, and the round before it removed; the rounds end when the stars no longer change, which a count and a
    checksum of the edges show. Only those two numbers reach the driver. Least nodes are found by a partially aggregated
    group, so a node with very many neighbours meets only in an equi-join, which adaptive execution splits.
    """
    spark, state = edges.sparkSession, None
    edges, path = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, before = now, path
        edges, path = kept(_small_star(_large_star(edges).distinct()).distinct())
        forget(spark, before)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
